"""Window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.timeops import seconds_between


def prior_flag(df: DataFrame, key: str, ts: str, label: str, *, tie: str | None = None, day: Column | None = None, min_gap_s: int = 8100, name: str = "prior_flag", one_pass: bool = False) -> DataFrame:
    """`df` with the label of the key's previous row, if that is over `min_gap_s` older and of the same day; else 0.

    Rows with a null key go round the window, so they neither gather in one task nor follow each other. That reads `df`
    twice; with `one_pass` they go through it, spread by their hash.
    """
    by_day = day is None
    day = F.to_date(ts) if by_day else day
    known = (df if one_pass else df.where(F.col(key).isNotNull())).withColumn("_day", day)
    alone = [F.when(F.col(key).isNull(), F.xxhash64(*df.columns))] if one_pass else []
    # a day of the row's own time holds all that may count, so that long histories are split by day
    w = Window.partitionBy(key, *(["_day"] if by_day else []), *alone).orderBy(ts, *([tie] if tie else []))
    before = F.lag(F.struct(F.col(ts).alias("t"), F.col(label).alias("l"), F.col("_day").alias("d"))).over(w)
    old = known.withColumn("_b", before)
    fits = F.col(key).isNotNull() & (seconds_between(F.col("_b.t"), F.col(ts)) > min_gap_s) & (F.col("_b.d") == F.col("_day"))
    found = old.withColumn(name, F.coalesce(F.when(fits, F.col("_b.l")), F.lit(0)).cast("int")).drop("_b", "_day")
    return found if one_pass else found.unionByName(df.where(F.col(key).isNull()).withColumn(name, F.lit(0).cast("int")))


def argmin_rows(df: DataFrame, part: list[str], v: str) -> DataFrame:
    """Rows that have the least value of their group; it is aggregated before it is joined back, so hot groups are no matter."""
    least = df.groupBy(*part).agg(F.min(v).alias("_least"))
    return df.join(least, part).where(F.col(v) == F.col("_least")).drop("_least")


def first_per_group(df: DataFrame, part: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_per(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest row of each key, aggregated map-side; of equally late ones the largest by the other columns."""
    rest = [c for c in df.columns if c not in (key, ts)]
    top = df.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("_m"))
    return top.select(*[F.col(key) if c == key else F.col(f"_m.{c}") for c in df.columns])


def closest_reading(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Of each key and hour the reading nearest before the full hour."""
    hour = df.withColumn("_hour", F.date_trunc("hour", ts))
    return first_per_group(hour, [key, "_hour"], [F.minute(ts).desc(), F.col(tie)]).drop("_hour")
