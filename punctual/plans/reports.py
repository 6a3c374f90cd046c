"""Exploration reports as tables: what a chart would show, one row a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.formulas import ratio


def by_period(df: DataFrame, year: Column | str, month: Column | str, label: str) -> DataFrame:
    """year, month (null: the whole year), n, delayed, share of delayed; rows with a null label are left out."""
    parts = df.where(F.col(label).isNotNull()).select((F.col(year) if isinstance(year, str) else year).alias("year"), (F.col(month) if isinstance(month, str) else month).alias("month"), F.col(label).alias("_y"))
    out = parts.groupingSets([["year", "month"], ["year"]], "year", "month").agg(F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("delayed"))
    return out.withColumn("share", ratio(F.col("delayed"), F.col("n")))


def delay_summaries(df: DataFrame, reports: dict[str, list[str]], label: str, *, min_total: int = 0, n: int = 20, both: bool = False) -> DataFrame:
    """report, place, group, ontime, delayed, total, share: for every report the n groups with the highest share of delays.

    A report is a list of columns, such as the origin, or origin and destination; a group's values stand in `group`, with a dash between.
    All reports come from one pass: rows are counted by all columns together first, then by each report's. Groups of fewer than
    `min_total` rows are left out. With `both` only combinations of all columns count that have delayed rows and others. Null
    values form groups of their own; rows with a null label are left out.
    """
    columns = list(dict.fromkeys(c for cols in reports.values() for c in cols))
    counts = df.where(F.col(label).isNotNull()).groupBy(*columns).agg(F.count_if(F.col(label) == 0).alias("_o"), F.count_if(F.col(label) == 1).alias("_d"))
    counts = counts.where("_o > 0 AND _d > 0") if both else counts
    sets = counts.groupingSets([list(c) for c in reports.values()], *columns).agg(F.sum("_o").alias("ontime"), F.sum("_d").alias("delayed"), F.grouping_id().alias("_set"))
    mask = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols) for name, cols in reports.items()}
    if len(set(mask.values())) < len(mask):
        raise ValueError("two reports have the same columns")
    named, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, cols in reports.items():
        here = F.col("_set") == mask[name]
        named = F.when(here, F.lit(name)).otherwise(named)
        group = F.when(here, F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cols])).otherwise(group)
    out = sets.select(named.alias("report"), group.alias("group"), "ontime", "delayed", (F.col("ontime") + F.col("delayed")).alias("total"))
    out = out.where(F.col("total") >= min_total).withColumn("share", ratio(F.col("delayed"), F.col("total")))
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("share"), F.desc("total"), "group"))
    return out.withColumn("place", place).where(F.col("place") <= n)


def cancellations(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """by, operated, cancelled, total, share cancelled; a null flag counts as operated."""
    gone = F.coalesce(F.col(flag), F.lit(0)) == 1
    out = df.groupBy(*by).agg(F.count_if(~gone).alias("operated"), F.count_if(gone).alias("cancelled"), F.count("*").alias("total"))
    return out.withColumn("share", ratio(F.col("cancelled"), F.col("total")))


def conditional_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """given, value, outcome, n, share: how often each value of `b` comes with each value of `a`, and the other way round.

    For a label and a flag of the event before: the chance of a delay given that the aircraft came late, and the chance that it
    came late given a delay. Rows are counted once by both; rows with a null in either are left out.
    """
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    ways = F.array(F.struct(F.lit(a).alias("given"), F.col("a").alias("value"), F.col("b").alias("outcome")), F.struct(F.lit(b).alias("given"), F.col("b").alias("value"), F.col("a").alias("outcome")))
    both = counts.select("n", F.explode(ways).alias("w")).select("w.*", "n")
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("given", "value")))


def durations(df: DataFrame, col: str, label: str, *, width: float, groups: int) -> DataFrame:
    """group (1 to `groups`, the last with all above), n, mean, delayed, share: rows by how long they take, `width` a group; rows with no positive duration are left out."""
    group = F.least(F.floor(F.col(col) / width) + 1, F.lit(groups)).cast("int")
    out = df.where((F.col(col) > 0) & F.col(label).isNotNull()).groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.count_if(F.col(label) == 1).alias("delayed"))
    return out.withColumn("share", ratio(F.col("delayed"), F.col("n")))


def attribute_report(df: DataFrame, attributes: DataFrame, on: list[str], shown: dict[str, Column], label: str) -> DataFrame:
    """attribute, value (null: unknown), n, delayed, share: delays by every attribute of the aircraft (or other entity) at once.

    `df` meets the attributes by a left join, so rows without any count as unknown; it is counted by all attributes
    together before each attribute's values are summed.
    """
    joined = df.where(F.col(label).isNotNull()).join(attributes, on, "left").select(*[c.cast("string").alias(n) for n, c in shown.items()], F.col(label).alias("_y"))
    counts = joined.groupBy(*shown).agg(F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("delayed"))
    each = counts.select("n", "delayed", F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).alias("value")) for n in shown])).alias("x"))
    out = each.groupBy("x.attribute", "x.value").agg(F.sum("n").alias("n"), F.sum("delayed").alias("delayed"))
    return out.withColumn("share", ratio(F.col("delayed"), F.col("n")))
