"""Aggregations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def rate_by(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, n, rate: the mean of a 0/1 label."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def top_rate(df: DataFrame, keys: list[str], label: str, min_total: int, n: int) -> DataFrame:
    """The n groups of at least `min_total` rows with the highest rate."""
    return rate_by(df, keys, label).where(F.col("n") >= min_total).orderBy(F.desc("rate"), *keys).limit(n)


def hourly_rollup(df: DataFrame, key: str, hour: str, avg_cols: list[str], max_cols: list[str]) -> DataFrame:
    return df.groupBy(key, hour).agg(*[F.avg(c).alias(f"avg_{c}") for c in avg_cols], *[F.max(c).alias(c) for c in max_cols])


# Causes of delay.
CAUSES = ["carrier", "weather", "nas", "security", "late_aircraft"]


def delay_cause_summary(df: DataFrame, by: list[str] | None = None, having: Column | None = None) -> DataFrame:
    """Flights, delays by cause in counts and minutes, and those on time; of all rows or by group."""
    out = df.groupBy(*(by or [])).agg(
        F.sum("arr_flights").alias("total_flights"),
        F.sum("arr_del15").alias("delayed_flights"),
        (F.sum("arr_flights") - F.sum("arr_del15") - F.sum("arr_cancelled") - F.sum("arr_diverted")).alias("on_time_flights"),
        *[F.round(F.sum(f"{c}_ct"), 0).alias(f"{c}_delay_counts") for c in CAUSES],
        *[F.sum(f"{c}_delay").alias(f"{c}_delay_mins") for c in CAUSES],
        F.sum("arr_cancelled").alias("arrival_cancelled"),
        F.sum("arr_diverted").alias("arrival_diverted"),
    )
    return out if having is None else out.where(having)


def having(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """keys, n of the groups for which the condition on n holds."""
    return count_by(df, *keys).where(condition)


def distinct(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct() if cols else df.distinct()


def count_distinct(df: DataFrame, col: str, *, approx: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(col) if approx else F.count_distinct(col)).alias("n_distinct"))


def col_range(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("avg"))


def indicator_means(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def null_profile(df: DataFrame) -> DataFrame:
    """column, n_null, n_rows for every column; NaN counts as null."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float")}
    counts = [F.count_if(F.col(c).isNull() | F.isnan(c) if c in numeric else F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(F.count("*").alias("_rows"), *counts)
    return wide.unpivot("_rows", df.columns, "column", "n_null").select("column", "n_null", F.col("_rows").alias("n_rows"))


def describe_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, n, mean, stddev, min, max of numeric columns, in one pass."""
    facts = {"n": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[F.struct(*[f(F.col(c)).cast("double").alias(k) for k, f in facts.items()]).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "v").select("column", F.col("v.n").cast("long").alias("n"), *[f"v.{k}" for k in facts if k != "n"])


def type_census(df: DataFrame) -> DataFrame:
    rows: dict[str, int] = {}
    for _, t in df.dtypes:
        rows[t] = rows.get(t, 0) + 1
    return df.sparkSession.createDataFrame(sorted(rows.items()), "type string, n long")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    cut = F.split("pair", r"\|")
    half = long.select(cut[0].alias("a"), cut[1].alias("b"), "r")
    return half.unionByName(half.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def corr_wide(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r of all pairs of any number of columns: one aggregate of a vector gives all sums of products.

    Rows with a null or NaN in any of the columns are left out; columns that don't vary have no correlation (null).
    """
    ready = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    vector = VectorAssembler(inputCols=ready.columns, outputCol="_v", handleInvalid="skip").transform(ready).select("_v")
    matrix = Correlation.corr(vector, "_v").first()[0].toArray() if not vector.isEmpty() else None
    value = lambda i, j: None if matrix is None or not math.isfinite(matrix[i, j]) else float(matrix[i, j])
    rows = [(a, b, value(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)]  # columns squared, whatever the rows
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin (1 to bins; 0 and bins + 1 outside), n."""
    return df.where(F.col(col).isNotNull()).groupBy(F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, group: str, col: str, *, approx: bool = False) -> DataFrame:
    """group, q0, q25, q50, q75, q100; exact quantiles, or approximate ones for very large groups."""
    q = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = df.groupBy(group).agg((F.percentile_approx(col, q) if approx else F.percentile(col, F.lit(q))).alias("_q"))
    return found.select(group, *[F.get("_q", F.lit(i)).alias(f"q{round(100 * x)}") for i, x in enumerate(q)])


def value_share(df: DataFrame, col: str) -> DataFrame:
    from punctual.operators.joins import share_of_total

    return share_of_total(count_by(df, col), "n")


def coverage_audit(counts: list[tuple[str, DataFrame]]) -> DataFrame:
    """sequence, what, n: rows of several tables as one table; they are counted where they are."""
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(i).alias("sequence"), F.lit(name).alias("what"), "n") for i, (name, d) in enumerate(counts, 1)]
    return reduce(DataFrame.unionByName, parts)


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """`df` with a weight for each row: the share of the other class."""
    share = df.agg(F.avg(label).alias("_share"))
    return df.join(F.broadcast(share)).withColumn(name, F.when(F.col(label) == 1, 1 - F.col("_share")).otherwise(F.col("_share"))).drop("_share")


def year_counts(entities: DataFrame, readings: DataFrame, on: str, ts: str) -> DataFrame:
    """on, year, n: readings of known entities by year."""
    return readings.join(entities.select(on).distinct(), on, "left_semi").groupBy(on, F.year(ts).alias("year")).agg(F.count("*").alias("n"))


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, mean, variance (of the population)."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("variance")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "v").select("column", "v.mean", "v.variance")
