"""Distinct counts and quantiles from stored sketches that merge.

Each day (or other unit of time) is read once and leaves one row of sketches for each group. Any period is then answered from those rows: no table
of events is read again. New days are added as rows; a day that changed is written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch (a power of 2), and the size of a quantile sketch.
LG_K, K = 14, 400


def distinct_error(lg_k: int = LG_K) -> float:
    """Three standard errors of a distinct count, as a share of it."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = K) -> float:
    """The error of a quantile's rank that is passed in one case of a hundred, as a share of all rows (twice the public one-sided fit)."""
    return 2.446 / k**0.9433


def sketch(df: DataFrame, by: list[Column | str], *, distinct: list[str] = (), quantiles: list[str] = (), lg_k: int = LG_K, k: int = K) -> DataFrame:
    """by, n, and for every column its sketch (column_hll, column_kll). Nulls are in no sketch; a group without values has an empty or null one."""
    hll = [F.hll_sketch_agg(c, F.lit(lg_k)).alias(f"{c}_hll") for c in distinct]
    kll = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(f"{c}_kll") for c in quantiles]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *hll, *kll)


def merged(stored: DataFrame, by: list[Column | str]) -> DataFrame:
    """The rows of `sketch` for larger groups."""
    merge = [F.hll_union_agg(c).alias(c) if c.endswith("_hll") else F.kll_merge_agg_double(c).alias(c) for c in stored.columns if c.endswith(("_hll", "_kll"))]
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), *merge)


def distinct_count(column: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(f"{column}_hll"), F.lit(0).cast("long"))


def quantile(column: str, q: float) -> Column:
    """A value at the rank `q` (0 to 1), within `rank_error`; null if there is none."""
    return F.when(F.kll_sketch_get_n_double(f"{column}_kll") > 0, F.kll_sketch_get_quantile_double(f"{column}_kll", F.lit(q)))


def box(sketches: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, q0, q25, q50, q75, q100 of a column."""
    return sketches.select(*keys, *[quantile(column, q).alias(f"q{round(100 * q)}") for q in (0.0, 0.25, 0.5, 0.75, 1.0)])


def bins(sketches: DataFrame, keys: list[str], column: str, lo: float, hi: float, n: int) -> DataFrame:
    """keys, bin (1 to n; 0 and n + 1 outside), n: a histogram from ranks at the edges; each edge within `rank_error` of all rows."""
    edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
    kll = f"{column}_kll"
    total = F.kll_sketch_get_n_double(kll)
    # a rank counts values up to and with its own, so an edge itself belongs to the bin below it
    upto = [F.lit(0.0), *[F.kll_sketch_get_rank_double(kll, F.lit(float(e))) for e in edges], F.lit(1.0)]
    counts = F.array(*[F.struct(F.lit(i).cast("long").alias("bin"), F.round((b - a) * total).cast("long").alias("n")) for i, (a, b) in enumerate(zip(upto, upto[1:], strict=False))])
    return sketches.where(total > 0).select(*keys, F.explode(counts).alias("x")).select(*keys, "x.bin", "x.n").where("n > 0")
