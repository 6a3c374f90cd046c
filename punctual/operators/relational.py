"""Projections, filters, schema operators, set operations and top-n."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of a flight record that aren't known before it departs, by reason.
LEAKAGE_GROUPS = {
    "delay_causes": ["CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY"],
    "arrival": ["ARR_DELAY", "ARR_DELAY_NEW", "ARR_DEL15", "ARR_DELAY_GROUP"],
    "flight": ["AIR_TIME", "ACTUAL_ELAPSED_TIME", "WHEELS_ON", "TAXI_IN", "ARR_TIME", "TAXI_OUT", "WHEELS_OFF", "DEP_TIME_BLK", "ARR_TIME_BLK"],
    "departure": ["DEP_TIME"],
    "diversion": ["DIV_AIRPORT_LANDINGS", "DIVERTED"],
}


def keep(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The listed columns, those that are missing left out."""
    return df.select(*[c for c in cols if c in df.columns])


def drop_cols(df: DataFrame, *groups: Iterable[str]) -> DataFrame:
    return df.drop(*[c for g in groups for c in g])


def drop_leakage(df: DataFrame, groups: dict[str, list[str]] = LEAKAGE_GROUPS) -> DataFrame:
    return drop_cols(df, *groups.values())


def drop_cancelled(df: DataFrame, col: str) -> DataFrame:
    """Rows whose flag isn't 1; a null flag goes too."""
    return df.where(F.col(col) != 1)


def require_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def fill(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def align_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, column ("name::type"): what only one of two schemas has."""
    x, y = ({f"{n}::{t}" for n, t in d.dtypes} for d in (a, b))
    rows = [("left", c) for c in sorted(x - y)] + [("right", c) for c in sorted(y - x)]
    return a.sparkSession.createDataFrame(rows, "side string, column string")


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def route_key(a: str, b: str) -> Column:
    return F.concat_ws("-", a, b)


def semi_filter(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """IN (SELECT ...)."""
    return df.join(keys.select(F.col(key or on).alias(on)), on, "left_semi")


def anti_filter(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """NOT IN (SELECT ...) among the keys that aren't null; a row with a null key goes."""
    known = keys.select(F.col(key or on).alias(on)).where(F.col(on).isNotNull())
    return df.where(F.col(on).isNotNull()).join(known, on, "left_anti")


def time_split(df: DataFrame, col: str, cut) -> tuple[DataFrame, DataFrame]:
    """Rows before `cut`, and from it on."""
    return df.where(F.col(col) < F.lit(cut)), df.where(F.col(col) >= F.lit(cut))


def quarter_subset(df: DataFrame, date: str, years: list[int], quarter: int) -> DataFrame:
    """One quarter of several years in one pass."""
    return df.where(F.year(date).isin(years) & (F.quarter(date) == quarter))


def top_n(df: DataFrame, by: str, n: int, tie: list[str], ascending: bool = False) -> DataFrame:
    """The n rows with the largest (smallest) `by`; ties go by the other columns."""
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), *tie).limit(n)


def distinct_ids(dfs: list[DataFrame], cols: list[str], name: str = "id") -> DataFrame:
    """All different values of several columns of several tables, each table read once."""
    parts = [d.select(F.explode(F.array(*[F.col(c) for c in cols if c in d.columns])).alias(name)) for d in dfs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col(name).isNotNull()).distinct()


def union_all(*dfs: DataFrame) -> DataFrame:
    """By name; columns that a table lacks are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def route_directions(df: DataFrame, origin: str, dest: str, ids: list) -> DataFrame:
    """id, direction, n: rows that leave from and arrive at the given places."""
    parts = [df.where(F.col(c).isin(ids)).groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).withColumn("direction", F.lit(d)) for c, d in ((origin, "outbound"), (dest, "inbound"))]
    return parts[0].unionByName(parts[1]).select("id", "direction", "n").distinct()


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Every row n times."""
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_k") if n > 0 else df.limit(0)
