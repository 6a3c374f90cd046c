"""Hourly rollup of readings that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_rollup(readings: DataFrame, key: str, ts: str, avg_cols: list[str], max_cols: list[str], *, late: str = "2 hours") -> DataFrame:
    """The rollup of `hourly_rollup` over a stream (or a table): an hour is given out once no reading of it can be on time any more."""
    # readings are known at the full hour after them: 14:01 to 15:00 belong to 15:00
    shifted = readings.withColumn("_ts", F.col(ts).cast("timestamp") + F.expr("INTERVAL '59' MINUTE")).withWatermark("_ts", late)
    hours = F.window("_ts", "1 hour")
    out = shifted.groupBy(key, hours.alias("w")).agg(*[F.avg(c).alias(f"avg_{c}") for c in avg_cols], *[F.max(c).alias(c) for c in max_cols])
    return out.select(key, F.col("w.start").alias("hour"), *[c for c in out.columns if c not in (key, "w")])

