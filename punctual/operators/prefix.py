"""Running totals over a whole table, without a task that reads all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.sources.sinks import checkpointed


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """`df` with columns `totals` (new name: column that is summed up) over all rows up to and with this one, as ordered.

    Rows are cut into ranges by Spark's sampled bounds and kept in the checkpoint folder; a range has one row of sums,
    and the sums of the ranges before it are added to the running ones inside it. `order` must tell all rows
    apart; null values count as 0.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in totals.items()])
    # one row for each range: their number is a setting, not the data's size
    listed = sums.agg(F.sort_array(F.collect_list(F.struct("_part", *[f"_sum_{n}" for n in totals]))).alias("_all"))

    def before_it(name: str) -> Column:
        return F.aggregate(F.slice("_all", F.lit(1), F.col("_i")), F.col(f"_own._sum_{name}") * 0, lambda a, x: a + x[f"_sum_{name}"])

    before = listed.select(F.posexplode("_all").alias("_i", "_own"), "_all").select(F.col("_own._part").alias("_part"), *[before_it(n).alias(f"_before_{n}") for n in totals])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()}).join(F.broadcast(before), "_part")
    return ran.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in totals}).drop("_part", *[f"_before_{n}" for n in totals])
