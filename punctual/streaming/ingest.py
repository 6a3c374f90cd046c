"""Files that keep arriving are appended to a partitioned table, each exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ingest_new_files(
    spark: SparkSession, source: str, destination: str, state: str, *, schema: StructType | str, by: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None, files_at_once: int | None = None, **options: str | bool
) -> int:
    """Append the rows of all CSV files below `source` that weren't ingested yet, partitioned by `by`; returns how many batches that took.

    The folder `state` remembers which files belong to which batch, and the table's own log which batches are whole. So a run that
    breaks off is taken up by the next one, and no file is lost or repeated. Readers see whole batches only. `prepare` derives columns such as
    the year. A new file is one with a new path; `files_at_once` bounds a batch. Run it again whenever files have arrived; it ends
    when none are left.
    """
    reader = spark.readStream.format("csv").schema(schema).options(**{"header": True, "recursiveFileLookup": True} | options)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    rows = reader.load(source)
    rows = prepare(rows) if prepare else rows
    query = rows.writeStream.format("parquet").partitionBy(*by).option("checkpointLocation", state).trigger(availableNow=True).start(destination)
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p.numInputRows)
