"""Sinks, caches and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], *, mode: str = "overwrite", files_per_key: int | None = None, rows_per_file: int = 5_000_000) -> None:
    """Hive partitions with few files each.

    Rows are rebalanced by key, and adaptive execution splits the keys that are too large for one
    task. With `files_per_key` each key is dealt to so many tasks instead, by the hash of its row.
    """
    if files_per_key is None:
        dealt = df.hint("rebalance", *by)
    else:
        dealt = df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key)))
    dealt.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def append_partitioned(df: DataFrame, path: str, by: list[str], **options: int) -> None:
    write_partitioned(df, path, by, mode="append", **options)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log. Rows there are never read and written back."""
    df.write.mode("append").parquet(path)


def write_single(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """A small table as one file; more than `most_rows` are refused."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows are no small table")
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, path: str, text: str = "value") -> None:
    df.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(cls, path: str):
    return cls.load(path)


def save_predictions(predictions: dict[str, DataFrame], base: str) -> None:
    """One folder below `base` for each data set."""
    for name, df in predictions.items():
        write_parquet(df, f"{base}/{name}")


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """`df` kept in memory or on disk while the block runs."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@contextmanager
def cached_view(df: DataFrame, name: str) -> Iterator[None]:
    """`df` as the temporary view `name` while the block runs, kept once it has been read."""
    df.createOrReplaceTempView(name)
    df.sparkSession.sql(f"CACHE LAZY TABLE {name}")
    try:
        yield
    finally:
        df.sparkSession.catalog.uncacheTable(name)
        df.sparkSession.catalog.dropTempView(name)


@contextmanager
def in_new_session(**frames: DataFrame) -> Iterator[dict[str, DataFrame]]:
    """The same frames in a session of their own with the same settings, while the block runs.

    A session that has observed metrics can no longer run fitted models that hold a summary: the summary's frame, and with
    it the session, goes into the task. So what is observed is observed in another session.
    """
    spark = next(iter(frames.values())).sparkSession
    other = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if other.conf.isModifiable(k):
            other.conf.set(k, v)
    names = {k: f"{k}_{uuid.uuid4().hex}" for k in frames}
    try:
        for k, df in frames.items():
            df.createGlobalTempView(names[k])
        yield {k: other.table(f"global_temp.{n}") for k, n in names.items()}
    finally:
        for n in names.values():
            spark.catalog.dropGlobalTempView(n)


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; a temporary one only where none is set, and only on one machine."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="punctual-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of `checkpoint_folder`, where tables may be written that are read again."""
    checkpoint_folder(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder where Spark's files are, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of `df` without its lineage, in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
