"""Sources."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables of at most so many rows are broadcast where a key list has no size of its own.
SMALL_ROWS = 1_000_000


def read_parquet(spark: SparkSession, *paths: str, cols: list[str] | None = None) -> DataFrame:
    """Parquet files, folders or globs; only `cols` are read."""
    df = spark.read.parquet(*paths)
    return df.select(*cols) if cols else df


def read_reference_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A small table with a header; types are inferred if no schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_weather_csv(spark: SparkSession, path: str, date: str = "DATE") -> DataFrame:
    """Readings as text from all files below a folder, with a year column."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    return df.withColumn("year", F.year(F.col(date).try_cast("timestamp")))


def read_csv_opts(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    return spark.read.format("csv").options(**options).schema(schema).load(path)


def adjacency_edges(lines: DataFrame, text: str = "value") -> DataFrame:
    """src, dst, weight of lines "node, tab, {'neighbour': count}"; a node without neighbours has one row without dst."""
    cut = F.split(F.col(text), "\t")
    near = F.from_json(F.replace(F.get(cut, F.lit(1)), F.lit("'"), F.lit('"')), "map<string,int>")
    return lines.select(F.get(cut, F.lit(0)).alias("src"), F.explode_outer(near).alias("dst", "weight"))


def read_adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    return adjacency_edges(spark.read.text(path))


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """id, title of lines "title, tab, id, ..."."""
    cut = F.split("value", "\t")
    return spark.read.text(path).select(F.get(cut, F.lit(1)).try_cast("long").alias("id"), F.get(cut, F.lit(0)).alias("title"))


def rows_to_df(spark: SparkSession, rows: Iterable, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def json_to_df(spark: SparkSession, value: dict, schema: StructType | str) -> DataFrame:
    """One row of a nested value."""
    text = spark.createDataFrame([(json.dumps(value),)], "j string")
    return text.select(F.from_json("j", schema if isinstance(schema, str) else schema.simpleString()).alias("v")).select("v.*")


def filter_to_keys(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """The rows whose `on`, whatever its case, is among the keys."""
    wanted = keys.select(F.lower(F.col(key or on)).alias("_key")).distinct()
    return df.join(wanted, F.lower(F.col(on)) == F.col("_key"), "left_semi")


def list_files(spark: SparkSession, path: str, key: str = r"([^/.]+)[^/]*$") -> DataFrame:
    """path, length, modified, key of all files below a folder; none is opened. `key` is a pattern whose group is taken from the path, in lower case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", key, 1)).alias("key"))


def read_keyed_files(spark: SparkSession, path: str, keys: DataFrame, on: str, *, schema: StructType | str, key: str = r"([^/.]+)[^/]*$", format: str = "csv", name: str = "file_key", **options: str | bool) -> DataFrame:
    """The rows of those files below `path` whose key is among the keys, whatever its case, with the key as a column; other files are never opened.

    Files are listed by Spark and chosen by a join; only the paths of the chosen ones pass the driver, as those of any scan do.
    """
    wanted = filter_to_keys(list_files(spark, path, key), keys, "key", on)
    paths = [r["path"] for r in wanted.select("path").orderBy("path").collect()]
    reader = spark.read.format(format).schema(schema).options(**{"header": True} | options) if format == "csv" else spark.read.format(format).schema(schema).options(**options)
    df = reader.load(paths) if paths else spark.createDataFrame([], schema)
    source = F.regexp_extract(F.col("_metadata.file_path"), key, 1) if paths else F.lit(None).cast("string")
    return df.withColumn(name, F.lower(source))
