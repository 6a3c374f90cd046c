"""What the operators of this subpackage share: reading tables, cutting lineage, small expressions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class of Java and DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table `name`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which may run where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="punctual-")) / "punctual_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one where none is set, and only on one machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="punctual-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, *, files: int | None = None) -> DataFrame:
    """Cut the lineage of `df`: write it once to the shared folder and read it again, in at most `files` files.

    A lost executor then costs one task over these files, not the whole plan behind them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_for(rows: int, per_file: int, least: int = 1) -> int:
    """In how many files to write so many rows, whatever the number of shuffle partitions.

    Hadoop's local file system starts a process (chmod) for every file it makes, so a table of few rows in hundreds of files costs more than its rows.
    """
    return max(least, -(-rows // per_file))


def twice_the_cores(spark: SparkSession) -> int:
    """As many tasks as keep a cluster busy."""
    return 2 * spark.sparkContext.defaultParallelism


def file_count(docs: DataFrame, per_file: int = 10_000) -> int:
    """In how many files to write the rows of `docs`, texts included, in however many parts they come: `per_file` rows each, but no fewer than twice the cores."""
    return files_for(docs.count(), per_file, twice_the_cores(docs.sparkSession))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(*cols: Column | str) -> Column:
    """A number in (0, 1), the same for the same columns in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
