"""Range partitioning by sampled splitters, and tables of bits that tell most of what is rare.

Both are of bounded size, whatever the input: splitters are drawn from a fixed number of sampled rows
a part, a table of bits has at most `MOST_BITS`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a table at most: 64 MB.
MOST_BITS = 1 << 29
#: Sampled rows for each part.
SAMPLED = 64


def parts_for(rows: int, per_part: int, spark: SparkSession) -> int:
    """Parts of about `per_part` rows, no fewer than the session's shuffle partitions unless there are few rows."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // per_part), min(usual, -(-rows // 1000)))


def splitters(df: DataFrame, columns: list[str], parts: int, key: Callable[[tuple], tuple]) -> list[tuple]:
    """At most `parts` - 1 different sorted keys that cut the rows into parts of about the same size.

    The sample are the SAMPLED * parts rows with the least hash of all columns; `key` makes the key of a
    row of `columns`.
    """
    if parts < 2:
        return []
    order = F.xxhash64(*[F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")])
    sample = sorted(key(tuple(r)) for r in df.select(*columns, order.alias("_order")).orderBy("_order").limit(SAMPLED * parts).drop("_order").collect())
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def shard_of(key: tuple, found: list[tuple]) -> int:
    """The part of a key: how many splitters are at or below it."""
    return bisect_right(found, key)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finisher of a well-known public hash, fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.uint64(bits - 1)
    return hashes & most, (hashes >> np.uint64(32)) & most


class BitTable:
    """Tells for a 64-bit hash whether it may have been put in: "no" is always right.

    Of 16 bits an entry one in seventy others is let through; with more entries than MOST_BITS / 16 it
    lets through more, and what uses it does more work for the same result.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _places(hashes, self.bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bit_table(df: DataFrame, column: str, entries: int):
    """A broadcast BitTable of the hashes in `column` (bigint)."""
    bits = 1 << max(10, min(MOST_BITS, 16 * max(entries, 1)).bit_length())
    bits = min(bits, MOST_BITS)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate(_places(hashes, bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "mask"])

    found = df.select(column).mapInArrow(slots, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(BitTable(words, bits))
