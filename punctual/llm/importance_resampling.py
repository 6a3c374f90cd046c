"""Quality by importance resampling.

Two generative models of hashed byte n-grams are counted: one of target text (a bounded sample of
documents labelled good), one of all raw text. A document's weight is the log of the ratio of its
probabilities under both, and sampling without replacement in proportion to the weights is the same
as keeping the k largest of weight plus Gumbel noise. The k-th largest is found by counting digits
of the scores from the top, so nothing is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import unit_hash, written

N, BUCKETS = 4, 1 << 14
#: Weights are sums of whole parts of this size, so that they don't depend on their order.
UNIT = 1 << 20
PART = 1 << 21


def _buckets(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte (n - 1 fewer than bytes)."""
    key = np.zeros(len(data) - n + 1, np.uint32)
    for i in range(n):
        key = key * np.uint32(0x01000193) ^ data[i : len(data) - n + 1 + i]
    key *= np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int32)


def _parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about PART bytes: (first row, bytes, starts of its texts and the end)."""
    from punctual.llm.ppm_langid import _bytes_of

    data, starts = _bytes_of(texts.fill_null(""))
    row, many = 0, len(starts) - 1
    while row < many:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + PART, side="right")) - 1)
        yield row, data[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def _spans(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last n-gram of each text."""
    return starts[:-1], np.maximum(starts[:-1], starts[1:] - n + 1)


def count_models(docs: DataFrame, target: Column, *, text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-grams of all rows, and of those for which `target` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False)
            for row, data, starts in _parts(batch.column("text")):
                if len(data) < n:
                    continue
                at = _buckets(data, n, buckets)
                first, past = _spans(starts, n)
                full = past > first
                for k, chosen in enumerate((full, full & good[row : row + len(first)])):
                    if chosen.any():
                        inside = np.zeros(len(at) + 1, np.int8)
                        np.add.at(inside, first[chosen], 1)
                        np.add.at(inside, past[chosen], -1)
                        total[k] += np.bincount(at[np.cumsum(inside[:-1], dtype=np.int8) > 0], minlength=buckets)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    own = docs.select(F.col(text).alias("text"), F.coalesce(target, F.lit(False)).alias("good")).where("text is not null")
    counted = own.mapInArrow(count, "bucket int, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(models: DataFrame, *, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """log(target / raw) of every bucket in units; to the driver come `buckets` rows."""
    found = models.toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = found.column("bucket").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    if not target.any():
        return np.zeros(buckets, np.int64)
    share = lambda x: (x + smoothing) / (x.sum() + smoothing * buckets)
    return np.rint(np.log(share(target) / share(raw)) * UNIT).astype(np.int64)


def weights(docs: DataFrame, ratios: np.ndarray, *, text: str = "text", key: str = "doc_id", n: int = N) -> DataFrame:
    """key, log_weight, n_grams and _text_hash of every row; the first two 0 for null texts and those without an n-gram."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("struct<log_weight: double, n_grams: bigint>")
    def weigh(texts: pa.Array) -> pa.Array:
        ratios, out, many = held.value, np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for row, data, starts in _parts(texts):
            if len(data) >= n:
                sums = np.concatenate([[0], np.cumsum(ratios[_buckets(data, n, len(ratios))])])
                first, past = _spans(starts, n)
                many[row : row + len(first)] = past - first
                out[row : row + len(first)] = (sums[np.minimum(past, len(sums) - 1)] - sums[np.minimum(first, len(sums) - 1)]) / UNIT
        return pa.StructArray.from_arrays([pa.array(out), pa.array(many)], ["log_weight", "n_grams"])

    return docs.select(F.col(key), F.xxhash64(text).alias("_text_hash"), weigh(F.col(text)).alias("_w")).select(key, "_w.log_weight", "_w.n_grams", "_text_hash")


def kth_largest(scores: DataFrame, column: str, k: int, *, digit_bits: int = 12) -> int | None:
    """The k-th largest value of a double column (as `_ordered` has it): a digit at a time, counting rows by digit.

    Each round counts into at most 2^digit_bits groups; only those counts come to the driver.
    """
    now, left, prefix, shift = scores.select(_ordered(F.col(column)).alias("u")), k, 0, 63
    while shift > 0:
        step = min(digit_bits, shift)
        shift -= step
        digit = F.shiftright("u", shift).alias("d")
        rows = now.where(F.shiftright("u", shift + step) == prefix).groupBy(digit).count().collect()
        for r in sorted(rows, key=lambda r: -r["d"]):
            if r["count"] >= left:
                prefix = r["d"]
                break
            left -= r["count"]
        else:
            return None
    return prefix


def _ordered(score: Column) -> Column:
    """A double as a whole number from 0 to 2^63 of the same order, in steps of 2^-30 (held at both ends)."""
    scaled = F.least(F.lit(float(1 << 61)), F.greatest(F.lit(-float(1 << 61)), score * float(1 << 30)))
    return F.floor(scaled).cast("long") + F.lit(1 << 61)


def gumbel(seed: int, *keys: str) -> Column:
    """Standard Gumbel noise, the same for the same keys in every run."""
    return -F.log(-F.log(unit_hash(*keys, F.lit(seed))))


def resample(docs: DataFrame, labels: DataFrame, *, most_target: int = 4000, passage: int | None = None, share: float | None = None, seed: int = 7) -> DataFrame:
    """doc_id, log_weight, n_grams, score, kept of every document.

    The score is log_weight plus noise, so the k largest are a sample without replacement in
    proportion to p_target / p_raw. With `passage` it is the weight of a passage of so many n-grams,
    log_weight * passage / n_grams, plus noise: then length doesn't count.

    The target model learns from at most `most_target` whole documents labelled good (those with the
    least hashes of their ids), the raw model from all documents. `share` of all rows is kept, if not
    given the share of good ones among the labels (all rows without labels). Rows whose scores equal
    the last kept one's are kept with it, so repeated rows stay or go together.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    sample = good.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(most_target)
    # the sample has a fixed bound, so it may be broadcast
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "left")
    ratios = log_ratios(count_models(marked, F.col("_id").isNotNull()))
    if share is None:
        share = labels.agg(F.avg(F.when(F.col("quality").isNotNull(), (F.col("quality") == 1).cast("double")))).first()[0]
    found = weights(docs.select("doc_id", "text"), ratios).withColumn("score", (F.col("log_weight") if passage is None else F.col("log_weight") * passage / F.greatest(F.col("n_grams"), F.lit(1))) + gumbel(seed, "doc_id", "_text_hash"))
    found = written(found.drop("_text_hash"), "weights")
    k = round((1.0 if share is None else share) * found.count())
    least = kth_largest(found, "score", k) if k else None
    kept = F.lit(False) if least is None else _ordered(F.col("score")) >= least
    return found.withColumn("kept", kept)
