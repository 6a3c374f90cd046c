"""Removal of byte strings that occur more than once, with a suffix array over sampled suffixes.

Every string of LENGTH bytes holds LENGTH - GRAM + 1 strings of GRAM bytes; the one with the least hash is its
anchor, so equal strings have their anchors at the same offset. Only suffixes that begin at anchors are
sorted: about one in seventy. In a first pass anchors are counted by hash; one whose hash is met once
stands for strings that occur once, and is left out (a table of bits of bounded size tells; a
"maybe" only costs work). Of the others each gives one row: the text on both sides that its strings can reach.

Spark cuts these rows into ranges by sampled splitters on the leading bytes of the suffix and sorts them. A bucket
of a range sorts its suffixes by multikey quicksort, eight bytes a key, and likewise the texts to the left,
backwards; common lengths of neighbours then tell by comparison of whole numbers which strings of LENGTH bytes
are equal: those whose left part of o bytes and right part of LENGTH - o bytes both lie in one run. As
splitters are leading bytes that all equal strings share, no equal strings lie on two sides of a boundary. Rows with
equal texts around their anchors are summed up before, so a passage of any number of documents is one row of a bucket. Where
the suffixes with the same leading bytes are still more than a bucket holds, they are dealt anew, by longer
leading bytes: those of the strings that reach far to the left, and those of the others. In the end the
leading bytes are the whole string.

Texts that occur more than once count once as neighbours of others, and are removed as a whole
if they have LENGTH bytes. Null texts are empty. Rows are told apart by their text alone, so rows that share an id (or
have none) each get a row. Texts under LENGTH bytes lose nothing. Texts of any length are read whole, in blocks. An empty
table gives no rows. Extra columns aren't read. Texts are told apart by the first 16 bytes of their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import ship, written
from punctual.llm.ranges import bit_table, mixed

LENGTH = 200
GRAM = 64
#: Rows of a bucket at most; more that share their leading bytes are dealt anew.
BUCKET = 40_000
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 21
#: An odd number whose powers weigh the bytes of a string (any would do).
BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BLOCK + LENGTH, BASE), _powers(BLOCK + LENGTH, pow(BASE, -1, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of `gram` bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    m = len(data) - gram + 1
    return mixed((sums[gram:] - sums[:m]) * _DOWN[:m])


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` hashes the place of its least one by the leading bits, the first of equals."""
    n = len(x) - width + 1
    bits = np.uint64((BLOCK + LENGTH).bit_length())
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x >> bits << bits | np.arange(len(x), dtype=np.uint64)
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (place, hash, least and largest offset) of the anchors: strings begin at place - offset."""
    for s in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = data[s : s + BLOCK + length - 1]
        hashes = gram_hashes(block, gram)
        places = least_places(hashes, length - gram + 1)
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        last = np.append(first[1:], len(places)) - 1
        at = places[first]
        yield s + at, hashes[at], at - last, at - first


def _digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def _texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) of the different texts of each batch that hold a string of `length` bytes."""
    for batch in batches:
        seen = set()
        for x in batch.column("text"):
            raw = (x.as_py() or "").encode()
            if len(raw) >= length and (d := _digest(raw)) not in seen:
                seen.add(d)
                yield d, raw


def _counted(batches: Iterator[pa.RecordBatch], length: int, gram: int, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(h, n) of the anchors of some texts, n at most 2."""
    held: list[np.ndarray] = []
    size = 0

    def summed() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

    for _, raw in _texts(batches, length):
        for _, h, _, _ in anchors(np.frombuffer(raw, np.uint8), length, gram):
            held.append(h)
            size += len(h)
            if size > rows:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


CONTEXT = "lead binary, context binary, hi int, t binary, place long"
CONTEXT_NAMES = ["lead", "context", "hi", "t", "place"]


def _contexts(batches: Iterator[pa.RecordBatch], often, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each anchor that may occur again: the bytes its strings reach, of which the anchor is the hi-th."""
    out: list[tuple] = []
    for t, raw in _texts(batches, length):
        for at, h, lo, hi in anchors(np.frombuffer(raw, np.uint8), length, gram):
            keep = often.value.may_hold(h)
            for p, a, b in zip(at[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), strict=True):
                out.append((raw[p : p + gram], raw[p - b : p - a + length], b, t, p))
            if len(out) > 5000:
                yield _rows(out)
                out = []
    if out:
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], CONTEXT_NAMES)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows sorted by their columns (uint64, eight bytes each), and the bytes that each shares with the row before it.

    Multikey quicksort: rows that are equal so far are sorted by the next column, the others stay in place.
    """
    m, k = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    sorted_by = words[order, 0]
    new = np.append(True, sorted_by[1:] != sorted_by[:-1])
    for c in range(1, k):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((words[rows, c], group[tied]))]
        x = words[order[tied], c]
        apart = np.append(True, (x[1:] != x[:-1]) | (group[tied][1:] != group[tied][:-1]))
        new[tied] |= apart
    placed = words[order]
    differ = placed[1:] ^ placed[:-1]
    some = differ != 0
    col = np.where(some.any(1), some.argmax(1), k)
    bits = differ[np.arange(m - 1), np.minimum(col, k - 1)]
    # bytes before the first that differs
    same = np.zeros(m - 1, np.int64)
    for b in range(1, 8):
        same += bits >> np.uint64(64 - 8 * b) == 0
    lcp = np.zeros(m, np.int64)
    lcp[1:] = np.where(col == k, 8 * k, 8 * col + same)
    return order, lcp


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """The strings as rows of big-endian numbers of eight bytes, filled up with zeros."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), ">u8").reshape(len(parts), -1).astype(np.uint64)


def repeated(contexts: list[bytes], his: list[int], copies: np.ndarray, length: int, low: int, high: int) -> list[list[tuple[int, int]]]:
    """For each row the ranges of offsets (from `low` to `high`) whose string occurs in another row, or in this one if it has copies.

    Rows share the leading bytes from their anchor on, or other bytes at the same offset from it.
    """
    m = len(contexts)
    hi = np.array(his)
    wide = max(high, 1)
    lo = hi - (np.array([len(c) for c in contexts]) - length)
    flags = np.zeros((m, high - low + 1), bool)
    flags[copies] = True
    if m > 1:
        right, r = multikey_order(_matrix([c[h:] for c, h in zip(contexts, his, strict=True)], length))
        left, q = multikey_order(_matrix([c[max(h - wide, 0) : h][::-1] for c, h in zip(contexts, his, strict=True)], wide))
        run, kind = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for o in range(low, high + 1):
            at = np.flatnonzero((lo <= o) & (o <= hi))
            if len(at) < 2:
                continue
            run[right] = np.cumsum(r < length - o)
            kind[left] = np.cumsum(q < o)
            key = run[at] << 32 | kind[at]
            order = np.argsort(key, kind="stable")
            x = key[order]
            twin = np.append(False, x[1:] == x[:-1])
            twin |= np.append(twin[1:], False)
            flags[at[order[twin]], o - low] = True
    own = (np.arange(low, high + 1)[None, :] >= lo[:, None]) & (np.arange(low, high + 1)[None, :] <= hi[:, None])
    flags &= own
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for (i, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
        out[i].append((low + a, low + b - 1))
    return out


GROUPED_NAMES = [*CONTEXT_NAMES, "again"]
FOUND = "t binary, first long, last long, lead binary, context binary, hi int, place long, again boolean"
FOUND_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()]


def _search(batches: Iterator[pa.RecordBatch], length: int, low: int, high: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by lead, one for each context, hi: ranges (t, first, last) of places where repeated strings begin.

    A lead with more than `bucket` contexts comes out as it went in, to be dealt anew.
    """
    out: list[tuple] = []
    held: list[tuple] = []  # the rows of a bucket
    over: bytes | None = None  # the lead that is dealt anew
    start = 0  # of the current lead in held

    def passed(r: tuple) -> None:
        out.append((r[3], None, None, *r[:3], r[4], r[5]))

    def ended() -> None:
        spans = repeated([r[1] for r in held], [r[2] for r in held], np.array([r[5] for r in held], bool), length, low, high)
        for r, found in zip(held, spans, strict=True):
            out.extend((r[3], r[4] - b, r[4] - a, None, None, None, None, None) for a, b in found)
        held.clear()

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, FOUND_KINDS, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    lead = None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in GROUPED_NAMES), strict=True):
            if row[0] != lead:
                lead = row[0]
                if len(held) >= bucket // 2:
                    ended()
                start = len(held)
            if over != lead and len(held) - start >= bucket and high > low:
                over = lead
                for r in held[start:]:
                    passed(r)
                del held[start:]
            if over == lead:
                passed(row)
            else:
                held.append(row)
            if len(out) > 10_000:
                yield batch()
    if held:
        ended()
    if out:
        yield batch()


def starts(rows: DataFrame, *, length: int, gram: int, bucket: int) -> DataFrame:
    """(t, first, last): ranges of places of a text at which a repeated string begins, from rows of `_contexts`.

    Rows are summed up by context before they are dealt to ranges, so a passage of a third of all texts is one row there; all strings of
    a context that occurs again are repeated, which a join tells its rows.
    """
    spark = rows.sparkSession
    place = F.struct("t", "place")
    summed = rows.groupBy("lead", "context", "hi").agg(F.min(place).alias("one"), F.max(place).alias("other"))
    grouped = written(summed.select("lead", "context", "hi", "one.t", "one.place", (F.col("one") != F.col("other")).alias("again")), "grouped")
    name = F.struct(digest(F.col("context")).alias("c"), "hi").alias("name")
    repeated_ = grouped.where("again").select(name)
    all_of = rows.select(name, "t", (F.col("place") - F.col("hi")).alias("first"), (F.col("place") - F.col("hi") + F.length("context") - length).alias("last"))
    whole = all_of.join(repeated_, "name").select("t", "first", "last").distinct()

    def level(rows: DataFrame, low: int, high: int) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, "lead").sortWithinPartitions("lead").select(*GROUPED_NAMES)
        return written(dealt.mapInArrow(lambda b: _search(b, length, low, high, bucket), FOUND), "ranges")

    found, todo = [whole], [(grouped, 0, length - gram)]
    while todo:
        now, low, high = todo.pop()
        got = level(now, low, high)
        found.append(got.where("first is not null").select("t", "first", "last"))
        rest = got.where("context is not null")
        if low < high and not rest.isEmpty():
            mid = (low + high) // 2
            for a, b in ((low, mid), (mid + 1, high)):
                # strings of offsets a to b share the bytes from `a` before the anchor to LENGTH - b after it
                reach = rest.where((F.col("hi") >= a) & (F.col("hi") - F.length("context") + length <= b))
                trimmed = reach.select(F.expr(f"substring(context, hi - {a} + 1, {a} + {length} - {b})").alias("lead"), "context", "hi", "t", "place", "again")
                todo.append((trimmed, a, b))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def spans(found: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal runs [from, to) of bytes under strings that begin in the ranges (first, last)."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


DONE = "t binary, n_removed long, n_spans long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text (t, text, first, last)."""
    for b in batches:
        out = []
        for t, text, first, last in zip(*(b.column(c).to_pylist() for c in ("t", "text", "first", "last")), strict=True):
            raw, at, removed, kept = text.encode(), 0, 0, hashlib.sha256()
            runs = spans(list(zip(first, last, strict=True)), length)
            for s, e in runs:
                kept.update(raw[at:s])
                removed, at = removed + e - s, e
            kept.update(raw[at:])
            out.append((t, removed, len(runs), kept.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)], [x.split()[0] for x in DONE.split(", ")])


def repeats(docs: DataFrame, *, text: str = "text", length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(t, first, last): for texts that occur once, ranges of places at which repeated strings begin; and (t): texts of `length` bytes that
    occur more than once, of which every byte is repeated. t is the text's digest, as in `digest`."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    twice = written(texts.where(F.octet_length("text") >= length).groupBy(digest("text").alias("t")).agg(F.count("*").alias("n")).where("n > 1").select("t"), "copies")
    counted = texts.mapInArrow(lambda b: _counted(b, length, gram), "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    often = written(counted.where("n > 1").select("h"), "anchors")
    table = bit_table(often, "h", often.count())
    rows = written(texts.mapInArrow(lambda b: _contexts(b, table, length, gram), CONTEXT), "contexts")
    found = starts(rows, length=length, gram=gram, bucket=bucket)
    return found.join(twice, "t", "left_anti"), twice


def digest(text: Column | str) -> Column:
    """What texts are told apart by: the first 16 bytes of their SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row, after the removal of every byte under a string of `length` bytes that also begins elsewhere."""
    found, twice = repeats(docs, text=text, length=length, gram=gram, bucket=bucket)
    ranges = written(found.groupBy("t").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")), "repeats")
    each = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    some = bit_table(ranges.select(F.xxhash64("t").alias("h")), "h", ranges.count())

    @F.arrow_udf("boolean")
    def may_change(h: pa.Array) -> pa.Array:
        return pa.array(some.value.may_hold(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    changed = each.withColumn("t", digest("text")).where(may_change(F.xxhash64("t"))).select("t", "text")
    partly = changed.join(ranges, "t").mapInArrow(lambda b: _removed(b, length), DONE)
    gone = twice.select("t", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    done = written(partly.unionAll(gone), "removed")
    rows = each.select("_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), digest("text").alias("t"))
    joined = rows.join(done, "t", "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return joined.select(F.col("_key").alias(key), "n_bytes", removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: The same in SQL, by the hash of every string.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
s AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
m AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM m),
span AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY r, g),
cut AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
piece AS (SELECT r, before + 1 AS a, a - 1 AS z FROM cut UNION ALL SELECT r, max(z) + 1, 2147483647 FROM cut GROUP BY r),
kept AS (SELECT r, unhex(string_agg(CASE WHEN z < a THEN '' ELSE hex(b[a:z]) END, '' ORDER BY a)) AS b FROM piece JOIN d USING (r) GROUP BY r),
n AS (SELECT r, count(*) AS n_spans, sum(z - a + 1)::bigint AS n_removed FROM span GROUP BY r)
SELECT doc_id, octet_length(d.b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept.b, d.b)) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
