"""Near duplicates by SimHash, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a word of
the perfect binary Golay code of length 23. A word is near at most six codewords: the one within
distance 3 and, if that distance is 3, five more at distance 4. Two words that differ in two bits
or fewer always share one of these codewords. Of four or fewer errors in three segments, either

* one segment has none and another one at most two: the key is the whole first segment and a
  codeword of the second, or
* every segment has one or two: the key is one codeword of each segment.

So fingerprints that differ in at most four bits always share a key. Rows with one key are
compared exactly, and connected components are made of what links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import file_count, files_for, ship, twice_the_cores, written

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of one key that are compared at once; larger groups are compared block by block.
BLOCK = 512
#: Keys with more rows are dealt to several tasks as pairs of parts of half as many rows.
LARGE = 16_384
#: Rows of small tables that share a file, rows with their texts that do, and posted rows that share a task.
LINKS_PER_FILE, ROWS_PER_FILE, POSTED_PER_TASK = 250_000, 10_000, 500_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
        starts = np.concatenate([[0], ends + 1])[: len(words) - SHINGLE + 1].tolist()
        ends = np.append(ends, len(whole))[SHINGLE - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[s:e], SEED) for s, e in zip(starts, ends, strict=True)]
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[s : s + (1 << 16)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints_of(text: str) -> Column:
    """The 64 bits as a signed number; null and empty texts have 0."""

    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return fp(F.col(text))


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (bigint: the 64 bits as a signed number) of every row; null and empty texts have 0."""
    return docs.select(F.col(key), fingerprints_of(text).alias("fp"))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For every 23-bit word: its nearest codeword's index, and the row of its further codewords (see `_near`)."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    data = np.arange(4096, dtype=np.int64)
    rest = data << 11
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (generator << (bit - 11)), rest)
    codewords = (data << 11) | rest
    errors = np.array([0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i in range(23) for j in range(i)), *((1 << i) | (1 << j) | (1 << k) for i in range(23) for j in range(i) for k in range(j))], np.int64)
    nearest, away = np.zeros(1 << 23, np.int16), np.zeros(1 << 23, np.int32)
    for e in errors:
        nearest[codewords ^ e] = data
        away[codewords ^ e] = e
    return nearest, away


@cache
def _octads() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted error patterns of weight 3, and for each the five codewords of weight 7 that contain it."""
    nearest, _ = _golay()
    generator_words = np.flatnonzero(np.array([bin(int(c)).count("1") == 7 for c in _codewords()]))
    sevens = _codewords()[generator_words]
    patterns = np.array(sorted((1 << i) | (1 << j) | (1 << k) for i in range(23) for j in range(i) for k in range(j)), np.int64)
    holds = (sevens[None, :] & patterns[:, None]) == patterns[:, None]
    return patterns, sevens[np.nonzero(holds)[1].reshape(len(patterns), 5)], nearest


@cache
def _codewords() -> np.ndarray:
    nearest, away = _golay()
    zero = np.flatnonzero(away == 0)
    out = np.zeros(4096, np.int64)
    out[nearest[zero]] = zero
    return out


def _near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 codeword indices, n x 6 mask): all codewords within distance 4 of each 23-bit word."""
    nearest, away = _golay()
    patterns, sevens, _ = _octads()
    first, error = nearest[words].astype(np.int64), away[words].astype(np.int64)
    out = np.repeat(first[:, None], 6, 1)
    far = np.bitwise_count(error) == 3
    base = _codewords()[first[far]]
    # the code is linear: codewords around the word are those around the error pattern, shifted
    out[far, 1:] = nearest[base[:, None] ^ sevens[np.searchsorted(patterns, error[far])]]
    mask = np.zeros((len(words), 6), bool)
    mask[:, 0] = True
    mask[far, 1:] = True
    return out, mask


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of all keys of the fingerprints (uint64)."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [_near(p) for p in parts]
    rows, keys = [], []
    n = np.arange(len(fps))
    for x in range(3):
        for y in range(3):
            if x != y:
                codes, mask = near[y]
                key = (np.int64(x * 3 + y + 1) << 40) | (parts[x][:, None] << 12) | codes
                rows.append(np.repeat(n[:, None], 6, 1)[mask])
                keys.append(key[mask])
    (a, ma), (b, mb), (c, mc) = near
    key = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    mask = ma[:, :, None, None] & mb[:, None, :, None] & mc[:, None, None, :]
    rows.append(np.repeat(n, 216).reshape(mask.shape)[mask])
    keys.append(key[mask])
    return np.concatenate(rows), np.concatenate(keys)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
        for s in range(0, len(fps), 2048):
            rows, keys = keys_of(fps[s : s + 2048].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[s + rows]), pa.array(nodes[s + rows])], ["k", "fp", "node"])


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links nodes[a]-nodes[b], as links of each node with the least of its component."""
    used, at = np.unique(np.concatenate([nodes[a], nodes[b]]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(used))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(used))
    return used[label[other]], used[other]


def _dense_stars(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links between two blocks of fingerprints (rows of x, then of y), as stars of row numbers."""
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= distance
    label = np.arange(len(x) + len(y), dtype=np.int32)
    none = np.int32(len(label))
    while True:
        left, right = label[: len(x)], label[len(x) :]
        new = np.concatenate([np.minimum(left, np.where(near, right[None, :], none).min(1)), np.minimum(right, np.where(near, left[:, None], none).min(0))])
        if (new == label).all():
            other = np.flatnonzero(label != np.arange(len(label)))
            return label[other].astype(np.int64), other
        label = new


class _Found:
    """Links as pairs of row numbers; what they connect is kept in few of them."""

    def __init__(self, most: int = 200_000):
        self.parts, self.many, self.most = [], 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.many += len(a)
        if self.many > self.most:
            self.parts = [self.stars()]
            self.many = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.many)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        return _stars(np.arange(max(a.max(initial=0), b.max(initial=0)) + 1), a, b)


def _links(batches: Iterator[pa.RecordBatch], distance: int, large: int, rows_at_once: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: links (lo, hi) that connect what every key's near rows connect.

    Rows of keys with over `large` rows come out as they went in (node as lo, k and fp), to be dealt
    anew. So memory is bounded by `rows_at_once` and BLOCK squared, whatever the keys.
    """
    kept, passing = [np.zeros(0, np.int64)] * 3, None

    def linked(lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(lo), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), none, none], ["lo", "hi", "k", "fp"])

    def passed(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(keys), pa.int64()), pa.array(keys), pa.array(fps.view(np.int64))], ["lo", "hi", "k", "fp"])

    def found(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        few = 32
        small = np.repeat(sizes <= few, sizes)
        links = _Found()
        for d in range(1, few):
            left = np.flatnonzero(small[:-d] & (keys[d:] == keys[:-d])) if d < len(keys) else np.zeros(0, np.int64)
            if not len(left):
                break
            left = left[np.bitwise_count(fps[left] ^ fps[left + d]) <= distance]
            links.add(left, left + d)
        for s, n in zip(starts[sizes > few], sizes[sizes > few], strict=True):
            if n > large:
                yield passed(keys[s : s + n], fps[s : s + n], nodes[s : s + n])
                continue
            for i in range(s, s + n, BLOCK):
                for j in range(s, i + 1, BLOCK):
                    x, y = (np.arange(k, min(k + BLOCK, s + n)) for k in (i, j))
                    rows = np.concatenate([x, y])
                    a, b = _dense_stars(fps[x], fps[y], distance)
                    a, b = rows[a], rows[b]
                    links.add(a[a != b], b[a != b])
        if links.many:
            a, b = links.stars()
            yield linked(np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b]))

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "fp", "node")]
        if not len(columns[0]):
            continue
        kept = [np.concatenate([x, y]) for x, y in zip(kept, columns, strict=True)]
        if passing is not None:  # more rows of a large key
            more = np.searchsorted(kept[0], passing, side="right")
            if more:
                yield passed(kept[0][:more], kept[1][:more], kept[2][:more])
                kept = [x[more:] for x in kept]
            if not len(kept[0]):
                continue
            passing = None
        if len(kept[0]) < rows_at_once:
            continue
        whole = np.searchsorted(kept[0], kept[0][-1])  # the last key may go on
        if whole:
            yield from found(kept[0][:whole], kept[1][:whole].view(np.uint64), kept[2][:whole])
            kept = [x[whole:] for x in kept]
        if len(kept[0]) > large:
            passing = kept[0][0]
            yield passed(*kept)
            kept = [x[:0] for x in kept]
    if len(kept[0]):
        yield from found(kept[0], kept[1].view(np.uint64), kept[2])


LINKED = "lo long, hi long, k long, fp long"


def links(nodes: DataFrame, *, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """Links (lo, hi) among rows (node, fp), one row for each distinct fp, within `distance` bits.

    Not every close pair is listed, but whatever close pairs connect, the links connect. A key with
    over `large` rows is cut into parts by the hash of its rows, and each pair of parts is a group of
    its own, so that no task has more than `large` rows or so of one key.
    """
    if distance > DISTANCE:
        raise ValueError("the keys find pairs of up to 4 differing bits")
    ship(nodes.sparkSession)
    posted = nodes.mapInArrow(_post, "k long, fp long, node long")
    dealt = posted.repartition("k").sortWithinPartitions("k")
    tasks = files_for(183 * nodes.count(), POSTED_PER_TASK, twice_the_cores(nodes.sparkSession))
    found = written(dealt.mapInArrow(lambda batches: _links(batches, distance, large), LINKED), "key-links", files=tasks)
    over = found.where("k is not null")
    sizes = over.groupBy("k").agg((F.floor(F.count("*") / (large / 2)) + 1).cast("int").alias("parts"))
    parted = over.join(sizes, "k").withColumn("part", F.pmod(F.xxhash64("lo"), F.col("parts")).cast("int"))
    paired = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other != part")
    group = F.xxhash64("k", F.least("part", "other"), F.greatest("part", "other"))
    again = paired.select(group.alias("k"), "fp", F.col("lo").alias("node")).repartition("k").sortWithinPartitions("k")
    rest = again.mapInArrow(lambda batches: _links(batches, distance, 1 << 40), LINKED)
    return found.where("k is null").select("lo", "hi").unionAll(rest.select("lo", "hi")).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component: the least node it reaches) for every node of the links (lo, hi), of which there are about `rows`.

    Alternates large-star and small-star rounds; each round is one table in the shared folder, so
    that no lineage grows. A hub with many neighbours is only ever grouped for its minimum.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("lo", "hi").union(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select("lo", F.least("m", "lo").alias("m"))
        return both.join(least, "lo").where("hi > lo").select(F.col("m").alias("lo"), "hi").where("lo != hi").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = e.join(least, "hi")
        return joined.select(F.col("m").alias("lo"), "hi").union(joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).where("lo != hi").distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        return tuple(r)

    now = written(edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo != hi").distinct(), "links", files=None if rows is None else files_for(rows, LINKS_PER_FILE))
    before = mark(now)
    for _ in range(most_rounds):
        now = written(small(large(now)), "stars", files=files_for(before[0], LINKS_PER_FILE))  # about as many links as before
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def groups(fps: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """(fp, component: the least fp it reaches) for every different fp. Fingerprints are the nodes, so ids play no part."""
    least = twice_the_cores(fps.sparkSession)
    nodes = written(fps.select("fp").distinct().withColumn("node", F.col("fp")), "nodes", files=files_for(fps.count(), LINKS_PER_FILE, least))
    found = components(links(nodes, distance=distance), rows=nodes.count())
    return nodes.join(found, "node", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (the smallest key reachable) of every row.

    Copies share a fingerprint and count once from then on. Texts without words have the
    fingerprint 0, which is linked like any other. Rows with a null key are linked like others, but
    name no component: one that has only such rows has a null component_id.
    """
    fps = written(fingerprints(docs, text=text, key=key).withColumnRenamed(key, "key"), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("key").alias("least"))
    found = written(groups(fps, distance=distance).join(least, "fp"), "groups")
    names = found.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = fps.join(found.join(names, "component").select("fp", "component_id"), "fp", "left")
    return joined.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that with the smallest doc_id; all columns stay.

    Verdicts go by the row, not by its doc_id: different texts under one id are different
    documents. Of several rows with that id the first by the hash of all columns stays; rows
    without a doc_id are compared like others and come last.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64(*docs.columns).alias("_hash"), F.monotonically_increasing_id().alias("_id"))
    hashed = written(rows.withColumn("fp", fingerprints_of("text")).drop("text"), "rows", files=file_count(docs, ROWS_PER_FILE))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_id")
    least = hashed.groupBy("fp").agg(F.min(rank).alias("least"))
    first = groups(hashed, distance=distance).join(least, "fp").groupBy("component").agg(F.min("least").alias("least"))
    kept = hashed.join(first.select(F.col("least._id").alias("_id")), "_id", "left_semi").select("_row.*")
    return kept.coalesce(files_for(hashed.count(), ROWS_PER_FILE, twice_the_cores(docs.sparkSession)))
