"""Packing of documents into sequences by bin completion.

The plan is made on the histogram of piece lengths, which has at most as many rows as a sequence
has tokens, however many documents there are. Around the largest length that is left, undominated
fillings of the rest of the sequence are tried, least waste first; each is repeated as often as its
lengths allow, then less often. A partial plan is dropped once its waste shows that it can't beat the best
plan known, which at first is best-fit decreasing on the same histogram. The plan says which
lengths stand together how often; rows take their places in it by their rank among the rows of
their length, which Spark counts in salted groups.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import file_count, files_for, twice_the_cores, written

CAPACITY = 2048
END_ID = 0
#: Bytes of Latin-1 texts that can be cut into words before the tokenizer sees them: none of these
#: characters changes under NFC, and the lower case of each is one of them wherever it stands.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
#: The tokenizer's own pattern for words, restated for lower-case Latin-1 without white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
#: Fixed value: how the vocabulary marks the last token of a word.
WORD_END = "</w>"


class Encoder:
    """Token ids of whole texts, as the tokenizer file gives them without special tokens.

    The tokenizer never looks across white space or from word to word, and words repeat. So ids are
    remembered, up to `most` runs between white space and `most` words; what isn't known goes to the
    tokenizer, all words of a text at once. Texts with other than PLAIN characters go there whole, and so
    do texts that contain an added token, which the tokenizer takes out before it looks for words.
    """

    def __init__(self, file: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.added = sorted({x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(WORD_END)]] = True
        self.cut = re.compile(WORD).findall
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _resolve(self, runs: set[str]) -> dict[str, bytes]:
        """The ids of runs that aren't known yet."""
        cut = {r: self.cut(r) for r in runs}
        new = sorted({w for words in cut.values() for w in words if w not in self.words})
        found = {}
        if new:
            ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(new):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                found = {w: raw[at[i] : at[i + 1]] for i, w in enumerate(new)}
            else:  # a word without an end mark: ask for each
                found = {w: self.raw(w) for w in new}
            if len(self.words) < self.most:
                self.words.update((w, x) for w, x in found.items() if len(w) <= 64)
        known = self.words
        out = {r: b"".join([found[w] if w in found else known[w] for w in words]) for r, words in cut.items()}
        if len(self.runs) < self.most:
            self.runs.update((r, x) for r, x in out.items() if len(r) <= 64)
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text.isascii():
            try:
                odd = text.encode("latin-1").translate(None, PLAIN)
            except UnicodeEncodeError:
                odd = b"?"
        else:
            odd = text.encode().translate(None, PLAIN)
        if odd:
            return self.raw(text)
        low = text.lower()
        if any(x in low for x in self.added):
            return self.raw(text)
        runs = low.split()
        got = list(map(self.runs.get, runs))
        if None in got:
            new = self._resolve({r for r, x in zip(runs, got, strict=True) if x is None})
            got = [new[r] if x is None else x for r, x in zip(runs, got, strict=True)]
        return b"".join(got)


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The encoder of this Python worker for `file`."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32: every document as ids and a closing id 0, cut where it is longer than `capacity`."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(tokenizer)).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column("text")):
                ids = memoryview(encode(t.as_py() or "") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32"],
            )

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


@dataclass
class Pattern:
    """A filling, by length how many, and how many sequences have it."""

    fill: dict[int, int]
    times: int


def _best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best-fit decreasing: every length goes to the tightest open sequence that it fits, or opens one.

    What one length leaves of a sequence is the tightest place for the next of the same length, so
    it fills a sequence as often as it fits before another is taken, and equal sequences go together.
    """
    open_: dict[int, list[tuple[tuple, int]]] = {capacity: []}  # by room: contents and how many
    rooms: list[int] = []

    def put(room: int, fill: tuple, times: int) -> None:
        if room not in open_ or not open_[room]:
            open_[room] = []
            if room < capacity:
                insort(rooms, room)
        open_[room].append((fill, times))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                fill, times = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, fill, times = capacity, (), n
            per = min(room // x, n)
            used = min(times, n // per)
            put(room - per * x, (x, per, fill), used)
            if times > used and fill:
                put(room, fill, times - used)
            n -= per * used
    plan = []
    for groups in open_.values():
        for fill, times in groups:
            found = {}
            while fill:
                x, per, fill = fill
                found[x] = per
            plan.append(Pattern(found, times))
    return plan


def _fillings(left: dict[int, int], lengths: list[int], capacity: int) -> Iterator[dict[int, int] | None]:
    """All undominated fillings around the largest length left, least waste first; None for each dominated one passed.

    By sums of lengths that bounded numbers of them reach (as bits), so every step of the
    enumeration ends in a filling. Of one sum the fillings of larger lengths come first.
    """
    largest = lengths[-1]
    rest = capacity - largest
    own = lengths[: bisect_right(lengths, rest)]
    many = [min(left[x] - (x == largest), rest // x) for x in own]
    everything = (1 << (rest + 1)) - 1
    reach, bits = [1], 1
    for x, n in zip(own, many, strict=True):
        step = 1
        while n and bits != everything:
            step = min(step, n)
            bits |= (bits << step * x) & everything
            n, step = n - step, 2 * step
        reach.append(bits)

    def exact(i: int, total: int) -> Iterator[tuple]:
        """Fillings of just `total` from the first i lengths, as (length, how many, ...)."""
        if not total:
            yield ()
            return
        for j in range(min(i, bisect_right(own, total)) - 1, -1, -1):
            if not reach[j + 1] >> total & 1:
                return
            x = own[j]
            for n in range(min(many[j], total // x), 0, -1):
                if reach[j] >> (total - n * x) & 1:
                    for more in exact(j, total - n * x):
                        yield (x, n, *more)

    others = sum(1 << x for x in own)
    for waste in range(rest + 1):
        if not bits >> (rest - waste) & 1:
            continue
        for found in exact(len(own), rest - waste):
            fill = dict(zip(found[::2], found[1::2], strict=True))
            # lengths that aren't in it, and sums of one and of several of those that are
            out = others
            for x, n in fill.items():
                if left[x] - (x == largest) == n:
                    out ^= 1 << x
            if largest <= rest and left[largest] == 1:
                out &= ~(1 << largest)
            one = several = 0
            for x, n in fill.items():
                for _ in range(n):
                    several |= several << x | one << x
                    one |= 1 << x
            # dominated: a length outside could stand for some inside that are no longer together
            near, span, wide = several, 1 | one | several, 1
            while wide < waste:
                more = min(wide, waste - wide)
                span, wide = span | span << more, wide + more
            if waste:
                near |= span << 1
            if out & near:
                yield None
                continue
            fill[largest] = fill.get(largest, 0) + 1
            yield fill


@dataclass
class _Step:
    """A place of the search: fillings tried around one largest length, and the one in use."""

    fillings: Iterator | None
    waste: int
    barred: tuple  # fillings of the same largest length whose number is settled
    passed: int = 0  # fillings taken from the iterator
    fill: dict[int, int] | None = None
    times: int = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY, *, most_nodes: int = 20_000) -> list[Pattern]:
    """A plan for a histogram of lengths (1 to `capacity`).

    Searches depth first over all undominated fillings of the largest length left and over how often
    each is used, most often first, with at most `most_nodes` steps (and ten times as many fillings
    passed as dominated); the best plan so far stands when they run out. The bound: no plan has fewer
    sequences than ceil(tokens / capacity), so a partial plan may waste no more than the best plan's
    sequences less one can hold beyond the tokens.
    """
    left = {x: n for x, n in counts.items() if n}
    tokens = sum(x * n for x, n in left.items())
    best = _best_fit(Counter(left), capacity)
    best_n, least = sum(p.times for p in best), -(-tokens // capacity)
    if best_n == least:
        return best
    lengths = sorted(left)
    nodes = looks = 0
    path = [_Step(_fillings(left, lengths, capacity), 0, ())]

    def use(fill: dict[int, int], times: int) -> None:
        for x, n in fill.items():
            before = left.get(x, 0)
            left[x] = before - n * times
            if not left[x]:
                del left[x]
                lengths.pop(bisect_left(lengths, x))
            elif not before:
                insort(lengths, x)

    while path and best_n > least and nodes < most_nodes and looks < 10 * most_nodes:
        step = path[-1]
        allowed = (best_n - 1) * capacity - tokens
        if step.fill is not None:
            use(step.fill, -step.times)
            step.times -= 1
        if not step.times:
            if step.fillings is None:  # it was let go: find its place again
                step.fillings = _fillings(left, lengths, capacity)
                for _ in range(step.passed):
                    next(step.fillings)
            step.fill = None
            while step.fill is None or step.fill in step.barred:
                looks += 1
                step.passed += 1
                step.fill = next(step.fillings, False)
                if step.fill is False or looks >= 10 * most_nodes:
                    break
            if not step.fill:
                path.pop()
                continue
            step.times = min(left[x] // n for x, n in step.fill.items())
        fill, lost = step.fill, capacity - sum(x * n for x, n in step.fill.items())
        if step.waste + lost > allowed:  # so does every later filling
            path.pop()
            continue
        step.times = min(step.times, (allowed - step.waste) // lost) if lost else step.times
        nodes += 1
        largest = lengths[-1]
        use(fill, step.times)
        if not lengths:
            best = [Pattern(dict(p.fill), p.times) for p in path]
            best_n = sum(p.times for p in path)
            continue
        barred = (*step.barred, fill) if lengths[-1] == largest else ()
        path.append(_Step(_fillings(left, lengths, capacity), step.waste + lost * step.times, barred))
        if len(path) > 64:  # their sums of lengths take memory
            path[-65].fillings = None
    return best


class Places:
    """Where the row of a given length and rank (from 0) stands: sequence and offset."""

    def __init__(self, patterns: list[Pattern], capacity: int = CAPACITY):
        at: dict[int, int] = {}
        rows, first = [], 0
        for p in patterns:
            offset = 0
            for x in sorted(p.fill, reverse=True):
                n = p.fill[x]
                rows.append((x, at.get(x, 0), n, first, offset))
                at[x] = at.get(x, 0) + n * p.times
                offset += n * x
            first += p.times
        rows.sort()
        self.length, self.start, self.per, self.first, self.offset = np.array(rows, np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = np.int64(1 << 44)
        at = np.searchsorted(self.length * step + self.start, length * step + rank, side="right") - 1
        i = rank - self.start[at]
        return self.first[at] + i // self.per[at], self.offset[at] + i % self.per[at] * length


def ranks(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `rank`: from 0, without gaps, in each group of equal `group`, however large one is.

    Rows are dealt to salts by the hash of `order`, as many as the root of the largest group's rows,
    so neither a salt nor the list of salts grows as that group does. Ranks within a salt and sums
    over the salts before it make the rank.
    """
    top = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, math.isqrt(top))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inside = Window.partitionBy(group, "_salt").orderBy(*order)
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(sizes.drop("_n"), [group, "_salt"]).withColumn("rank", F.col("_in") + F.col("_before")).drop("_salt", "_in", "_before")


def place(rows: DataFrame, *, capacity: int = CAPACITY, length: str = "length", order: list[str]) -> DataFrame:
    """`rows` with sequence_id and offset. Each sequence has at most `capacity` tokens and no gaps.

    To the driver comes the histogram of lengths: at most `capacity` rows.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(length).agg(F.count("*")).collect()}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    places = rows.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity), capacity))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def find(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        sequence, offset = places.value.find(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    ranked = ranks(rows, length, order).withColumn("_place", find(F.col(length), F.col("rank")))
    return ranked.select(*rows.columns, "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one closing id. Rows that repeat a doc_id are packed each.
    """
    cut = written(pieces(docs, tokenizer=tokenizer, capacity=capacity), "pieces", files=file_count(docs))
    placed = place(cut, capacity=capacity, order=["doc_id", "piece", "ids_crc32", "start"])
    return placed.coalesce(files_for(cut.count(), 100_000, twice_the_cores(docs.sparkSession)))
