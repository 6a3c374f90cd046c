"""Phrases of two to four words that occur together more often than apart, by sorted count streams.

Phrases are counted order by order; before an order is counted, whatever holds a part that is too rare is
left out, which a table of bits of bounded size tells (a "maybe" only costs work). The frequent phrases
of all orders then form one stream of counts. It is laid out twice, by the words from the first and by
the words from the last, in parts cut by sampled splitters. A walk over a sorted part holds
the counts of all beginnings of the phrase it is at, as they come just before it: in prefix order
these are the left parts of every cut, in suffix order the right parts, and what follows a phrase
directly are its extensions to the right or to the left. A part that begins inside a phrase gets the
counts of the beginnings of its splitter, three at most.

Null texts are empty; a null language is `und`. Phrases never cross a separator. Equal rows count as often as they
occur, and so do overlapping occurrences. Ties of score go to the higher count, then to the phrase first in byte
order. Tables without words give no rows. Texts of any length are read whole; other columns
aren't read. Memory of a task is bounded by the text of a chunk, and by the depth of a phrase in a walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from punctual.llm.common import ship, written
from punctual.llm.ranges import bit_table, mixed, parts_for, shard_of, splitters

LONGEST = 4
LEAST = 30
SHADOW = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
#: Fixed values of the contract: letters that are lowered, and the bytes that end a piece.
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
#: Characters of text that are counted at once in a task.
CHUNK = 2 << 20
#: Rows of a batch that goes back to Spark.
ROWS = 20_000
COUNTED = "lang string, phrase string, size int, n long"


class Words:
    """The words of some texts of one language: codes of `names` in order, and the piece that each stands in."""

    def __init__(self, lang: str, texts: list[str]):
        raw = "\n".join(texts).encode().translate(CLEAN)
        pieces = pc.list_flatten(pc.split_pattern(pa.array([raw], pa.large_binary()).cast(pa.large_string()), "\n"))
        split = pc.ascii_split_whitespace(pieces)
        words, parents = pc.list_flatten(split), pc.list_parent_indices(split)
        some = pc.greater(pc.binary_length(words), 0)
        coded = words.filter(some).dictionary_encode()
        self.lang, self.names = lang, coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.pieces = parents.filter(some).to_numpy()
        self.same = self.pieces[1:] == self.pieces[:-1]  # the next word is of the same piece

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(f"{self.lang}\0{w}") for w in self.names.to_pylist()], np.uint64)

    def rows(self, ids: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(n), ROWS):
            yield self._row([x[s : s + ROWS] for x in ids], n[s : s + ROWS])

    def _row(self, ids: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        words = [self.names.take(pa.array(x)) for x in ids]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", words[0].type)) if len(words) > 1 else words[0]
        m = len(n)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * m, pa.string()), phrase.cast(pa.string()), pa.array(np.full(m, len(ids), np.int32)), pa.array(n)], ["lang", "phrase", "size", "n"])


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(3) + right)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if text := value.as_py():
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if sum(size.values()) > CHUNK:
                    most = max(size, key=size.get)
                    yield Words(most, held.pop(most))
                    del size[most]
                    pa.default_memory_pool().release_unused()
    for lang, texts in held.items():
        yield Words(lang, texts)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True, return_counts=True)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words in _chunks(batches):
        n = np.bincount(words.codes, minlength=len(words.names))
        yield from words.rows([np.arange(len(n))], n)


def _pairs(batches: Iterator[pa.RecordBatch], singles) -> Iterator[pa.RecordBatch]:
    for words in _chunks(batches):
        often = singles.value.may_hold(words.hashes())[words.codes]
        at = np.flatnonzero(words.same & often[:-1] & often[1:])
        keys, _, n = _distinct(words.codes[at] << 32 | words.codes[at + 1])
        yield from words.rows([keys >> 32, keys & 0xFFFFFFFF], n)


def _longer(batches: Iterator[pa.RecordBatch], singles, pairs) -> Iterator[pa.RecordBatch]:
    """Phrases of three and more words all of whose pairs may be frequent."""
    for words in _chunks(batches):
        hashes, codes = words.hashes(), words.codes
        often = singles.value.may_hold(hashes)[codes]
        at = np.flatnonzero(words.same & often[:-1] & often[1:])
        keys, which, _ = _distinct(codes[at] << 32 | codes[at + 1])
        left, right = keys >> 32, keys & 0xFFFFFFFF
        good = pairs.value.may_hold(pair_hashes(hashes[left], hashes[right]))
        id_at = np.full(len(codes) + LONGEST, -1, np.int64)  # of the phrase that begins at a word
        id_at[at] = np.where(good[which], which, -1)
        pair_at, ids = id_at.copy(), [left, right]
        for size in range(3, LONGEST + 1):
            at = np.flatnonzero((id_at[: len(codes)] >= 0) & (pair_at[size - 2 : size - 2 + len(codes)] >= 0))
            keys, which, n = _distinct(id_at[at] << 32 | codes[at + size - 1])
            ids = [x[keys >> 32] for x in ids] + [keys & 0xFFFFFFFF]
            yield from words.rows(ids, n)
            id_at[:] = -1
            id_at[at] = which


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
            out.append([xxhash.xxh64_intdigest(f"{lang}\0{w}") for w in phrase.split(" ")])
        words = np.array(out, np.uint64)
        if len(words):
            yield pa.RecordBatch.from_arrays([pa.array((words[:, 0] if words.shape[1] == 1 else pair_hashes(words[:, 0], words[:, 1])).view(np.int64))], ["h"])


def counts(docs: DataFrame, *, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of up to LONGEST words that occur `least` times, and (lang, n): all words of a language."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))

    def total(counted: DataFrame) -> DataFrame:
        # chunks are summed up where they are read; another table of sums in each of those tasks would hardly find two alike
        return counted.repartition("lang", "phrase", "size").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))

    def table_of(frequent: DataFrame):
        return bit_table(frequent.select("lang", "phrase").mapInArrow(_hashed, "h long"), "h", frequent.count())

    # rare words are written summed up to one row a language, so that no word is counted twice
    single = total(texts.mapInArrow(_single, COUNTED))
    rare = F.col("n") < least
    kept = written(single.groupBy("lang", F.when(~rare, F.col("phrase")).alias("phrase")).agg(F.sum("n").alias("n")).withColumn("size", F.lit(1)), "words")
    words = kept.groupBy("lang").agg(F.sum("n").alias("n"))
    one = kept.where("phrase is not null").select("lang", "phrase", "size", "n")
    singles = table_of(one)
    two = written(total(texts.mapInArrow(lambda b: _pairs(b, singles), COUNTED)).where(~rare), "pairs")
    pairs = table_of(two)
    more = written(total(texts.mapInArrow(lambda b: _longer(b, singles, pairs), COUNTED)).where(~rare), "phrases")
    return one.unionByName(two).unionByName(more), words


WALKED = "lang string, phrase string, size int, n long, before array<long>, ext long"


def _walk(batches: Iterator[pa.RecordBatch], cuts: list[tuple], carried: dict[tuple, int], back: bool) -> Iterator[pa.RecordBatch]:
    """Over rows (shard, lang, phrase, size, n) sorted by shard, language and words: each phrase with the counts of its
    beginnings, shortest first, and the largest count of a phrase that is one word longer at its end.

    Of beginnings of the splitter of a part only the extensions seen in it come out, with no count of their own.
    """
    out: list[tuple] = []
    stack: list[list] = []  # (word, n, ext, whether its row stands in an earlier part)
    shard = lang = None

    def close(depth: int) -> None:
        while len(stack) > depth:
            _, n, ext, earlier = stack[-1]
            words = [x[0] for x in stack]
            phrase = " ".join(reversed(words) if back else words)
            if not earlier:
                out.append((lang, phrase, len(stack), n, [x[1] for x in stack[:-1]], ext))
            elif ext:
                out.append((lang, phrase, len(stack), None, None, ext))
            stack.pop()

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "phrase", "size", "n", "before", "ext"])

    for b in batches:
        for s, own, phrase, n in zip(*(b.column(c).to_pylist() for c in ("shard", "lang", "phrase", "n")), strict=True):
            words = phrase.split(" ")
            if back:
                words.reverse()
            if s != shard or own != lang:
                close(0)
                if s != shard and s and cuts[s - 1][0] == own.encode():
                    cut = cuts[s - 1]
                    stack += [[cut[d].decode(), carried[cut[: d + 1]], 0, True] for d in range(1, len(cut) - 1)]
                shard, lang = s, own
            same = 0
            while same < len(stack) and same < len(words) and stack[same][0] == words[same]:
                same += 1
            close(same)
            # all beginnings of a frequent phrase are frequent, so they stand on the stack
            assert same == len(words) - 1, (lang, words)
            if stack:
                stack[-1][2] = max(stack[-1][2], n)
            stack.append([words[-1], n, 0, False])
        if len(out) > 10_000:
            yield batch()
    close(0)
    if out:
        yield batch()


def stream(frequent: DataFrame, *, back: bool, rows: int, per_part: int = 200_000) -> DataFrame:
    """The walk over the count stream in prefix order, or in suffix order if `back`."""
    parts = parts_for(rows, per_part, frequent.sparkSession)

    def key(r: tuple) -> tuple:
        words = r[1].split(" ")
        return (r[0].encode(), *(w.encode() for w in (reversed(words) if back else words)))

    cuts = splitters(frequent, ["lang", "phrase"], parts, key)
    wanted = {c[:d] for c in cuts for d in range(2, len(c))}  # at most three a splitter
    carried: dict[tuple, int] = {}
    if wanted:
        phrases = [(w[0].decode(), " ".join(x.decode() for x in (reversed(w[1:]) if back else w[1:]))) for w in wanted]
        few = frequent.sparkSession.createDataFrame(phrases, "lang string, phrase string")
        carried = {key((r["lang"], r["phrase"])): r["n"] for r in frequent.join(F.broadcast(few), ["lang", "phrase"]).select("lang", "phrase", "n").collect()}

    @F.arrow_udf("int")
    def shard(langs: pa.Array, phrases: pa.Array) -> pa.Array:
        return pa.array([shard_of(key(x), cuts) for x in zip(langs.to_pylist(), phrases.to_pylist(), strict=True)], pa.int32())

    split = F.split("phrase", " ")
    words = F.reverse(split) if back else split
    dealt = frequent.withColumn("shard", shard("lang", "phrase")).repartitionById(len(cuts) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "lang", *[F.get(words, k).asc_nulls_first() for k in range(LONGEST)])
    return ordered.select("shard", "lang", "phrase", "n").mapInArrow(lambda b: _walk(b, cuts, carried, back), WALKED)


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a / (left + right)) in exact whole numbers."""
    product = a.cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", product, left.cast("decimal(19,0)") + right.cast("decimal(19,0)"))


def collocations(docs: DataFrame, *, least: int = LEAST, shadow: int = SHADOW, top: int = TOP, scale: int = SCALE, per_part: int = 200_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of every language.

    A phrase whose words stand in a longer one that makes up `shadow` in a hundred of its occurrences is dropped: an extension by
    several words has no more occurrences than those by one word inside it, so one word is looked at.
    """
    frequent, words = counts(docs, least=least)
    frequent = written(frequent, "frequent")
    rows = frequent.count()
    ahead, behind = (stream(frequent, back=b, rows=rows, per_part=per_part) for b in (False, True))
    both = ahead.withColumn("lefts", F.col("before")).withColumn("rights", F.lit(None).cast("array<long>")).unionByName(behind.withColumn("lefts", F.lit(None).cast("array<long>")).withColumn("rights", F.col("before")))
    met = both.where("size > 1").groupBy("lang", "phrase", "size").agg(F.max("n").alias("a"), F.max("lefts").alias("lefts"), F.max("rights").alias("rights"), F.max("ext").alias("ext"))
    cuts = []
    for k in range(1, LONGEST):
        left, right = F.get("lefts", F.lit(k - 1)), F.get("rights", F.col("size") - 1 - k)
        cuts.append(F.when(F.col("size") > k, F.struct(_score(F.col("a"), left, right, scale).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    best = met.where(F.lit(100) * F.col("ext") < F.lit(shadow) * F.col("a")).withColumn("cut", F.array_min(F.array_compact(F.array(*cuts))))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


#: The same in SQL, by counting every phrase.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
s AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM s, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::bigint AS n FROM f WHERE k = 1 GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT *, unnest(range(1, k)) AS first FROM c),
parted AS (SELECT cut.lang, cut.phrase, cut.a, first, l.a AS l, r.a AS r, (2000000::hugeint * cut.a // (l.a + r.a))::bigint AS score FROM cut
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:first], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[first + 1:], ' ')),
best AS (SELECT * FROM parted QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, first) = 1),
inside AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang) WHERE coalesce(100 * most < 80 * a, true) QUALIFY rank <= 2000
"""
