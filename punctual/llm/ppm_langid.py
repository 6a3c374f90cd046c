"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of order 0 to 3 with frozen counts. A byte costs
-log2(n / (total + distinct)) bits in the longest known context that has seen it, plus
-log2(distinct / (total + distinct)) bits for every longer known context that has not
(escape method C); a byte that no context knows costs 8 bits more. The language with the
shortest code wins. Costs are whole 1/256 bits, so that sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import file_count, ship, unit_hash, written

UNKNOWN = "und"
ORDER = 3
SCALE = 256
BLOCK = 1 << 19


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and where each string starts (one more at the end)."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of four bytes and how often each is there; zeros stand before the text."""
    b = np.concatenate([np.zeros(ORDER, np.uint32), data.astype(np.uint32)])
    return np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of all parts and how often each is there."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


#: So many runs of a language are held before they are summed up, and so many sums before they are handed on.
HELD, SUMS = 1 << 20, 1 << 21


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def told(lang: str) -> pa.RecordBatch:
        keys, n = parts.pop(lang)[0]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        data, starts = _bytes_of(batch.column("text"))
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            found = _grams(data[starts[i] : starts[i + 1]])
            parts.setdefault(lang, []).append(found)
            sizes[lang] = sizes.get(lang, 0) + len(found[0])
            if sizes[lang] >= HELD:
                parts[lang], sizes[lang] = [_summed(parts[lang])], 0
                if len(parts[lang][0][0]) >= SUMS:
                    yield told(lang)
    for lang in sorted(parts):
        parts[lang] = [_summed(parts[lang])]
        yield told(lang)


def _classes(by: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """(class of each byte, classes). Class 0: the place before the text (and zero bytes); the last: bytes never seen."""
    seen = np.unique(np.concatenate([x[x > 0] for x in by]))
    classes = np.full(256, len(seen) + 1, np.int32)
    classes[0] = 0
    classes[seen] = np.arange(1, len(seen) + 1)
    return classes, len(seen) + 2


def _tree(by: list[np.ndarray], n: np.ndarray, shared: np.ndarray, shared_size: int, twos: np.ndarray, threes: np.ndarray, number2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of one language: (row of each numbered context, class of each byte, costs by row * classes + class, classes)."""
    classes, size = _classes(by)
    s = classes[by[3]]
    a, b, c = (shared[x].astype(np.int64) for x in by[:3])

    def level(context: np.ndarray, shorter_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts of one length, and their costs, given the rows of the next shorter ones."""
        nodes, at = np.unique(context, return_inverse=True)
        counts = np.bincount(at * size + s, weights=n, minlength=len(nodes) * size).reshape(-1, size).astype(np.float32)
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = -np.log2(counts / (total + kinds))
            escape = -np.log2(kinds / (total + kinds))
        return nodes, np.where(counts > 0, direct, shorter_row[nodes] + np.where(total > 0, escape, 0)).astype(np.float32)

    _, zero = level(np.zeros_like(c), np.full((1, size), 8, np.float32))
    nodes, one = level(c, np.broadcast_to(zero, (shared_size, size)))
    row1 = np.zeros(shared_size, np.int32)
    row1[nodes] = 1 + np.arange(len(nodes), dtype=np.int32)
    table = np.concatenate([zero, one])

    class Shorter:  # rows of contexts by the code of a longer one
        def __init__(self, rows: np.ndarray, rest: int):
            self.rows, self.rest = rows, rest

        def __getitem__(self, nodes: np.ndarray) -> np.ndarray:
            return table[self.rows[nodes % self.rest]]

    nodes, two = level(b * shared_size + c, Shorter(row1, shared_size))
    row2 = row1[twos % shared_size]
    row2[np.searchsorted(twos, nodes)] = len(table) + np.arange(len(nodes), dtype=np.int32)
    table = np.concatenate([table, two])
    rows = np.concatenate([row1, row2])
    nodes, three = level((a * shared_size + b) * shared_size + c, Shorter(rows[number2], shared_size * shared_size))
    row3 = rows[number2[threes % (shared_size * shared_size)]]
    row3[np.searchsorted(threes, nodes)] = len(table) + np.arange(len(nodes), dtype=np.int32)
    table = np.minimum(np.rint(np.concatenate([table, three]) * SCALE), 65535).astype(np.uint16)
    return np.concatenate([rows, row3]), classes, table.ravel(), size


@dataclass
class ContextTrees:
    """The counts of four-byte runs per language, and the cost tables made from them on first use.

    Each language has rows only for contexts of its own, as wide as its own bytes; a context that
    it lacks leads to the row of the longest shorter one that it has. So the tables grow with the
    nodes of the trees, not with all contexts times all languages.
    """

    langs: list[str]
    lang: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def build(self) -> tuple[np.ndarray, np.ndarray, int, list]:
        """(class of each byte, number of each three-class context, classes, for each language its `_tree`)."""
        if self.tables is not None:
            return self.tables
        by = [(self.gram >> s) & 255 for s in (24, 16, 8, 0)]
        classes, size = _classes(by)
        a, b, c = (classes[x].astype(np.int64) for x in by[:3])
        # all contexts have one number: of one byte, of two, of three
        twos, threes = np.unique(b * size + c), np.unique((a * size + b) * size + c)
        number2 = np.tile(np.arange(size, dtype=np.int32), size)
        number2[twos] = size + np.arange(len(twos), dtype=np.int32)
        number3 = np.tile(number2, size)
        number3[threes] = size + len(twos) + np.arange(len(threes), dtype=np.int32)
        trees = []
        for k in range(len(self.langs)):
            own = self.lang == k
            trees.append(_tree([x[own] for x in by], self.n[own], classes, size, twos, threes, number2))
        self.tables = classes, number3, size, trees
        return self.tables

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The code length of each text (data from starts[i] to starts[i + 1]) in each language, in 1/256 bits."""
        classes, number3, size, trees = self.build()
        out = np.zeros((len(starts) - 1, len(self.langs)), np.int64)
        padded = np.concatenate([np.zeros(ORDER, np.uint8), data])
        for s in range(0, len(data), BLOCK):
            e = min(s + BLOCK, len(data))
            c = classes[padded[s : e + ORDER]]
            at = (c[:-3] * size + c[1:-2]) * size + c[2:-1]
            own = data[s:e]
            begins = starts[np.searchsorted(starts, s - 2) : np.searchsorted(starts, e)] - s
            # a text doesn't see the one before it: third, second, first byte, later writes win
            for k in (2, 1, 0):
                x = begins + k
                x = x[(x >= 0) & (x < e - s)]
                at[x] = 0 if k == 0 else c[x + 2] if k == 1 else c[x + 1] * size + c[x + 2]
            contexts = number3[at]
            first = np.searchsorted(starts, s, side="right") - 1
            last = np.searchsorted(starts, e, side="left")
            cuts = np.maximum(starts[first:last] - s, 0)
            full = starts[first + 1 : last + 1] > np.maximum(starts[first:last], s)  # reduceat needs texts with bytes
            for k, (rows, own_classes, table, width) in enumerate(trees):
                places = rows.take(contexts) * np.int32(width) + own_classes.take(own)
                out[first:last, k][full] += np.add.reduceat(table.take(places), cuts[full], dtype=np.int64)
        return out


def drawn(docs: DataFrame, per_lang: int, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, text, place: at most `per_lang` different texts of each language, those with the least hashes, from 1 on.

    Copies count once, however many there are. Only rows whose hash is below a bound that lets through about four times as many texts
    are compared; the bound comes from an estimate of how many different texts a language has. Rows without text or
    language are never drawn; ties of the hash are equal texts.
    """
    hashed = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null and text != ''").withColumn("u", unit_hash("text"))
    rates = hashed.groupBy("lang").agg((F.lit(4.0 * per_lang) / F.approx_count_distinct("u")).alias("rate"))
    few = hashed.join(F.broadcast(rates), "lang").where(F.col("u") < F.col("rate"))  # one row for each language
    once = few.groupBy("lang", "u").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    return once.withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "text", "place")


def different(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, text, half (0 or 1, by the text's hash): all different texts of each language. Copies count once; rows without text or language have no part."""
    hashed = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null and text != ''").withColumn("u", F.xxhash64("text"))
    return hashed.groupBy("lang", "u").agg(F.first("text").alias("text")).select("lang", "text", F.pmod("u", F.lit(2)).alias("half"))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", docs_per_lang: int | None = 400) -> ContextTrees:
    """Learn the trees from a bounded sample: at most `docs_per_lang` different whole texts of each labelled language; see `drawn`. None: from all.

    Every byte run of these texts is kept. Every language with a text is learned. Rows without text or language teach nothing.
    What comes to the driver are the different runs of four bytes of each language, once with their counts.
    """
    return fit_drawn(different(docs, text=text, lang=lang) if docs_per_lang is None else drawn(docs, docs_per_lang, text=text, lang=lang))


def together(a: ContextTrees, b: ContextTrees) -> ContextTrees:
    """The trees of all that both were learned from."""
    langs = sorted({*a.langs, *b.langs})
    at = [np.array([langs.index(x) for x in t.langs], np.int64)[t.lang] if t.langs else t.lang for t in (a, b)]
    return ContextTrees(langs, np.concatenate(at), np.concatenate([a.gram, b.gram]), np.concatenate([a.n, b.n]))


def fit_drawn(sample: DataFrame) -> ContextTrees:
    ship(sample.sparkSession)
    found = sample.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return ContextTrees([], *(np.zeros(0, np.int64) for _ in range(3)))
    coded = found.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    order = np.array([langs.index(x) for x in names], np.int64)
    return ContextTrees(langs, order[coded.indices.to_numpy()], found.column("gram").to_numpy(), found.column("n").to_numpy())


def predict(docs: DataFrame, trees: ContextTrees, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and bits_per_byte, in one pass and without a shuffle.

    score (0 to 1) is the winner's share of 2^-bits over all languages, bits_per_byte the winner's
    code length. Whole texts are scored. `und`, score 0 and no bits: text is null or has no letter,
    or nothing was learned. Ties go to the language first in the alphabet. Columns of `docs` that
    have one of the three names are replaced.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang_pred: string, score: double, bits_per_byte: double>")
    def judge(texts: pa.Array) -> pa.Array:
        trees = held.value
        n = len(texts)
        none = np.ones(n, bool)
        best, share, rate = np.full(n, len(trees.langs)), np.zeros(n), np.zeros(n)
        if trees.langs and n:
            none = texts.is_null().to_numpy(zero_copy_only=False)
            data, starts = _bytes_of(texts.fill_null(""))
            lengths = trees.code_lengths(data, starts)
            least = lengths.min(1)
            best = np.where(none, best, lengths.argmin(1))
            share = np.where(none, 0, 1 / np.exp2(-np.minimum((lengths - least[:, None]) / SCALE, 1000)).sum(1))
            rate = least / SCALE / np.maximum(np.diff(starts), 1)
        names = pa.array([*trees.langs, UNKNOWN], pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(share), pa.array(rate, mask=none)], ["lang_pred", "score", "bits_per_byte"])

    # texts without a letter are handed over as null, so that Python needs no letter table of its own
    letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    found = docs.withColumn("_ppm", judge(letters))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    return found.select(*kept, "_ppm.lang_pred", "_ppm.score", "_ppm.bits_per_byte")


def held_out(key: str = "doc_id", rest: int = 2):
    """Whether a row is never learned from: crc32 of the key as text, modulo 4. A null key has no remainder: false."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == rest, F.lit(False))


def identify(docs: DataFrame, *, docs_per_lang: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every document; learned from the rows not held out."""
    trees = fit(docs.where(~held_out()), docs_per_lang=docs_per_lang)
    out = predict(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


#: A text of a known language needs at most so many times the bits a byte that nearly all others of it need, and some bits more if it is short.
SLACK, SHORT_BITS = 2.75, 96.0


def usual_bits(others: list[tuple[DataFrame, ContextTrees]], share: float = 0.99) -> dict[str, float]:
    """For each learned language the bits a byte, to three digits, that `share` of the texts need, each by trees that weren't learned from it; of texts of 100 bytes and more.

    Of several sets of texts the least such figure counts, so that a few odd texts in one of them don't loosen it.
    """
    found = [predict(texts.where(F.octet_length("text") >= 100).select("text"), trees).withColumn("part", F.lit(i)) for i, (texts, trees) in enumerate(others)]
    # of rounded values there are a few thousand, however many texts
    bits = reduce(DataFrame.unionAll, found).where(F.col("bits_per_byte").isNotNull()).groupBy("lang_pred", "part").agg(F.percentile(F.round("bits_per_byte", 3), F.lit(share)).alias("bits"))
    return {r["lang_pred"]: r["bits"] for r in bits.groupBy("lang_pred").agg(F.min("bits").alias("bits")).collect()}  # one row for each language


def keep_known(docs: DataFrame, *, least_score: float = 0.5, slack: float = SLACK) -> DataFrame:
    """The rows of `docs` whose language is recognised: all columns stay, and columns of any name may be there.

    Rejected are texts that are null, empty or without a letter, those whose best language has a share under `least_score`, and those that
    even the best language explains badly: over `slack` times the bits a byte that 99 in 100 other texts of that language
    need, and over SHORT_BITS bits in all beyond that. Learned is from all different labelled texts that aren't held out: what texts
    of a language need is told by trees of the other half of them, and rows are judged by the trees of both halves. Whole texts of any length are
    scored. Equal rows share a verdict. A language with no other text to compare with has no such limit. An empty table stays empty.
    """
    files = file_count(docs)
    texts = written(different(docs.where(~held_out())), "texts", files=files)
    halves = [texts.where(F.col("half") == h) for h in (0, 1)]
    learned = [fit_drawn(half) for half in halves]
    usual = usual_bits([(halves[0], learned[1]), (halves[1], learned[0])])
    trees = together(*learned)
    found = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), trees)
    fine = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
    for lang, bits in usual.items():
        size = F.octet_length("text")
        fine &= (F.col("lang_pred") != lang) | (F.col("bits_per_byte") * size <= slack * bits * size + SHORT_BITS)
    return found.where(fine).select("row.*").coalesce(files)
