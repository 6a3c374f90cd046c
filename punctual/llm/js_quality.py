"""Quality rules: how far a document's histograms are from those of good text, on DataFrame functions only.

Two histograms are taken of every document: its characters by class, and its words by common
word (all others counted together). Their Jensen-Shannon distance (square root of the divergence
in bits, 0 to 1) to the reference of a language says how unusual the document is. The references
are the mean histograms of the documents of that language that pass the base rules and are long
enough; its common words are those that stand in the most of its documents. So every value of lang in
the data has a reference. A document is held against every reference; the nearest one counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import NOT_SPACE, SPACE, file_count, let, written

#: Character classes, as Java patterns, taken from a text one after the other. The rest is the last class.
CLASSES = {
    "lower": r"[a-z]+",
    "space": SPACE + "+",
    "upper": r"[A-Z]+",
    "other_letter": r"\p{L}+",
    "digit": r"[0-9]+",
    "stop": r"[.,;:?'()\-]+",
    "mark": r"[#*$%&|<>]+",
}

#: Common words learned for each language.
WORDS_PER_LANG = 16

REPEAT_WINDOW = 5


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _repeat_starts(hashes: Column) -> Column:
    """Places, in order, of the values of an array that it holds twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(a: Column) -> Column:
        same = lambda x, k: x["h"] == F.get(a, k)["h"]
        return F.filter(a, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))

    return let(placed, lambda a: F.array_sort(F.transform(twice(a), lambda x: x["i"])))


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """How many words stand in windows of `window` words that the array holds twice or more."""

    def windows(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        next_ones = lambda h: lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)])
        return F.slice(let(one, lambda h: F.transform(h, next_ones(h))), 1, F.size(w) - window + 1)

    def covered(starts: Column) -> Column:
        step = lambda i, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - i, F.lit(window)))
        return F.aggregate(F.transform(starts, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(_repeat_starts(h), covered))

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(words, lambda w: let(windows(w), count)))


def base_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """`docs` with _words, _chars (an array: characters by class) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(F.col("_rest"), "\n", -1), lambda x: x.rlike(NOT_SPACE))
    out = docs.withColumn("_rest", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words_of(F.col(text)))
    out = out.withColumns({"_n_rest": F.length("_rest"), "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")})
    for name, pattern in CLASSES.items():
        out = out.withColumn("_less", F.regexp_replace("_rest", pattern, "")).withColumn("_n_less", F.length("_less"))
        out = out.withColumns({f"_{name}": F.col("_n_rest") - F.col("_n_less"), "_rest": F.col("_less"), "_n_rest": F.col("_n_less")})
    counts = [*(f"_{name}" for name in CLASSES), "_n_rest"]
    more = {
        "_chars": F.array(*counts),
        "n_words": F.size("_words").cast("long"),
        "word_chars": (sum((F.col(c) for c in counts), F.lit(0)) - F.col("_space")).cast("long"),
        "n_symbols": F.col("_mark").cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }
    return out.withColumns(more).drop(*counts, "_rest", "_less", "_n_less")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn_words(docs: DataFrame, *, text: str = "text", lang: str = "lang", most: int = WORDS_PER_LANG) -> dict[str, list[str]]:
    """By language the `most` words, of those in lower case, that stand in the most of its documents; ties by word.

    All documents are counted; to the driver come `most` words of each language.
    """
    seen = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.array_distinct(words_of(F.col(text)))).alias("word"))
    counts = seen.groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("word") == F.lower("word"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found: dict[str, list[str]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= most).select("lang", "word").collect():
        found.setdefault(r["lang"], []).append(r["word"])
    return {name: sorted(words) for name, words in sorted(found.items())}


def vocabulary(common: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def common_words(words: Column, common: dict[str, list[str]]) -> Column:
    """Counts by common word, in lower case or with a capital, in the order of `vocabulary`; the other words last."""
    names = vocabulary(common)
    if not names:
        return F.array(F.size(words))
    # each common word becomes one letter of a short text, in which letters are then counted
    letters = [chr(0x4E00 + i) for i in range(len(names))]
    code_of = dict(zip(names, letters, strict=True))
    code_of |= {w[0].upper() + w[1:]: x for w, x in zip(names, letters, strict=True) if w[0].upper() + w[1:] not in code_of}

    def counted(words: Column, code: Column) -> Column:
        n = [F.length(code) - F.length(F.replace(code, F.lit(x), F.lit(""))) for x in letters]
        return F.array(*n, F.size(words) - F.length(code))

    def coded(words: Column) -> Column:
        found = F.filter(words, lambda w: w.isin(list(code_of)))
        return F.array_join(F.transform(found, lambda w: F.get(F.lit(list(code_of.values())), F.array_position(F.lit(list(code_of)), w).cast("int") - 1)), "")

    return let(coded(words), lambda code: counted(words, code))


def shares(counts: Column) -> Column:
    """An array of counts as shares of their sum; null where that is 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))


def _plogp(x: Column) -> Column:
    return x * F.log2(x + F.lit(1e-300))


def neg_entropy(p: Column) -> Column:
    """Sum of p * log2(p)."""
    return F.aggregate(p, F.lit(0.0), lambda n, x: n + _plogp(x))


def js_distance(p: Column, p_entropy: Column, q: Column, q_entropy: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares, 0 to 1, given the `neg_entropy` of each."""
    mixed = F.aggregate(F.zip_with(p, q, lambda a, b: (a + b) / 2), F.lit(0.0), lambda n, x: n + _plogp(x))
    return F.sqrt(F.greatest(F.lit(0.0), (p_entropy + q_entropy) / 2 - mixed))


def references(measured: DataFrame, common: dict[str, list[str]], *, lang: str = "lang", min_words: int = 30) -> dict[str, tuple[list[float], list[float]]]:
    """Mean shares by character class and by common word of every language in `common`, over all its rows.

    Rows that fail the base rules, have under `min_words` words or over one symbol in ten words (tables
    and markup rather than text) don't count. A language without such rows has no reference. What
    comes to the driver is one row for each language.
    """
    sizes = {"_chars": len(CLASSES) + 1, "_common": len(vocabulary(common)) + 1}
    plain = 10 * F.col("n_symbols") <= F.col("n_words")
    good = measured.where(F.col(lang).isin(list(common)) & ~base_failed() & plain & (F.col("n_words") >= min_words))
    means = [F.avg(F.get(F.col(c), F.lit(i))).alias(f"{c}_{i}") for c, n in sizes.items() for i in range(n)]
    rows = good.select(F.col(lang).alias("lang"), *[shares(F.col(c)).alias(c) for c in sizes]).groupBy("lang").agg(*means).collect()
    return {r["lang"]: tuple([r[f"{c}_{i}"] for i in range(n)] for c, n in sizes.items()) for r in sorted(rows, key=lambda r: r["lang"])}


def measure(docs: DataFrame, common: dict[str, list[str]], *, text: str = "text") -> DataFrame:
    """`docs` with the base counts, _chars and _common."""
    return base_counts(docs, text=text).withColumn("_common", common_words(F.col("_words"), common))


def judge(measured: DataFrame, refs: dict[str, tuple[list[float], list[float]]], *, weight: float, most: float, slack: float, min_words: int) -> DataFrame:
    """`measured` with base_failed, js_chars, js_common, js_lang, js and kept.

    js is js_chars + `weight` * js_common to the language where it is smallest. It may be at most
    `most` + `slack` / sqrt(n_words): short texts stray further from any reference by chance. Texts
    under `min_words` words say too little, and without any reference there is nothing to be far
    from; in both cases the base rules alone decide.
    """
    found = measured.withColumn("base_failed", base_failed()).withColumn("_p", shares(F.col("_chars"))).withColumn("_w", shares(F.col("_common")))
    found = found.withColumn("_hp", neg_entropy(F.col("_p"))).withColumn("_hw", neg_entropy(F.col("_w")))
    fixed = lambda x: F.array(*map(F.lit, x))
    entropy = lambda x: F.lit(sum(v * math.log2(v) for v in x if v > 0))
    known = F.array(*[F.struct(F.lit(name).alias("lang"), fixed(p).alias("p"), entropy(p).alias("hp"), fixed(w).alias("w"), entropy(w).alias("hw")) for name, (p, w) in refs.items()])

    def tried(r: Column) -> Column:
        chars, words = (js_distance(F.col(f"_{x}"), F.col(f"_h{x}"), r[x], r[f"h{x}"]) for x in "pw")
        return let(F.struct(chars.alias("chars"), words.alias("common")), lambda d: F.struct((d["chars"] + weight * d["common"]).alias("js"), d["chars"].alias("chars"), d["common"].alias("common"), r["lang"].alias("lang")))

    best = F.array_min(F.transform(known, tried)) if refs else F.expr("cast(null as struct<js double, chars double, common double, lang string>)")
    found = found.withColumn("_best", F.when(F.col("_p").isNotNull() & F.col("_w").isNotNull(), best))
    fits = (F.col("n_words") < min_words) | (F.col("_best.js") <= most + slack / F.sqrt("n_words"))
    return (
        found.withColumn("js_chars", F.col("_best.chars"))
        .withColumn("js_common", F.col("_best.common"))
        .withColumn("js_lang", F.col("_best.lang"))
        .withColumn("js", F.col("_best.js"))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))
    )


#: Thresholds of the query and of the pipeline's stage: chosen once so that nearly all labelled good documents
#: of the given tables stay; another corpus needs its own.
LIMITS = {"weight": 0.5, "most": 0.22, "slack": 1.0, "min_words": 30}
RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_common", "js_lang", "js"]


def quality(docs: DataFrame, *, common: dict[str, list[str]] | None = None, limits: dict | None = None) -> DataFrame:
    """One row for each document: RESULT. Null and empty texts have no words and fail the base rules.

    Rows that repeat an id are judged each; a null lang teaches nothing and is judged like others.
    `common` has common words by language if they aren't to be learned.
    """
    limits = limits or LIMITS
    own = docs.select("doc_id", "text", "lang")
    common = learn_words(own) if common is None else common
    # both the references and the verdict need the counts of every document: take them once
    counted = written(measure(own, common).drop("text", "_words"), "quality-counts")
    refs = references(counted, common, min_words=limits["min_words"])
    return judge(counted, refs, **limits).select(*RESULT)


def keep_good(docs: DataFrame, *, common: dict[str, list[str]] | None = None, limits: dict | None = None) -> DataFrame:
    """The rows of `docs` whose verdict is to keep them; all columns stay. Verdicts go by the row, not by its doc_id."""
    limits = limits or LIMITS
    common = learn_words(docs) if common is None else common
    row, files = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang"), file_count(docs)
    counted = written(measure(row, common).drop("text", "_words"), "quality-rows", files=files)
    refs = references(counted, common, min_words=limits["min_words"])
    return judge(counted, refs, **limits).where("kept").select("_row.*").coalesce(files)


def sql(limits: dict | None = None, most: int = WORDS_PER_LANG) -> str:
    """`quality` over all documents as DuckDB SQL, distances rounded to 6 places."""
    x = limits or LIMITS
    text = lambda p: p.replace("'", "''")
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{text(p)}', '', 'g')) AS c_{n}" for n, p in CLASSES.items() if n != "other_letter")
    rest = " - ".join(f"c_{n}" for n in CLASSES if n not in ("other_letter",))
    bins = ", ".join(f"('{n}', c_{n})" for n in CLASSES)
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS m, doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS MATERIALIZED (SELECT m, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS ws FROM d),
word AS MATERIALIZED (SELECT m, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT m, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM word WINDOW o AS (PARTITION BY m ORDER BY i)),
twice AS (SELECT m, i FROM (SELECT m, i, count(*) OVER (PARTITION BY m, s) AS n FROM win WHERE s IS NOT NULL) WHERE n > 1),
again AS (SELECT m, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY m),
line AS (SELECT m, count(*) - count(DISTINCT x) AS n FROM (SELECT m, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{NOT_SPACE}') GROUP BY m),
c0 AS (SELECT m, length(t) AS n, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters, {counts} FROM d),
c AS MATERIALIZED (SELECT *, letters - c_lower - c_upper AS c_other_letter, n - letters + c_lower + c_upper - ({rest.replace(" - ", " + ")}) AS c_rest FROM c0),
base AS MATERIALIZED (SELECT d.m, doc_id, lang, len(ws)::bigint AS n_words, c.n - c_space AS word_chars, c_mark AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  (len(ws) < 10 OR 100 * coalesce(again.n, 0) > 20 * len(ws)) AS base_failed FROM d JOIN w USING (m) JOIN c USING (m) LEFT JOIN line USING (m) LEFT JOIN again USING (m)),
df AS (SELECT lang, w, count(DISTINCT m) AS n FROM word JOIN d USING (m) WHERE lang IS NOT NULL AND w = lower(w) GROUP BY lang, w),
v AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT lang, w FROM df QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {most})),
form AS (SELECT w AS f, w FROM v UNION ALL SELECT upper(w[1]) || w[2:], w FROM v WHERE upper(w[1]) || w[2:] NOT IN (SELECT w FROM v)),
said AS (SELECT m, form.w, count(*) AS n FROM word JOIN form ON word.w = form.f GROUP BY ALL),
other AS (SELECT m, '' AS w, n_words - coalesce(sum(n), 0) AS n FROM base LEFT JOIN said USING (m) GROUP BY m, n_words),
h AS (SELECT m, 'common' AS kind, w AS bin, n FROM said UNION ALL SELECT m, 'common', w, n FROM other UNION ALL
  SELECT m, 'chars', b.bin, b.n FROM c, LATERAL (VALUES {bins}, ('rest', c_rest)) AS b(bin, n)),
share AS MATERIALIZED (SELECT m, kind, bin, n / nullif(sum(n) OVER (PARTITION BY m, kind), 0) AS p FROM h),
good AS (SELECT m, lang FROM base WHERE lang IN (SELECT lang FROM df) AND NOT base_failed AND 10 * n_symbols <= n_words AND n_words >= {x["min_words"]}),
size AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
ref AS MATERIALIZED (SELECT lang, kind, bin, sum(p) / any_value(size.n) AS q FROM share JOIN good USING (m) JOIN size USING (lang) GROUP BY lang, kind, bin),
mixed AS (SELECT m, lang, kind, bin, p, 0::double AS q FROM share, size WHERE p IS NOT NULL UNION ALL SELECT m, lang, kind, bin, 0, q FROM ref, (SELECT DISTINCT m FROM share WHERE p IS NOT NULL)),
pair AS (SELECT m, lang, kind, bin, sum(p) AS p, sum(q) AS q FROM mixed GROUP BY ALL),
js AS (SELECT m, lang, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 2 - sum(CASE WHEN p + q > 0 THEN (p + q) / 2 * log2((p + q) / 2) ELSE 0 END))) AS x FROM pair GROUP BY ALL),
full_ AS (SELECT m FROM share GROUP BY m HAVING count(DISTINCT kind) FILTER (p IS NOT NULL) = 2),
near AS (SELECT m, lang, chars, common, chars + {x["weight"]} * common AS js FROM (SELECT m, lang, max(x) FILTER (kind = 'chars') AS chars, max(x) FILTER (kind = 'common') AS common FROM js JOIN full_ USING (m) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY m ORDER BY chars + {x["weight"]} * common, chars, common, lang) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(n_words < {x["min_words"]} OR js <= {x["most"]} + {x["slack"]} / sqrt(n_words), true) AS kept,
  round(chars, 6) AS js_chars, round(common, 6) AS js_common, near.lang AS js_lang, round(js, 6) AS js FROM base LEFT JOIN near USING (m)
"""
