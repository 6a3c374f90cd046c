import re
from collections import Counter

import numpy as np
import pytest
from cases import LONG, empty, frame

from punctual.llm import collocations


def brute(rows, least, shadow=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) straight from the definition."""
    counts, words = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        longer = [n for (other, v), n in candidates.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * n >= shadow * a for n in longer):
            score, _, l, r = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, words[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    found = []
    for x in out:
        ranks[x[0]] += 1
        if ranks[x[0]] <= top:
            found.append((x[0], ranks[x[0]], *x[1:]))
    return found


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("seed", "per_part"), [(1, 200_000), (2, 40), (3, 7)])
def test_collocations_are_brute_force(spark, seed, per_part, monkeypatch):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "The", "the", "x\x01", "x", "x\x00y", "é", "日本", "\U0001f600", "of", "z\x7f"]
    weights = np.arange(len(vocabulary), 0, -1) ** 1.5
    rows = []
    for i in range(150):
        words = rng.choice(vocabulary, int(rng.integers(1, 60)), p=weights / weights.sum())
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ". ", "\n", " , ", "!"], p=[0.8, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01])) for w in words)
        rows.append((["en", "de", None, "und"][i % 4], text))
    rows += [("en", "new york city hall is new york city hall")] * 12 + [("de", None), ("de", ""), ("fr", " .\t")]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    monkeypatch.setattr(collocations, "parts_for", lambda n, per, spark: max(1, -(-n // per)))
    got = told(collocations.collocations(df, least=4, top=60, per_part=per_part))
    assert got == brute(rows, 4, top=60) and {r[0] for r in got} == {"en", "de", "und"}


def test_odd_rows(spark):
    rows = [(r["lang"], r["text"]) for r in frame(spark).collect()]
    assert told(collocations.collocations(frame(spark), least=2)) == brute(rows, 2)
    assert collocations.collocations(empty(spark)).count() == 0
    assert any(len(t or "") == len(LONG) for _, t in rows)


def test_scores_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(2**63 - 1, 2**63 - 1, 2**63 - 1), (2**62 + 12345, 2**63 - 1, 2**62 + 99999), (30, 31, 47), (10**15 + 7, 10**15 + 9, 10**16 + 11)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r"), 2_000_000).alias("s")).collect()
    assert sorted((r["a"], r["s"]) for r in got) == sorted((a, 2_000_000 * a // (l + r)) for a, l, r in rows)
