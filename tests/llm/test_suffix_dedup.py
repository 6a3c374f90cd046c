import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame

from punctual.llm import suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for (k, _), x in zip(rows, texts, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        n = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone.tolist(), strict=True) if not g)
        out.append(str((k, len(x), int(gone.sum()), n, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def told(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def made(seed, n=60, letters="ab", length=30):
    """Texts of random letters with shared passages, near the length and longer, cut, edited and repeated inside a text."""
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list(letters), k))
    passages = [word(int(rng.integers(length - 3, 5 * length))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = word(int(rng.integers(0, 3 * length)))
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(len(passages)))]
            s = int(rng.integers(0, 4)) if rng.random() < 0.5 else 0
            if rng.random() < 0.3:
                k = int(rng.integers(len(p)))
                p = p[:k] + "X" + p[k + 1 :]
            text += p[s : len(p) - int(rng.integers(0, 4))] + word(int(rng.integers(0, length)))
        rows.append((i if i % 7 else None, text))
    return rows + [(1, rows[5][1]), (1, rows[5][1]), (2, None), (3, ""), (4, "q" * 500), (5, "q" * (length - 1)), (6, "x" * length), (6, "x" * length), (8, "日本語" * 90)]


@pytest.mark.parametrize(("seed", "letters", "length", "gram", "bucket"), [(1, "abcdefgh é", 30, 10, 40_000), (2, "ab", 30, 10, 40_000), (3, "abc", 40, 9, 3), (4, "abcdefgh", 30, 10, 2), (5, "abcd", 24, 24, 5)])
def test_removal_is_brute_force(spark, seed, letters, length, gram, bucket):
    rows = made(seed, letters=letters, length=length)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert told(suffix_dedup.remove_repeats(df, length=length, gram=gram, bucket=bucket)) == brute(rows, length)


def test_whole_size_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh ,.ü"), 700))
    rows = [(i, "".join(rng.choice(list("abcdefgh ,."), 900)) + passage[i : 700 - 2 * i] + "".join(rng.choice(list("xyz"), 150 * i))) for i in range(20)]
    rows += [(50, "z" * 3000), (51, passage[:150])]
    assert told(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 200)


def test_order_is_by_bytes():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(0, 3, int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(500)]
    padded = [s.ljust(40, b"\0") for s in strings]
    order, lcp = suffix_dedup.multikey_order(suffix_dedup._matrix(strings, 40))
    got = [padded[i] for i in order]
    assert got == sorted(padded)
    for a, b, n in zip(got, got[1:], lcp[1:].tolist(), strict=False):
        assert a[:n] == b[:n] and (n == 40 or a[n] != b[n])


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in frame(spark).collect()]
    short = [(k, t if t is None else t[:20_000]) for k, t in rows]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in short], "doc_id long, text string, t string, n_bytes string, first int")
    assert told(suffix_dedup.remove_repeats(df)) == brute(short, 200)
    assert suffix_dedup.remove_repeats(frame(spark)).count() == len(rows)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
