import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in said.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + t[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += cost
    return sorted(
        str((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())) for n, m in members.items()
    )


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def made(seed, n=300, words=("a", "b  c", "d\te f"), deep=6):
    rng, rows = np.random.default_rng(seed), []
    for c in rng.choice(4 * n, n, replace=False):
        for turn in range(int(rng.integers(1, deep))):
            rows.append((int(c), turn, ["user", "assistant"][turn % 2], words[int(rng.integers(len(words)))]))
    return rows


ODD = [
    (7, None, None, None),
    (7, None, None, None),
    (7, 1, "u", ""),
    (20, 3, "user", " x " * 5000),
    (20, 1, "us", "er"),
    (20, 1, "user", ""),
    (20, 1, "user", ""),
    (23, 0, "user", "日本 \U0001f600"),
    (24, 0, None, "日本 \U0001f600"),
    (None, 0, "user", "nobody"),
    (-3, 0, "user", "a"),
    (41, 5, "r", None),
]


@pytest.mark.parametrize(("seed", "per_part"), [(1, 50_000), (2, 40), (3, 5)])
def test_trie_is_brute_force(spark, seed, per_part, monkeypatch):
    monkeypatch.setattr(conversation_trie, "parts_for", lambda n, per, spark: max(1, -(-n // per)))
    rows = made(seed) + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(conversation_trie.conversation_trie(df, per_part=per_part)) == brute(rows)


def test_copies_and_a_long_one_over_parts(spark, monkeypatch):
    """Most conversations are equal, so they and what they begin with lie in many parts; splitters are cut short."""
    monkeypatch.setattr(conversation_trie, "parts_for", lambda n, per, spark: max(1, -(-n // per)))
    monkeypatch.setattr(conversation_trie, "SPLITTER_TURNS", 3)
    monkeypatch.setattr(conversation_trie, "PIECE", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(2 + (c % 3 == 0) * 4)]
    rows += [(900, t, "user", f"turn {t}") for t in range(300)] + made(4, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(conversation_trie.conversation_trie(df, per_part=15)) == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("path", "words", "node", "shard", "keys", "h", "block")})
    assert told(conversation_trie.conversation_trie(df)) == brute(ODD)
    assert conversation_trie.conversation_trie(df.limit(0)).count() == 0
    assert conversation_trie.conversation_trie(df.where("conv_id is null")).count() == 0
