import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from punctual.llm import permutation_ann, queries, quote_linking, url_digest


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    same(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])


# Quotes

MESSAGES = [
    (1, 0, "user", "Hello there, this is the first message.\nSecond line of it is long enough."),
    (1, 1, "assistant", "> Hello there, this is the first message.\n> Second line of it is long enough.\nMy answer is this long text here."),
    (1, 2, "user", "Bob wrote:\n> My answer is this long text here.\n>> Second line of it is long enough.\n\nI disagree."),
    (1, 3, "user", "> Second line of it is  LONG enough.\nPartial quote"),
    (1, 3, "user", "> Second line of it is  LONG enough.\nPartial quote"),
    (1, 4, "a", "> unknown thing quoted here\nhm"),
    (1, 5, None, None),
    (1, 6, "u", ""),
    (None, 1, "u", "> x"),
    (2, None, "u", "> Hello there, this is the first message."),
    (1, 7, "u", "> > I disagree.\n> Partial quote that nobody wrote\nok"),
    (1, 8, "u", "plain"),
    (3, 0, "u", ">\n>\nlonely"),
]


def test_quotes(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumns({"body": F.lit("clash"), "passages": F.lit(1), "thread_turn": F.lit(2)})
    rows = quote_linking.link(df).collect()
    assert len(rows) == len(MESSAGES)
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    assert [got[1, k]["parent_turn"] for k in range(9)] == [None, 0, 1, 0, None, None, None, 2, None]
    assert [got[1, k]["thread_turn"] for k in range(9)] == [0, 0, 0, 0, 4, 5, 6, 0, 8]
    assert [got[1, k]["reply_position"] for k in range(9)] == [0, 1, 2, 4, 0, 0, 0, 3, 0]
    assert got[1, 2]["body"] == "I disagree." and got[1, 2]["n_passages"] == 2
    assert got[1, 5]["body"] == "" and not any(">" in r["body"] for r in rows)
    assert quote_linking.link(df.limit(0)).count() == 0


def test_sentences_of_a_quote_are_found(spark):
    """Two of three sentences, wrapped anew, and with a comment between passages; a part of a sentence is no unit."""
    rows = [
        (1, 0, "user", "First sentence of one to ten. Second sentence is here! And a third one?"),
        (1, 1, "user", "> First sentence of one to ten. Second\n> sentence is here!\nYes."),
        (1, 2, "user", "> sentence is here! And a\n> third\n> one?\nNo."),
        (1, 3, "user", "> sentence of one\nWhat?"),
    ]
    got = {r["turn"]: r["parent_turn"] for r in quote_linking.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: None}


def quoting_table():
    """Conversations whose messages quote whole messages, lines, sentences and quotes of others, some far back, some said often."""
    rng, rows = np.random.default_rng(12), []
    common = ["ok", "Thanks a lot.", "I see. Go on."]
    for conv in range(30):
        said = []
        for turn in [*range(int(rng.integers(2, 40))), *((1500, 1501, 4000) if conv % 3 == 0 else ())]:
            own = common[int(rng.integers(3))] if rng.random() < 0.3 else f"Message {turn} of {conv}. It has {rng.integers(99)} words!\nAnd a line {turn * 7 % 5}.\n\nAnother paragraph {rng.integers(9)}."
            quoted = []
            for _ in range(int(rng.integers(0, 3)) if said else 0):
                other = said[int(rng.integers(len(said)))]
                wrapped = " ".join(other.split()[: int(rng.integers(3, 30))])
                cut = int(rng.integers(1, len(wrapped)))
                part = [wrapped[:cut], wrapped[cut:]] if rng.random() < 0.2 else other.split("\n") if rng.random() < 0.5 else [other.split(". ")[0] + ("." if ". " in other else "")]
                mark = "> " if rng.random() < 0.6 else ">> " if rng.random() < 0.7 else "> > > "
                quoted += ["Bob wrote:"] * (rng.random() < 0.3) + [mark + x for x in part] + [""] * (rng.random() < 0.5)
            said.append(own)
            rows.append((conv, turn, "user", "\n".join([*quoted, own])))
    return rows + rows[5:9]


@pytest.mark.parametrize("rows", [MESSAGES, quoting_table()], ids=["cases", "table"])
def test_quotes_are_their_sql(spark, rows):
    import duckdb

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(m) for m in rows])
    if rows is not MESSAGES:
        assert quote_linking.link(df).where("parent_turn is not null and reply_position > 2").count() > 30
    found = c.sql(quote_linking.SQL)
    names = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in quote_linking.link(df).select(*names).collect())


# URLs


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://COM/en/1", "https://a.b.example.com/en/78?x", "https://a.b.example.com/en/8#t", "http://notexample.net/de/8", "http://x.example.net/de/81", "ftp://", "http://x.org?/es/", "http://x.org/es/", "http://x.org/es/", "a://b://com/en/"]
    df = spark.createDataFrame([(i if i != 10 else None, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_digest.judge(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("com", "/en/1", "com/en/", "block")
    assert got[4][2:] == ("example.com/en/7", "allow") and got[5][2:] == ("com/en/", "block")
    assert got[6][2:] == ("net/de/", "block") and got[7][2:] == ("example.net/de/8", "block")
    assert got[9] == ("x.org", "", None, "allow") and got[11][3] == got[None][3] == "block"
    assert got[12][:2] == ("b:", "//com/en/")
    assert url_digest.judge(df.limit(0)).count() == 0


def test_rules_are_the_contracts():
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{verdict} {host}{path}" for verdict, host, path in url_digest.RULES) == said


def test_collisions_are_told_apart(tmp_path):
    rules = [("block" if i % 2 else "allow", f"h{i}.example", "/p/") for i in range(500)]
    (tmp_path / "d").write_bytes(url_digest.DigestArray.build(rules))
    table = url_digest.DigestArray(str(tmp_path / "d"))
    texts = [f"h{i}.example/p/".encode() for i in range(520)]
    sizes = np.array([len(f"h{i}.example") for i in range(520)])
    hits = table.lookup(texts, sizes)
    assert (hits[:500] >= 0).all() and (hits[500:] < 0).all()
    assert [int(table.verdicts[k]) for k in hits[:500]] == [i % 2 for i in range(500)]
    # the same digest for all: only the texts tell
    same_digest = url_digest.DigestArray(str(tmp_path / "d"))
    same_digest.digests = np.full(500, 7, np.uint64)
    import unittest.mock as mock

    with mock.patch.object(url_digest.xxhash, "xxh64_intdigest", lambda _: 7):
        again = same_digest.lookup(texts[:50] + [b"other"], np.append(sizes[:50], 3))
    assert [int(table.offsets[k]) for k in again[:50]] == [int(table.offsets[k]) for k in hits[:50]] and again[50] == -1


# Neighbours


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in permutation_ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hit = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[i]
        scores[i] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        found = sorted(got[ids[i]])
        assert [r for r, *_ in found] == list(range(1, 21)) and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        assert np.allclose([s for *_, s in found], [scores[np.searchsorted(ids, x)] for _, x, _ in found], rtol=0, atol=1e-12)
        hit += len(set(best.tolist()) & {x for _, x, _ in found})
        n += 20
    assert hit / n > 0.9


def test_recall_with_copies(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect())
    common = rows[7][1]
    rows = [(i, common if n % 3 == 1 else v) for n, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in permutation_ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    shares = {True: [], False: []}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (v * v[i]).sum(1)
        scores[i] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        shares[i % 3 == 1].append(len(best & got[ids[i]]) / 20)
    print({k: (len(x), np.mean(x)) for k, x in shares.items()})
    assert np.mean(shares[True]) == 1 and np.mean(shares[False]) > 0.9
    different = permutation_ann.distinct(permutation_ann.usable(df), 21)
    found = permutation_ann.sample_pivots(different)
    assert {s: len(np.unique(p, axis=0)) for s, p in found.items()} == {64: different.count()}
    assert len(permutation_ann.sample_pivots(different, 100)[64]) == 100


def test_cells_lose_little(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    whole = {(r["query_id"], r["vec_id"]) for r in permutation_ann.nearest(df).collect()}
    monkeypatch.setattr(permutation_ann, "ROWS_PER_CELL", 100)
    monkeypatch.setattr(permutation_ann, "ROWS_PER_BLOCK", 60)  # most cells are split
    dealt = {(r["query_id"], r["vec_id"]) for r in permutation_ann.nearest(df).collect()}
    assert len(dealt) == len(whole) and len(dealt & whole) / len(whole) > 0.9
    every = {(r["query_id"], r["vec_id"]) for r in permutation_ann.nearest(df, probe=1.0, rerank=1.0).collect()}
    assert len(every & whole) / len(every) > 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [None, 1.0]), (4, [0.5, 0.5]), (4, [0.5, 0.5]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (6, [])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, v int")
    got = [tuple(r) for r in permutation_ann.nearest(df).orderBy("query_id", "rank").collect()]
    others = [(1.0, 1), (1.0, 2), (0.5, 4), (0.5, 4)]
    want = {0: [(1.0, 1), (1.0, 2), (1.0, 20), (0.5, 4), (0.5, 4)], 20: [(1.0, 0), *others]}
    assert got == [(q, n + 1, i, s) for q in (0, 20) for n, (s, i) in enumerate(want[q])]
    shared = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in permutation_ann.nearest(shared).collect())
    assert got == sorted([(20, 1, 1, 1.0), (20, 2, 20, 0.0), (20, 3, 20, 0.0), *[(20, 1, 1, 1.0), (20, 2, 20, 1.0), (20, 3, 20, 0.0)] * 2, (40, 1, 2, 3.0)])
    assert permutation_ann.nearest(df.limit(0)).count() == 0
    assert permutation_ann.nearest(df.where("vec_id = 0")).count() == 0


def test_more_queries_than_a_group_holds(spark, monkeypatch):
    """Queries are cut into slices; every query meets every block it would have met."""
    rng = np.random.default_rng(21)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    told = lambda: sorted(tuple(r) for r in permutation_ann.nearest(df, k=5, query="id % 2 = 0", probe=1.0, rerank=1.0).select("query_id", "rank", "vec_id", "score").collect())
    whole = told()
    monkeypatch.setattr(permutation_ann, "QUERIES_PER_GROUP", 16)
    assert told() == whole and len(whole) == 300 * 5
    x = np.array([v for _, v in rows])
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    assert {(q, r): v for q, r, v, _ in whole} == {(q, r): int(v) for q in range(0, 600, 2) for r, v in enumerate(np.lexsort((np.arange(600), -near[q]))[:5], 1)}
