import glob
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import EXTRA, ROWS, empty, frame
from pyspark.sql import functions as F

from punctual.llm import bin_completion, common, golay_simhash, importance_resampling, js_quality, ppm_langid, sentencepiece_lattice, toxicity_chain

MODEL = bin_completion.tokenizer_path("piece_bpe_32k.model")


# SentencePiece


def test_pieces_are_the_librarys(spark, documents):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=MODEL)
    texts = ["Hello  world, it's  a test.\n\nNew ² line². 123 abc", " leading", "trailing  ", "a" * 200, "ab" * 150, "a▁b", "😀 ok\tTab", "((())) --- ;;; ));", "\n\n", *[r[1] for r in ROWS]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(documents.select((F.col("doc_id") + 1000).alias("doc_id"), "text").where("doc_id < 1300"))
    got = {r["doc_id"]: r["ids"] for r in sentencepiece_lattice.encode_documents(df, MODEL).collect()}
    for r in df.collect():
        assert got.get(r["doc_id"], []) == (sp.encode(r["text"]) if r["text"] else []), r["doc_id"]


def test_pieces_come_back(spark):
    out = sentencepiece_lattice.summarise(frame(spark), MODEL).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    got = {r["doc_id"]: r for r in out}
    assert all(r["round_trip"] for r in out)
    assert got[0]["n_pieces"] == got[1]["n_pieces"] == 0 and got[3]["n_pieces"] > 20_000
    assert sentencepiece_lattice.summarise(empty(spark), MODEL).count() == 0


def test_rows_that_share_an_id(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "hello world, hello"), (1, "hello world, hello"), (1, "another text"), (None, "hello world, hello"), (None, "x y"), (2, "hello world, hello"), (3, None), (3, "z"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.asDict() for r in sentencepiece_lattice.summarise(df, MODEL).collect()]
    want = sorted((str(i), len(sp.encode(t)) if t else 0) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_pieces"]) for r in out) == want
    assert sorted(Counter(r["ids_digest"] for r in out).values()) == [1, 1, 1, 2, 4]
    assert {r["ids_digest"] for r in out if not r["n_units"]} == {"0" * 16}
    ids = [(str(r["doc_id"]), r["ids"]) for r in sentencepiece_lattice.encode_documents(df, MODEL).collect()]
    assert sorted(ids) == sorted((str(i), sp.encode(t)) for i, t in rows if t)


def test_long_runs_are_the_librarys(spark):
    from sentencepiece import SentencePieceProcessor

    sp, rng = SentencePieceProcessor(model_file=MODEL), np.random.default_rng(2)
    made = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = ["x" * 5000, "ab" * 700, "abcdefghi" * 300, made("abcdefghijklmnopqrstuvwxyz", 60_000), made("-=/#", 3000), "é日" * 600, made("the and ing".replace(" ", ""), 4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in sentencepiece_lattice.encode_documents(df, MODEL).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sp.encode(t), i
    assert all(r["round_trip"] for r in sentencepiece_lattice.summarise(df, MODEL).collect())


def test_rarer_units_are_encoded_where_they_meet_and_kept_nowhere(spark, documents):
    """Whatever is broadcast, the sums are those of the library's pieces; no table of all units is written."""
    from sentencepiece import SentencePieceProcessor

    sp, most = SentencePieceProcessor(model_file=MODEL), 300
    long = [(1, " " * 300 + "b" * 300 + " is"), (2, "the"), (2, "the"), (3, "-" * 70 + " of the")]
    df = spark.createDataFrame(long, "doc_id long, text string").unionByName(documents.select("doc_id", "text").where("doc_id between 1000 and 1100"))
    listed = lambda: set(glob.glob(f"{common.shared_folder(spark).removeprefix('file:')}/*"))
    old = listed()
    out = sentencepiece_lattice.summarise(df, MODEL, most_broadcast=most).collect()
    sizes = {f.split("/")[-1].rsplit("-", 1)[0]: spark.read.parquet(f).count() for f in listed() - old if "/sums-" not in f}
    assert sizes and max(sizes.values()) <= most, sizes
    assert all(r["round_trip"] for r in out)
    assert sorted((r["doc_id"], r["n_pieces"]) for r in out) == sorted((r["doc_id"], len(sp.encode(r["text"]))) for r in df.collect())
    every = sentencepiece_lattice.summarise(df, MODEL).collect()
    assert sorted(map(str, out)) == sorted(map(str, every))


def test_many_units_are_folded_at_once(spark, documents, monkeypatch):
    """Units of any kind side by side, cut into several lots, have the ids that each has by itself; what is carried rides on one edge of a unit."""
    from punctual.llm.sentencepiece_lattice import OTHER, Run, edges, facts_of, folded, load, piece_table, units_of, _packed

    model = load(MODEL)
    odd = [("😀",), (" 日本語",), ("  ½²",), ("é日" * 40,), ("ab" * 150,), ("-" * 100,), (" " * 9,), ("\n",), ("x",)]
    units = spark.createDataFrame(odd, "unit string").union(documents.where("doc_id < 40").select(F.explode(units_of(F.col("text"))))).distinct().limit(1500)
    found = edges(units.select(F.col("unit").alias("key"), "unit", F.array(F.lit(1)).alias("at")), piece_table(spark, model), model, carried=("at",))
    rows = found.groupBy("key").agg(F.collect_list(_packed()).alias("edges"), F.count("at").alias("carried")).toArrow()
    assert set(rows["carried"].to_pylist()) == {1} and len(rows) == units.count()
    monkeypatch.setattr(sentencepiece_lattice, "EDGES", 700)
    got = folded(rows["edges"].combine_chunks(), facts_of(model)).to_pylist()
    for key, packed, ids in zip(rows["key"].to_pylist(), rows["edges"].to_pylist(), got, strict=True):
        run = Run(model)
        coded = lambda v: (v,) if v < OTHER else tuple(model.first_byte + b for b in chr(v - OTHER).encode())
        run.extend([(x >> 42, x >> 32 & 1023, coded(x & 0xFFFFFFFF)) for x in packed], len(key))
        assert ids == run.ids(), key


def test_long_runs_have_the_largest_sum():
    from punctual.llm.sentencepiece_lattice import Model, Piece, Run

    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -3.7}
    model = Model("unigram", [Piece(p, i, s, 0, [], []) for i, (p, s) in enumerate(scores.items())], 100, 3)
    text = "".join(np.random.default_rng(4).choice(["a", "b"], 500))
    run, sums = Run(model), [0.0]
    edges = [(s + len(p), s, (i,)) for s in range(len(text)) for i, p in enumerate(scores) if text[s:].startswith(p)]
    for w in range(0, len(text), 64):
        run.extend([x for x in edges if w <= x[1] < w + 64], w + 64)
    ids = run.ids()
    for e in range(1, len(text) + 1):
        sums.append(max(sums[e - n] + scores[text[e - n : e]] for n in (1, 2, 3) if n <= e and text[e - n : e] in scores))
    names = list(scores)
    assert "".join(names[i] for i in ids) == text and sum(scores[names[i]] for i in ids) == pytest.approx(sums[-1])


def test_kind_is_read_from_the_model():
    assert sentencepiece_lattice.model_kind(MODEL) == "bpe"


def test_ids_that_stand_for_nothing_decode_to_null(spark):
    from punctual.llm.sentencepiece_lattice import Model, Piece, decode_units

    model = Model("unigram", [Piece("▁a", 3, 0.0, 0, [], []), Piece("b", 5, 0.0, 0, [], [])], 10, 2)
    rows = [("text", [3, 5]), ("bytes", [10 + 0xC3, 10 + 0xA9]), ("none", []), ("gap", [3, 4]), ("past", [5, 9999]), ("null", [5, None])]
    got = {r["key"]: r["decoded"] for r in decode_units(spark.createDataFrame(rows, "key string, ids array<int>"), model).collect()}
    assert got == {"text": " ab", "bytes": "é", "none": "", "gap": None, "past": None, "null": None}


def test_largest_sum_is_brute_force(spark):
    from punctual.llm.sentencepiece_lattice import Model, Piece, encode_units

    scores = {"▁": -2.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.5, "ba": -3.1, "aba": -3.7}
    model = Model("unigram", [Piece(p, i, s, 0, [], []) for i, (p, s) in enumerate(scores.items())], 100, 3)
    words = [" " + w for w in ("a", "ab", "aba", "abab", "bbaab", "abaaba")]
    units = spark.createDataFrame([(w, w, 1) for w in words], "key string, unit string, n long")
    names = list(scores)
    for r in encode_units(units, model).collect():

        def best(text):
            if not text:
                return 0.0
            return max(scores[text[:n]] + best(text[n:]) for n in (1, 2, 3) if text[:n] in scores and n <= len(text))

        found = [names[i] for i in r["ids"]]
        assert "".join(found) == r["key"].replace(" ", "▁")
        assert sum(scores[p] for p in found) == pytest.approx(best(r["key"].replace(" ", "▁")))


# Language ID


def test_code_lengths_are_brute_force(documents):
    trees = ppm_langid.fit(documents, docs_per_lang=20)
    text = "Thé quick — brown fox".encode()
    counts = [Counter() for _ in trees.langs]
    for k, g, n in zip(trees.lang, trees.gram, trees.n, strict=True):
        c = [(int(g) >> s) & 255 for s in (24, 16, 8, 0)]
        for order in range(4):
            counts[k][tuple(c[3 - order : 3]), c[3]] += int(n)
    known = [{} for _ in trees.langs]
    for k, found in enumerate(counts):
        for (context, symbol), n in found.items():
            known[k].setdefault(context, {})[symbol] = n
    got = trees.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    for k in range(len(trees.langs)):
        bits = 0.0
        padded = [0, 0, 0, *text]
        for i in range(3, len(padded)):
            cost, order = 0.0, 3
            while order >= 0:
                near = known[k].get(tuple(padded[i - order : i]))
                if near:
                    total = sum(near.values()) + len(near)
                    if padded[i] in near:
                        cost -= np.log2(near[padded[i]] / total)
                        break
                    cost -= np.log2(len(near) / total)
                order -= 1
            else:
                cost += 8
            bits += cost
        assert got[k] / ppm_langid.SCALE == pytest.approx(bits, abs=len(text) / ppm_langid.SCALE)


def test_texts_dont_see_each_other(documents):
    trees = ppm_langid.fit(documents, docs_per_lang=10)
    texts = [b"", b"a", b"", b"bc", b"the house", b"", b"x" * 3]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = trees.code_lengths(data, starts)
    for i, t in enumerate(texts):
        assert (together[i] == trees.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]).all()


def test_many_languages(spark):
    rng = np.random.default_rng(6)
    rows, spoken = [], {}
    for k in range(150):  # each its own syllables; every tenth in a script of its own
        first = 0x61 if k % 10 else 0x4E00 + 40 * k
        spoken[f"l{k:03}"] = ["".join(chr(first + int(x)) for x in rng.integers(0, 20, 3)) for _ in range(12)]
    text = lambda name: " ".join("".join(rng.choice(spoken[name], 2)) for _ in range(60))
    for name in spoken:
        rows += [(len(rows) + i, text(name), name) for i in range(5 if name != "l007" else 300)]
    trees = ppm_langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_lang=5)
    assert trees.langs == sorted(spoken)
    _, numbers, size, built = trees.build()
    assert sum(t[2].nbytes for t in built) < 150 * 1_500_000
    asked = spark.createDataFrame([(i, text(name), name) for i, name in enumerate(sorted(spoken))], "doc_id long, text string, name string")
    assert ppm_langid.predict(asked, trees).where("lang_pred = name").count() > 147


def test_held_out_languages(spark, documents):
    found = ppm_langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    right, n = found.where("held_out and lang = lang_pred").count(), found.where("held_out").count()
    assert n > 200 and right / n > 0.98
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in found.collect())


def test_languages_of_cases(spark, documents):
    df = frame(spark)
    trees = ppm_langid.fit(documents, docs_per_lang=50)
    got = {r["doc_id"]: r for r in ppm_langid.predict(df, trees).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 7)] == ["und"] * 4
    assert got[4]["lang_pred"] == "en" and got[None]["lang_pred"] == "fr" and 0 < got[4]["score"] <= 1
    assert ppm_langid.identify(empty(spark)).count() == 0
    told = ppm_langid.identify(df).collect()
    assert len(told) == len(ROWS) and all(r["held_out"] is not None for r in told)
    assert ppm_langid.keep_known(df).columns == df.columns


def test_sample_is_bounded_by_different_texts(spark):
    rows = [(i, f"text number {i} of many", "en") for i in range(2000)] + [(i, "the copy", "en") for i in range(2000, 12_000)] + [(1, "ein text", "de"), (2, None, "de"), (3, "x", None), (4, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = ppm_langid.drawn(df, 400).collect()
    texts = [(r["lang"], r["text"]) for r in got]
    assert len(texts) == len(set(texts)) and Counter(x for x, _ in texts) == {"en": 400, "de": 1}
    assert sorted(r["place"] for r in got if r["lang"] == "en") == list(range(1, 401))
    assert ppm_langid.drawn(df.limit(0), 400).count() == 0


def bits(text, texts):
    """What PPM with orders 3 to 0 and escapes needs for a text, learned from others."""
    known = {}
    for t in texts:
        padded = b"\0\0\0" + t
        for i in range(3, len(padded)):
            for order in range(4):
                near = known.setdefault(padded[i - order : i], Counter())
                near[padded[i]] += 1
    out, padded = 0.0, b"\0\0\0" + text
    for i in range(3, len(padded)):
        for order in (3, 2, 1, 0):
            near = known.get(padded[i - order : i])
            if near:
                total = sum(near.values()) + len(near)
                if padded[i] in near:
                    out -= np.log2(near[padded[i]] / total)
                    break
                out -= np.log2(len(near) / total)
        else:
            out += 8
    return out


def test_table_of_languages_is_brute_force(spark, documents):
    rows = [tuple(r) for r in documents.where("doc_id < 160 and length(text) between 20 and 900").select("doc_id", "text", "lang").collect()]
    rows += [(1000, "", "en"), (1001, None, "de"), (1002, "123 !!", "en"), (1003, rows[0][1], None), (None, rows[1][1], rows[1][2])]
    learned = {}
    for i, t, x in rows:
        if t and x and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            learned.setdefault(x, set()).add(t.encode())
    got = {(r["doc_id"]): r for r in ppm_langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if not t or not re.search(r"[^\W\d_]", t):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        need = {x: bits(t.encode(), texts) for x, texts in learned.items()}
        best = min(sorted(need), key=need.get)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 / sum(2.0 ** -min(b - need[best], 1000) for b in need.values()), abs=0.05)
        assert r["bits_per_byte"] == pytest.approx(need[best] / len(t.encode()), abs=1 / ppm_langid.SCALE)


def test_the_stage_rejects_what_no_language_explains(spark, documents):
    rng = np.random.default_rng(3)
    noise = ["".join(chr(int(x)) for x in rng.integers(0x21, 0x7F, 600)) for _ in range(20)] + ["".join(chr(int(x)) for x in rng.integers(0x4E00, 0x9000, 300)) for _ in range(20)]
    docs = documents.select("doc_id", "text", "lang")
    both = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string")).unionByName(docs.where("doc_id < 0"))
    kept = {r["doc_id"] for r in ppm_langid.keep_known(both).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**6]
    known = {r["doc_id"] for r in ppm_langid.identify(docs).where("lang_pred != 'und'").collect()}
    assert len(known - kept) <= len(known) / 200
    assert ppm_langid.keep_known(docs.limit(0)).count() == 0


# Quality rules


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_rules_are_brute_force(spark, documents):
    extra = frame(spark).select((F.coalesce("doc_id", F.lit(99)) + 10_000).alias("doc_id"), "text", "lang")
    more = spark.createDataFrame([(20_000, "a b c d e a b c d e a b c d e f\nq\nq\n \n", "en"), (20_001, "a a a a a a a", None)], "doc_id long, text string, lang string")
    df = documents.select("doc_id", "text", "lang").unionByName(extra).unionByName(more)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = js_quality.quality(df).collect()
    assert len(got) == df.count()
    for r in got:
        want = base(texts[r["doc_id"]])
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_distance_is_brute_force(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    got = df.select(js_quality.js_distance(F.col("p"), js_quality.neg_entropy(F.col("p")), F.col("q"), js_quality.neg_entropy(F.col("q"))).alias("d")).first()["d"]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    assert got == pytest.approx(((kl(p, m) + kl(q, m)) / 2) ** 0.5)


def test_quality_by_label(spark, documents, labels):
    found = js_quality.quality(documents).join(labels, "doc_id").where("not base_failed")
    rates = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.1
    assert js_quality.quality(empty(spark)).count() == 0
    df = frame(spark)
    assert js_quality.keep_good(df).columns == df.columns


# Near duplicates


def fp_by_hand(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_hand(documents):
    for t in [*(r[1] for r in ROWS), "a b c", "A b\tC d", *(r["text"] for r in documents.limit(40).collect())]:
        assert golay_simhash.fingerprint(t) == fp_by_hand(t)


def test_close_fingerprints_share_keys():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys = []
    for x in (a, b):
        found = [set() for _ in x]
        for r, k in zip(*golay_simhash.keys_of(x), strict=True):
            found[r].add(int(k))
        keys.append(found)
    assert all(x & y for x, y in zip(*keys, strict=True))


def components(fps):
    ids = sorted(fps)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in ids}


def test_components_are_brute_force(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 64, 300, dtype=np.uint64)]
    for i in range(200):  # chains, and a dense group
        near = fps[0] if i % 2 else fps[-1]
        for bit in rng.choice(64, 3, replace=False):
            near ^= 1 << int(bit)
        fps.append(near)
    fps += fps[:20]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    first = {}
    for i, x in enumerate(signed):
        first.setdefault(x, i)
    nodes = spark.createDataFrame([(x, i) for x, i in first.items()], "fp long, node long")
    got = {r["node"]: r["component"] for r in golay_simhash.components(golay_simhash.links(nodes)).collect()}
    want = components({i: fps[i] for i in first.values()})
    assert {i: got.get(i, i) for i in want} == want


def test_large_keys_are_dealt_anew(spark):
    rng = np.random.default_rng(8)
    # one whole segment and a codeword of the next in common: a key that all rows share
    fps = np.unique(rng.integers(0, 1 << 21, 3000, dtype=np.uint64) << np.uint64(43) | np.uint64(12345))
    signed = fps.view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, node long")
    got = {r["node"]: r["component"] for r in golay_simhash.components(golay_simhash.links(nodes, large=300)).collect()}
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    assert [got.get(i, i) for i in range(len(fps))] == label.tolist()


def test_near_duplicates_of_cases(spark):
    df = frame(spark)
    got = {r["doc_id"]: r for r in golay_simhash.near_duplicates(df).collect()}
    assert got[0]["fingerprint"] == "0" * 16 and {got[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert got[5]["component_id"] == 4
    kept = golay_simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "3", "4", "6", "7", "8", "None"]
    assert golay_simhash.near_duplicates(empty(spark)).count() == 0


def test_first_of_repeated_and_missing_ids(spark):
    texts = ["the first of the texts under one id is about ships and the sea", "quite another text under that id tells of mountains, snow and ice", "a third text without any id speaks of bread and butter for tea"]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (2, texts[1]), (None, texts[0]), (1, texts[0]), (3, texts[2].upper()), (None, "nobody else says what this row without an id says"), (None, "nobody else says what this row without an id says")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    kept = golay_simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", texts[0]), ("1", texts[1]), ("3", texts[2].upper()), ("None", rows[-1][1])])
    found = golay_simhash.near_duplicates(df.drop("fp")).collect()
    assert len(found) == len(rows) and len({r["fingerprint"] for r in found}) == 4
    assert Counter(r["component_id"] for r in found) == {1: 5, 3: 3, None: 2}


# Resampling


def test_kth_largest(spark):
    values = [((i * 7919) % 1009) / 7 - 60 for i in range(1009)] + [1e15, -1e15]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 2, 500, len(values)):
        least = importance_resampling.kth_largest(df, "v", k)
        assert df.where(importance_resampling._ordered(F.col("v")) >= least).count() == k
    assert importance_resampling.kth_largest(df, "v", len(values) + 1) is None


def test_weights_are_brute_force(spark):
    df = frame(spark).select("doc_id", "text")
    models = importance_resampling.count_models(df, F.col("doc_id") < 6)
    got = {r["bucket"]: (r["raw"], r["target"]) for r in models.collect()}
    raw, target = Counter(), Counter()
    for i, t, *_ in ROWS:
        data = np.frombuffer((t or "").encode(), np.uint8)
        if len(data) >= 4:
            found = Counter(importance_resampling._buckets(data, 4, 1 << 14).tolist())
            raw += found
            if i is not None and i < 6:
                target += found
    assert {b: x for b, x in got.items() if x != (0, 0)} == {b: (n, target[b]) for b, n in raw.items()}


def test_sampling_is_brute_force(spark, documents, labels):
    def bucket(gram):
        key = 0
        for b in gram:
            key = (key * 0x01000193 & 0xFFFFFFFF) ^ b
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> 18

    docs = documents.where("doc_id < 300").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text"))
    known = labels.where("doc_id < 300 and doc_id >= 10")
    target = {r["doc_id"] for r in known.where("quality = 1").collect()}
    rows = docs.select("doc_id", "text", importance_resampling.unit_hash("doc_id", F.xxhash64("text"), F.lit(7)).alias("u")).collect()
    grams = [[bucket(d[i : i + 4]) for i in range(len(d) - 3)] for d in ((r["text"] or "").encode() for r in rows)]
    raw, good = Counter(b for g in grams for b in g), Counter(b for r, g in zip(rows, grams, strict=True) for b in g if r["doc_id"] in target)
    all_raw, all_good = (sum(x.values()) + (1 << 14) for x in (raw, good))
    ratio = {b: np.log((good[b] + 1) / all_good / ((raw[b] + 1) / all_raw)) for b in raw}
    want = sorted((str(r["doc_id"]), sum(ratio[b] for b in g), len(g), sum(ratio[b] for b in g) - np.log(-np.log(r["u"]))) for r, g in zip(rows, grams, strict=True))
    found = importance_resampling.resample(docs, known, share=0.7).collect()
    got = sorted((str(r["doc_id"]), r["log_weight"], r["n_grams"], r["score"]) for r in found)
    assert [(i, n) for i, _, n, _ in got] == [(i, n) for i, _, n, _ in want]
    assert np.allclose([[w, x] for _, w, _, x in got], [[w, x] for _, w, _, x in want], atol=0.05)
    least = sorted((r["score"] for r in found), reverse=True)[round(0.7 * len(found)) - 1]
    assert all(r["kept"] == (r["score"] >= least - 1e-8) for r in found)


def test_resampling_by_label(spark, documents, labels):
    found = importance_resampling.resample(documents, labels)
    share = labels.agg(F.avg("quality")).first()[0]
    assert found.where("kept").count() == round(share * documents.count())
    rates = {r["quality"]: r["kept"] for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.2
    assert importance_resampling.resample(frame(spark), labels).count() == len(ROWS)
    assert importance_resampling.resample(empty(spark), labels.limit(0)).count() == 0


# Packing


def test_ids_are_the_tokenizers(documents):
    from tokenizers import Tokenizer

    file = bin_completion.tokenizer_path("word_bpe_49k.json")
    ours, theirs = bin_completion.Encoder(file), Tokenizer.from_file(file)
    for t in [*(r[1] or "" for r in ROWS), "It's 12½ o'clock, they'LL&&say*** ß ÿ µ ª", *(r["text"] for r in documents.limit(150).collect())] * 2:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    file = bin_completion.tokenizer_path("word_bpe_49k.json")
    ours, theirs = bin_completion.Encoder(file), Tokenizer.from_file(file)
    assert np.frombuffer(ours.encode("a page <|endoftext|> next"), "<u4").tolist() == [320, 2504, 49407, 1131]
    for t in ["<|startoftext|>", "x<|endoftext|>y <|startoftext|>", "日本 <|endoftext|>", "<|ENDOFTEXT|> a", "<|endoftext|", "< |endoftext|>", "a page <|endoftext|> next"] * 2:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def exact_bins(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in sorted({b: j for j, b in enumerate(bins)}.values()):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    lengths.sort(reverse=True)
    go(0, [])
    return best


def test_plans_are_optimal_on_small_bins():
    rng = np.random.default_rng(7)
    for _ in range(60):
        lengths = rng.integers(1, 21, int(rng.integers(1, 11))).tolist()
        plan = bin_completion.plan(Counter(lengths), 20)
        assert sum((Counter({x: n * p.times for x, n in p.fill.items()}) for p in plan), Counter()) == Counter(lengths)
        assert all(sum(x * n for x, n in p.fill.items()) <= 20 for p in plan)
        assert sum(p.times for p in plan) == exact_bins(lengths, 20)


def test_best_fit_takes_the_tightest():
    rng = np.random.default_rng(11)
    for _ in range(60):
        lengths = rng.integers(1, 31, int(rng.integers(1, 80))).tolist()
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= x), default=None)
            if fit is None:
                rooms.append(30 - x)
            else:
                rooms[rooms.index(fit)] -= x
        plan = bin_completion._best_fit(Counter(lengths), 30)
        assert sorted(30 - sum(x * n for x, n in p.fill.items()) for p in plan for _ in range(p.times)) == sorted(rooms)


def test_plans_are_optimal_past_the_cuts():
    rng = np.random.default_rng(13)
    for k in range(40):
        lengths = []
        for _ in range(int(rng.integers(3, 7))):  # whole sequences cut at random: the bound is reached
            cuts = np.sort(rng.choice(np.arange(1, 1000), int(rng.integers(2, 6)), replace=False))
            lengths += np.diff([0, *cuts, 1000]).tolist()
        plan = bin_completion.plan(Counter(lengths), 1000)
        assert sum((Counter({x: n * p.times for x, n in p.fill.items()}) for p in plan), Counter()) == Counter(lengths)
        assert sum(p.times for p in plan) == sum(lengths) // 1000, k


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, documents):
    rows = bin_completion.pack(documents).collect()
    n = check_places(rows, 2048)
    assert n == -(-sum(r["length"] for r in rows) // 2048)
    df = frame(spark)
    rows = bin_completion.pack(df).collect()
    check_places(rows, 2048)
    assert sorted((r["doc_id"], r["length"]) for r in rows if r["doc_id"] in (0, 1, 2)) == [(0, 1), (1, 1), (2, 1)]
    assert len([r for r in rows if r["doc_id"] == 5]) == 2
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 3)
    assert all(start == 2048 * piece for piece, start, _ in long) and all(n == 2048 for *_, n in long[:-1])
    assert bin_completion.pack(empty(spark)).count() == 0


# Toxicity


def test_toxicity_of_rows_held_out(spark, documents, labels):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity_chain.fit(documents, labels.where("doc_id % 2 = 0"))
    found = toxicity_chain.predict(documents, chain).select("doc_id", F.col("toxic").alias("said")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    # some of the labels go against the text, and the sample is a few hundred rows; on the rows learned from it is over 0.99
    assert found.where("toxic = 1 and said").count() / found.where("toxic = 1").count() > 0.8
    assert found.where("toxic = 0 and said").count() / found.where("toxic = 0").count() < 0.01


def test_toxicity_of_cases(spark, documents, labels):
    chain = toxicity_chain.fit(documents, labels)
    rows = frame(spark)
    found = toxicity_chain.predict(rows.unionByName(rows), chain)
    assert found.count() == 2 * len(ROWS) and found.distinct().count() <= len(ROWS)
    nobody = toxicity_chain.classify(rows, labels.limit(0))
    assert nobody.count() == len(ROWS) and nobody.where("toxic").count() == 0
    assert toxicity_chain.classify(empty(spark), labels).count() == 0


def test_chain_is_brute_force(spark, documents, labels):
    chain = toxicity_chain.fit(documents, labels)
    docs = documents.where("doc_id < 60").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text"))
    got = sorted((str(r["doc_id"]), r["p_low_quality"], r["p_toxic"]) for r in toxicity_chain.predict(docs, chain).collect())

    def by_hand(text):
        text = text or ""
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        words |= {w[:n] + "-" for w in words for n in (3, 5, 7) if len(w) > n}
        less = lambda chars: sum(c in chars for c in text) / max(len(text), 1)
        x = [*(float(w in words) for w in chain.words), less("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), less("#*$%&|<>!"), np.log1p(len(text))]
        out = []
        for m in chain.models:
            p = m if isinstance(m, float) else 1 / (1 + np.exp(-(np.dot(m.coefficients.toArray(), x + out) + m.intercept)))
            out.append(p)
        return out

    want = sorted((str(r["doc_id"]), *by_hand(r["text"])) for r in docs.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-6)


def test_stage_learns_from_every_labelled_text(spark, monkeypatch):
    rows = [(i, f"word{i} " + "some plain english text about nothing much " * 3, "en") for i in range(1200)]
    rows += [(5000 + i, f"mot{i} " + "un texte simple qui ne parle de presque rien " * 3, "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept, real = [], ppm_langid.predict
    monkeypatch.setattr(ppm_langid, "predict", lambda df, trees, **more: kept.append(trees) or real(df, trees, **more))
    assert ppm_langid.keep_known(docs).count() == len(rows)
    learned = docs.where(~ppm_langid.held_out()).select(F.sum(F.octet_length("text"))).first()[0]
    assert int(kept[-1].n.sum()) == learned  # a run of four bytes for each byte


def test_small_tables_are_few_files_whatever_the_partitions(spark, documents):
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    listed = lambda: set(glob.glob(f"{common.shared_folder(spark).removeprefix('file:')}/*/part-*"))
    old = listed()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kept = golay_simhash.keep_first(documents.limit(300))
        assert kept.rdd.getNumPartitions() <= common.twice_the_cores(spark)
        assert kept.count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = Counter(f.split("/")[-2].rsplit("-", 1)[0] for f in listed() - old)
    rounds = {f.split("/")[-2] for f in listed() - old if "/stars-" in f or "/links-" in f}
    assert files["nodes"] <= common.twice_the_cores(spark) and files["key-links"] <= common.twice_the_cores(spark)
    assert rounds and files["stars"] + files["links"] == len(rounds)
