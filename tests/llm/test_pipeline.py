import glob
from collections import Counter

import corpus_pipeline
import pytest
from cases import EXTRA, ROWS, empty, frame

from pyspark.sql import functions as F

from punctual.llm import common, golay_simhash, js_quality, ppm_langid


def test_stages_do_their_whole_work(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "best_fit_packing"]
    a, b, c, d = (f for _, f in corpus_pipeline.STAGES)
    good = a(spark, documents, "")
    assert good.columns == documents.columns
    want = js_quality.quality(documents).where("kept").select("doc_id")
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in want.collect())
    known = b(spark, good, "")
    assert known.columns == documents.columns and known.count() == ppm_langid.identify(good).where("lang_pred != 'und' and score >= 0.5").count()
    first = c(spark, known, "")
    groups = golay_simhash.near_duplicates(known)
    assert sorted(r[0] for r in first.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    assert {r[0] for r in d(spark, first, "").select("doc_id").collect()} == {r[0] for r in first.select("doc_id").collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_odd_rows(spark, documents):
    docs = frame(spark, extra=False).select(*documents.columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    docs.collect()


@pytest.mark.parametrize("k", range(4))
def test_every_stage_bears_empty_tables_and_clashing_columns(spark, k):
    """Each stage on its own: extra columns stay (but for the last stage), also those it has names of its own for; no row of an empty table."""
    name, stage = corpus_pipeline.STAGES[k]
    df = frame(spark).withColumns({"row": F.lit("clash"), "fine": F.lit(1)})
    out = stage(spark, df, "")
    assert stage(spark, empty(spark), "").count() == 0
    if k < 3:
        assert out.columns == df.columns
        rows = [r.asDict() for r in out.collect()]
        assert all(r[c] == "clash" for r in rows for c in EXTRA if c != "key") and all(r["row"] == "clash" for r in rows)
    else:
        assert {r["doc_id"] for r in out.select("doc_id").collect()} >= {r[0] for r in ROWS if r[1] and r[1].strip()}


def test_stages_write_few_files_however_many_parts_the_rows_come_in(spark, documents):
    """A file costs a process on a local file system: tables between and within stages have no more parts than twice the cores (or 10,000 rows each)."""
    listed = lambda: set(glob.glob(f"{common.shared_folder(spark).removeprefix('file:')}/*/part-*"))
    docs, most = documents.repartition(5 * common.twice_the_cores(spark)), common.twice_the_cores(spark)
    for _, stage in corpus_pipeline.STAGES:
        old = listed()
        out = stage(spark, docs, "")
        assert out.rdd.getNumPartitions() <= most
        files = Counter(f.split("/")[-2] for f in listed() - old)
        assert files and max(files.values()) <= most


def test_stages_decide_by_the_row(spark):
    """Copies: near-dedup leaves one of them; other stages treat them alike. Null and empty texts don't pass the language stage."""
    text = "the house of the river and the old road to the town is near the wood, where we went with a friend in the spring"
    rows = [(i, text + (" and home" if i > 5 else ""), "en", "s", 1) for i in range(9)] + [(20, None, "en", "s", 0), (21, "", "en", "s", 0), (22, "12 34 !!", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert known == set(range(9))
    first = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs.where("doc_id < 6"), "").collect()]
    assert first == [0]
