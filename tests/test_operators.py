import datetime as dt

import pytest
from pyspark.sql import functions as F

from punctual.operators import aggregates, folds, graph, joins, metrics, relational, sampling, tuning, windows
from punctual.sources import readers, sinks
from punctual.streaming.hourly import streaming_rollup

START = dt.datetime(2015, 1, 1)


def test_prior_flag(spark):
    rows = [("T1", 0, 1), ("T1", 8100, 1), ("T1", 16201, 0), ("T1", 24302, 1), ("T2", 80000, 1), ("T2", 90000, 1), (None, 1, 1), (None, 20000, 1)]
    df = spark.createDataFrame([(k, START + dt.timedelta(seconds=s), x, i) for i, (k, s, x) in enumerate(rows)], "k string, ts timestamp, y int, i int")
    for one_pass in (False, True):
        got = windows.prior_flag(df, "k", "ts", "y", one_pass=one_pass).orderBy("i").collect()
        assert [r["prior_flag"] for r in got] == [0, 0, 1, 0, 0, 0, 0, 0]


def test_prior_band_is_brute_force(spark):
    rows = [(i, i % 3, START + dt.timedelta(seconds=(i * 7919) % 200000), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, k int, ts timestamp, v double")
    got = {r["i"]: r["prior_gap"] for r in joins.prior_event_band(df, "k", "ts", "v").collect()}
    for i, k, ts, _ in rows:
        gaps = [(ts - t).total_seconds() for _, q, t, _ in rows if q == k and 8100 < (ts - t).total_seconds() < 86400]
        assert got[i] == (min(gaps) if gaps else None)


def test_not_in_with_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r["k"] for r in relational.anti_filter(df, keys, "k").collect()] == [2]


@pytest.mark.parametrize("miles", [5.0, 60.0])
def test_neighbours_are_brute_force(spark, miles):
    from math import asin, cos, radians, sin, sqrt

    place = lambda i, m: (i, -89.0 + (i * m % 1780) / 10, -180 + (i * 977 % 3600) / 10)
    a, b = [place(i, 37) for i in range(120)], [place(i, 41) for i in range(400)]
    a += [(500, 10.0, 179.99), (501, 89.9, 0.0)]
    b += [(900, 10.0, -179.99), (901, 89.9, 170.0)]
    got = joins.knn_within(spark.createDataFrame(a, "a int, lat double, lon double"), spark.createDataFrame(b, "b int, lat double, lon double"), left_key="a", right_key="b", miles=miles)
    found = {(r["a"], r["b"]) for r in got.collect()}
    want = set()
    for i, la, lo in a:
        near = []
        for j, lb, lp in b:
            h = sin(radians(lb - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lb)) * sin(radians(lp - lo) / 2) ** 2
            if (d := 2 * 3958.756 * asin(sqrt(min(1, h)))) <= miles:
                near.append((d, j))
        want |= {(i, j) for _, j in sorted(near)[:5]}
    assert found == want


def test_folds(spark):
    df = spark.createDataFrame([(dt.date(y, 3 * q - 1, 1),) for y in range(2015, 2019) for q in range(1, 5)], "d date")
    sizes = {k: [(f.where("cv = 'train'").count(), f.where("cv = 'test'").count()) for f in folds.folds(df, k, "d").values()] for k in ("none", "rolling", "years", "quarters")}
    assert sizes == {"none": [(12, 4)], "rolling": [(4, 4), (8, 4), (12, 4)], "years": [(4, 4)] * 2, "quarters": [(1, 1)] * 8}
    for k in sizes:
        for f in folds.folds(df, k, "d").values():
            last, first = f.agg(F.max(F.when(F.col("cv") == "train", F.col("d"))), F.min(F.when(F.col("cv") == "test", F.col("d")))).first()
            assert last < first


EDGES = [("A", "B"), ("A", "D"), ("B", "C"), ("B", "E"), ("C", "D"), ("D", "E"), ("E", "A"), ("E", "B"), ("E", "C")]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")


def ranks(df):
    return {r["id"]: r["rank"] for r in df.collect()}


def test_pagerank(spark):
    e = edges(spark, EDGES)
    assert ranks(graph.pagerank(e, 0.15, 10)) == pytest.approx({"A": 0.11472372, "B": 0.16378689, "C": 0.18462851, "D": 0.23628147, "E": 0.30057942}, abs=1e-7)
    assert ranks(graph.steady_state(e, 60)) == pytest.approx({"A": 0.10526316, "B": 0.15789474, "C": 0.18421053, "D": 0.23684211, "E": 0.31578947}, abs=1e-7)
    dangling = ranks(graph.pagerank(edges(spark, [("A", "B"), ("A", "C"), ("B", "C")]), 0.15, 3))
    assert dangling == pytest.approx({"A": 0.19617901, "B": 0.28599961, "C": 0.51782137}, abs=1e-7)
    assert sum(dangling.values()) == pytest.approx(1)
    assert sum(ranks(graph.pagerank(e, 0.15, 100, tolerance=1e-3)).values()) == pytest.approx(1)


def test_paths(spark):
    e = edges(spark, EDGES)
    assert {r["id"]: r["distance"] for r in graph.sssp(e, "A").collect()} == {"A": 0, "B": 1, "D": 1, "C": 2, "E": 2}
    ids = graph.nodes(e)
    assert [r["path"] for r in graph.bfs(e, ids.where("id = 'A'"), ids.where("id = 'E'")).collect()] == [["A", "B", "E"]]
    assert graph.bfs(e, ids.where("id = 'A'"), ids.where("id = 'X'")).count() == 0


def test_segments_are_single_ones(spark):
    df = spark.createDataFrame([(i % 4, i % 2, (i // 3) % 2) for i in range(60)] + [(9, 1, 1)], "s int, y int, p int")
    got = {r["s"]: r["fbeta"] for r in metrics.segment_metrics(df, ["s"], "y", "p").collect()}
    assert set(got) == {0, 1, 2, 3, 9}
    for s, x in got.items():
        assert metrics.FBetaEvaluator(labelCol="y", predictionCol="p").evaluate(df.where(F.col("s") == s)) == x


def test_samples_repeat(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a, b = (sampling.undersample(df, "y", 3, ["id"]).collect() for _ in range(2))
    assert sorted(a) == sorted(b)
    assert sum(r["y"] for r in a) == 100
    assert sampling.DownSampler(labelCol="y", keyCols=["id"]).transform(df).count() == len(a)
    assert sampling.oversample(df, "y", 3).count() == 1200


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2015, "a", 1.0), (2016, "b", 2.0)], "y int, s string, v double")
    at = lambda n: str(tmp_path / n)
    sinks.write_partitioned(df, at("p"), ["y"])
    sinks.append_partitioned(df, at("p"), ["y"])
    assert readers.read_parquet(spark, at("p"), cols=["s"]).count() == 4
    sinks.write_csv(df, at("c"))
    assert readers.read_reference_csv(spark, at("c")).schema["v"].dataType.simpleString() == "double"
    assert readers.read_csv_opts(spark, at("c"), "y int, s string, v double", header="true").where("v = 2").count() == 1
    for _ in range(2):
        sinks.append_log(df, at("l"))
    assert spark.read.parquet(at("l")).count() == 4
    sinks.write_single(df, at("s"))
    with pytest.raises(ValueError):
        sinks.write_single(df, at("s2"), most_rows=1)
    sinks.write_text(df.select(F.col("s").alias("value")), at("t"))
    sinks.save_predictions({"a": df, "b": df}, at("m"))
    assert readers.read_parquet(spark, at("m/*")).count() == 4
    (tmp_path / "g").write_text("A\t{'B': 2, 'C': 1}\nC\t{}\n")
    assert sorted(map(tuple, readers.read_adjacency_text(spark, at("g")).collect()), key=str) == [("A", "B", 2), ("A", "C", 1), ("C", None, None)]
    (tmp_path / "i").write_text("Title\t7\t1\t2\n")
    assert readers.read_index_text(spark, at("i")).first()["id"] == 7
    (tmp_path / "w" / "x").mkdir(parents=True)
    (tmp_path / "w" / "x" / "a.csv").write_text("STATION,DATE\n1,2015-01-01T00:10:00\n")
    assert readers.read_weather_csv(spark, at("w")).first()["year"] == 2015
    assert readers.json_to_df(spark, {"a": {"b": 1}}, "a struct<b: int>").first()["a"]["b"] == 1
    with sinks.cached(df) as kept:
        assert sinks.checkpointed(kept).count() == 2


def test_schema_diff(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(1, 2)], "a int, c int")
    assert {tuple(r) for r in relational.schema_diff(a, b).collect()} == {("left", "b::string"), ("right", "c::int")}
    assert {tuple(r) for r in aggregates.type_census(a).collect()} == {("int", 1), ("string", 1)}


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    for k in (1, 2):
        tuning.record_run(spark.createDataFrame([("m", dt.datetime(2020, 1, k), float(k))], "model string, ts timestamp, score double"), path)
    assert [r["score"] for r in tuning.latest_runs(spark.read.parquet(path)).collect()] == [2.0]


def test_stream_is_batch(spark, tmp_path):
    rows = [(i % 3, START + dt.timedelta(minutes=7 * i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming_rollup(stream, "k", "ts", ["v"], ["v"]).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    from punctual.functions.timeops import ceil_hour

    want = aggregates.hourly_rollup(df.withColumn("hour", ceil_hour(F.col("ts"))), "k", "hour", ["v"], ["v"])
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, want.select("k", "hour", "avg_v", "v").collect()))


@pytest.mark.parametrize("how", ["knn_within", "knn_adaptive"])
def test_crowded_places_are_searched_for_once(spark, monkeypatch, how):
    met = spark.sparkContext.accumulator(0)

    def counted(*_):
        @F.udf("double", useArrow=False)
        def one(lat, lon, lat2, lon2):
            met.add(1)
            return abs(lat - lat2) + abs(lon - lon2)

        return one(*_[:4])

    monkeypatch.setattr(joins, "haversine", counted)
    a = spark.range(60).select(F.col("id").alias("a"), F.lit(40.0).alias("lat"), F.lit(-100.0).alias("lon"))
    b = spark.range(60).select(F.col("id").alias("b"), F.lit(40.0).alias("lat"), F.lit(-100.0).alias("lon"))
    got = getattr(joins, how)(a, b, left_key="a", right_key="b", k=3, miles=5.0).collect()
    assert sorted((r["a"], r["b"], r["rank"]) for r in got) == [(i, k, k + 1) for i in range(60) for k in range(3)]
    assert met.value <= 100  # not 3600 pairs
