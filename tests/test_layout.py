import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.operators import aggregates, graph, joins, sketches
from punctual.sources import readers
from punctual.streaming.ingest import ingest_new_files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Sketches


def measured(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=int(i % 60)), "ab"[i % 2], int(rng.integers(30_000)), float(rng.gamma(2.0, 10.0)) if i % 13 else None) for i in range(60_000)]
    return spark.createDataFrame(rows, "day date, g string, user long, v double")


def test_months_from_days_keep_the_stated_errors(spark, tmp_path):
    df = measured(spark)
    sketches.sketch(df, ["day", "g"], distinct=["user"], quantiles=["v"]).write.parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    months = sketches.merged(stored, [F.month("day").alias("m"), "g"])
    got = months.select("m", "g", "n", sketches.distinct_count("user").alias("users"), *[sketches.quantile("v", q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))])
    assert str(tmp_path / "days") in plan_of(got) and "ExistingRDD" not in plan_of(got)  # no events
    data = df.withColumn("m", F.month("day")).toPandas()
    rows = got.collect()
    assert len(rows) == 4
    for r in rows:
        part = data[(data.m == r["m"]) & (data.g == r["g"])]
        assert r["n"] == len(part) and abs(r["users"] - part.user.nunique()) <= sketches.distinct_error() * part.user.nunique()
        v = part.v.dropna()
        for i, q in enumerate((0.1, 0.5, 0.9)):
            assert (v < r[f"q{i}"]).mean() - sketches.rank_error() <= q <= (v <= r[f"q{i}"]).mean() + sketches.rank_error()
    box = sketches.box(months, ["m", "g"], "v").collect()
    for r in box:
        v = data[(data.m == r["m"]) & (data.g == r["g"])].v
        assert r["q0"] == v.min() and r["q100"] == v.max()


def test_histogram_from_sketches(spark):
    df = measured(spark)
    got = {r["bin"]: r["n"] for r in sketches.bins(sketches.sketch(df, [], quantiles=["v"]), [], "v", 0.0, 60.0, 6).collect()}
    v = df.toPandas().v.dropna()
    most = 2 * sketches.rank_error() * len(v) + 1
    for i in range(8):
        lo, hi = (-np.inf if i == 0 else (i - 1) * 10.0), (np.inf if i == 7 else i * 10.0)
        assert abs(got.get(i, 0) - ((v > lo) & (v <= hi)).sum()) <= most
    assert abs(sum(got.values()) - len(v)) <= 8
    nothing = sketches.sketch(df.where("v IS NULL"), ["g"], distinct=["user"], quantiles=["v"])
    assert {r["q"] for r in nothing.select(sketches.quantile("v", 0.5).alias("q")).collect()} == {None}
    assert sketches.bins(nothing, ["g"], "v", 0.0, 1.0, 2).count() == 0


# Ranks


def ranks_by_hand(edges, alpha, iters):
    ids = sorted({x for s, d, _ in edges for x in (s, d) if x is not None})
    out = {i: sum(w for s, d, w in edges if s == i and d is not None) for i in ids}
    rank = {i: 1 / len(ids) for i in ids}
    for _ in range(iters):
        lost = sum(rank[i] for i in ids if not out[i])
        new = {i: alpha / len(ids) + (1 - alpha) * lost / len(ids) for i in ids}
        for s, d, w in edges:
            if d is not None:
                new[d] += (1 - alpha) * rank[s] * w / out[s]
        rank = new
    return rank


@pytest.mark.parametrize("hub_links", [5, 1_000_000])
def test_ranks_are_brute_force(spark, hub_links):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.zipf(1.7, 400) % 60, rng.integers(0, 80, 400), rng.integers(1, 5, 400), strict=True)] + [(99, None, None), (98, None, None)]
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    got = {r["id"]: r["rank"] for r in graph.pagerank(df, 0.2, 4, hub_links=hub_links).collect()}
    want = ranks_by_hand(edges, 0.2, 4)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    settled = {r["id"]: r["rank"] for r in graph.pagerank(df, 0.2, 200, tolerance=1e-4).collect()}
    assert all(abs(settled[i] - x) < 1e-3 for i, x in ranks_by_hand(edges, 0.2, 200).items())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_a_round_has_one_exchange(spark):
    edges = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") * 7 % 2000).alias("dst"), F.lit(1).alias("weight"))
    with graph.stored_links(edges) as stored:
        table = graph.BucketedTable.write(graph.init_ranks(edges), "id", stored.buckets)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = plan_of(table.read().select("id").join(graph.followed(table.read(), stored, ["rank"]), "id", "left"))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
            table.drop()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1, plan


# Paths


def distances(edges, source):
    import heapq

    known, todo = {}, [(0.0, source)]
    while todo:
        d, x = heapq.heappop(todo)
        if x not in known:
            known[x] = d
            todo += [(d + w, b) for a, b, w in edges if a == x and b not in known]
            heapq.heapify(todo)
    return known


@pytest.mark.parametrize("delta", [None, 0.5, 3.0, 1e9])
def test_paths_are_brute_force(spark, delta):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 160), rng.integers(0, 45, 160), rng.choice([0.0, 0.25, 1.0, 2.5, 9.0], 160), strict=True)]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    got = {r["id"]: r["distance"] for r in graph.delta_stepping(df, 0, delta=delta).collect()}
    assert got == distances(edges, 0)
    with pytest.raises(ValueError):
        graph.delta_stepping(df.withColumn("weight", -F.col("weight")), 0)


def test_buckets_save_work_on_a_chain_with_shortcuts(spark):
    """Every node of a cheap chain also has an expensive edge far ahead, which the other search follows again and again."""
    n = 24
    edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, j, 5.0 * (j - i)) for i in range(n) for j in range(i + 2, n)]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    rounds = []
    got = {r["id"]: r["distance"] for r in graph.delta_stepping(df, 0, delta=30.0, watch=lambda *x: rounds.append(x)).collect()}
    assert got == distances(edges, 0) == {i: float(i) for i in range(n)}
    # heavy edges are followed once, at the end of the one bucket
    assert [k for k, _ in rounds].count("heavy") == 1 and len(rounds) <= n + 1


def test_degree_report(spark):
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (1, 4, 1), (2, 1, 1), (2, 3, 1), (3, 1, 1), (9, None, None)], "src int, dst int, weight int")
    rows = graph.degree_report(edges, top=3, sampled=4).collect()
    assert [(r["place"], r["id"], r["out_degree"]) for r in rows if r["kind"] == "top"] == [(1, 1, 3), (2, 2, 2), (3, 3, 1)]
    assert len([r for r in rows if r["kind"] == "sample"]) == 4


# Correlation


def test_a_hundred_columns_in_one_aggregate(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 100)) + rng.normal(size=(300, 1))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(100)])
    got = np.zeros((100, 100))
    for r in aggregates.corr_wide(df, df.columns).collect():
        got[int(r["a"][1:]), int(r["b"][1:])] = r["r"]
    assert np.allclose(got, np.corrcoef(x.T))
    empty = aggregates.corr_wide(df.limit(0), ["c0", "c1"]).collect()
    assert {r["r"] for r in empty} == {None} and len(empty) == 4


# Files


def files(spark, tmp_path):
    for k in ("KSFO", "kjfk", "Klax", "none"):
        folder = tmp_path / "in" / ("a" if k < "a" else "b")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.2020.csv").write_text("x,y\n" + "".join(f"{k}{i},{i}\n" for i in range(3)))
    return str(tmp_path / "in")


def test_only_wanted_files_are_opened(spark, tmp_path):
    path = files(spark, tmp_path)
    listed = readers.list_files(spark, path)
    assert sorted(r["key"] for r in listed.collect()) == ["kjfk", "klax", "ksfo", "none"]
    keys = spark.createDataFrame([("ksfo",), ("KLAX",), ("elsewhere",)], "id string")
    df = readers.read_keyed_files(spark, path, keys, "id", schema="x string, y int")
    assert {f.rsplit("/", 1)[1] for f in df.inputFiles()} == {"KSFO.2020.csv", "Klax.2020.csv"}
    opened = {r[0].rsplit("/", 1)[1] for r in df.select(F.input_file_name()).distinct().collect()}
    assert opened == {"KSFO.2020.csv", "Klax.2020.csv"}
    assert sorted((r["file_key"], r["x"]) for r in df.collect()) == sorted((k.lower(), f"{k}{i}") for k in ("KSFO", "Klax") for i in range(3))
    none = readers.read_keyed_files(spark, path, keys.limit(0), "id", schema="x string, y int")
    assert none.count() == 0 and none.columns == ["x", "y", "file_key"]


def test_each_file_is_ingested_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    put = lambda k: (source / f"{k}.csv").write_text("n,y\n" + "".join(f"{100 * k + i},{2015 + i % 2}\n" for i in range(10)))
    run = lambda prepare=None: ingest_new_files(spark, str(source), out, state, schema="n int, y int", by=["y"], prepare=prepare, files_at_once=1)
    seen = lambda: sorted(r["n"] for r in spark.read.parquet(out).collect())
    for k in range(3):
        put(k)
    broken = lambda df: df.withColumn("n", F.when(F.col("n") == 105, F.raise_error(F.lit("stop"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stop"):
        run(broken)
    assert run() >= 1 and seen() == [100 * k + i for k in range(3) for i in range(10)]
    assert run() == 0 and len(seen()) == 30
    put(3)
    assert run() == 1 and seen() == [100 * k + i for k in range(4) for i in range(10)]


# Joins


def test_stored_readings_are_pruned_by_day(spark, tmp_path):
    hours = spark.range(24 * 90).select((F.col("id") % 5).alias("station"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("hour"), F.col("id").alias("v")).withColumn("day", F.to_date("hour"))
    hours.write.partitionBy("day").parquet(str(tmp_path / "hours"))
    spark.range(5000).select("id", (F.col("id") % 5).alias("s"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1555).alias("ts")).write.parquet(str(tmp_path / "facts"))
    stored, facts = spark.read.parquet(str(tmp_path / "hours")), spark.read.parquet(str(tmp_path / "facts")).where("ts >= '2024-02-01' AND ts < '2024-02-10'")
    at = F.date_trunc("hour", F.col("ts"))
    got = joins.stored_hour_join(facts, stored, entity="station", hour="hour", day="day", roles={"own": "s"}, fact_hour=at)
    want = joins.hour_join(facts, stored.drop("day"), entity="station", hour="hour", roles={"own": "s"}, fact_hour=at)
    assert sorted(map(tuple, got.select("id", "own_v").collect())) == sorted(map(tuple, want.select("id", "own_v").collect())) and want.count() > 50
    assert "dynamicpruning" in plan_of(got)
    got.write.format("noop").mode("overwrite").save()
    days = spark.read.parquet(str(tmp_path / "hours")).join(F.broadcast(facts.select(F.to_date("ts").alias("day")).distinct()), "day", "left_semi")
    assert days.select("day").distinct().count() == 9


def brute_neighbours(a, b, k, miles):
    from math import asin, cos, radians, sin, sqrt

    want = set()
    for i, la, lo in a:
        near = []
        for j, lb, lp in b:
            h = sin(radians(lb - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lb)) * sin(radians(lp - lo) / 2) ** 2
            if (d := 2 * 3958.756 * asin(sqrt(min(1, h)))) <= miles:
                near.append((d, j))
        want |= {(i, j, r) for r, (_, j) in enumerate(sorted(near)[:k], 1)}
    return want


@pytest.mark.parametrize(("k", "miles", "most"), [(1, 20.0, 4), (5, 60.0, 10), (5, 5.0, 3), (3, 2000.0, 16)])
def test_neighbours_on_an_adaptive_grid(spark, k, miles, most):
    rng = np.random.default_rng(13)
    city = lambda n, s: [(float(40.7 + x), float(-74.0 + y)) for x, y in rng.normal(0, s, (n, 2))]
    spread = [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for _ in range(60)]
    odd = [(10.0, 179.99), (10.01, -179.99), (89.9, 0.0), (89.9, 170.0), (-90.0, 0.0), (90.0, 180.0), (0.0, 0.0), (40.7, -74.0), (40.7, -74.0)]
    a = [(i, *p) for i, p in enumerate(city(50, 0.02) + city(20, 1.5) + spread[:25] + odd)]
    b = [(i, *p) for i, p in enumerate(city(250, 0.01) + city(60, 1.0) + spread[25:] + odd)]
    frames = [spark.createDataFrame([*x, (-1, None, 1.0)], f"{n} int, lat double, lon double") for n, x in (("a", a), ("b", b))]
    got = joins.knn_adaptive(*frames, left_key="a", right_key="b", k=k, miles=miles, most=most).collect()
    assert {(r["a"], r["b"], r["rank"]) for r in got} == brute_neighbours(a, b, k, miles)


def test_no_leaf_holds_too_much(spark):
    rng = np.random.default_rng(14)
    places = [(float(40 + x), float(-74 + y)) for x, y in rng.normal(0, 0.05, (3000, 2))] + [(1.0, 1.0)] * 30
    tree = joins.quadtree(spark.createDataFrame(places, "lat double, lon double"), most=20)
    leaves = tree.where("leaf").collect()
    assert sum(r["n"] for r in leaves) == len(places)
    assert all(r["n"] <= 20 or r["level"] == joins.LEVELS for r in leaves) and max(r["level"] for r in leaves) > 8


def test_bfs_query_goes_two_steps_as_its_sql(spark, tmp_path):
    import duckdb

    from punctual.plans import queries  # noqa: F401  it fills the registry
    from punctual.plans.registry import QUERIES, SQL

    links = [(0, 0), (50, 0), (50, 10), (5, 10)]  # from 0 to 5 in four steps
    for more, there in ([], 0), ([(7, 0)], 1):
        folder = tmp_path / str(there)
        spark.createDataFrame(links + more, "l_suppkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
        c = duckdb.connect()
        c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
        got = [tuple(r) for r in QUERIES["r5_bfs"](spark, str(folder)).collect()]
        assert len(got) == there and got == c.sql(SQL["r5_bfs"]).fetchall()


def test_edges_are_summed_up_in_as_many_tasks_as_their_number_needs(spark, monkeypatch):
    from punctual.plans import queries
    from punctual.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert queries._edge_tasks(t) is None
    want = sorted(queries._edges(t).collect())
    few = sorted(graph.delta_stepping(queries._edges(t), 0).collect())
    monkeypatch.setattr(queries, "FEW_LINES", 100)
    monkeypatch.setattr(queries, "LINES_PER_TASK", 500)
    tasks = queries._edge_tasks(t)
    assert tasks == -(-t.lineitem.count() // 500)
    edges = queries._edges(t)
    assert edges.rdd.getNumPartitions() >= tasks and sorted(edges.collect()) == want
    assert sorted(graph.delta_stepping(edges, 0, tasks=tasks).collect()) == few and few
    lonely = spark.createDataFrame([(1, 2, 1.0), (7, None, None)], "src long, dst long, weight double")
    assert [tuple(r) for r in graph.delta_stepping(lonely, 7, tasks=3).collect()] == [(7, 0.0)]
    assert graph.delta_stepping(lonely, 9).count() == 0


def test_keyed_files_are_no_more_than_networks(spark, monkeypatch, tmp_path):
    from punctual.plans import layout_queries
    from punctual.plans.registry import QUERIES

    users = [*range(3000), *range(0, 3000, 5), None]
    spark.createDataFrame([(i, u) for i, u in enumerate(users)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(layout_queries, "NETWORKS", 14)
    stored, opened = tmp_path / "stored", []
    monkeypatch.setattr(layout_queries, "place", lambda t: str(stored))
    read = readers.read_keyed_files
    monkeypatch.setattr(readers, "read_keyed_files", lambda *a, **b: opened.append(df := read(*a, **b)) or df)
    got = {r["user_id"]: (r["n"], r["ids"]) for r in QUERIES["s9_keyed_files"](spark, str(tmp_path)).collect()}
    want = {}
    for i, u in enumerate(users):
        if u is not None and u % 7 == 3:
            n, ids = want.get(u, (0, 0))
            want[u] = n + 1, ids + i
    assert got == want
    assert len(list(stored.glob("network=*"))) == 15  # those without a user lie apart
    assert {r["file_key"] for r in opened[0].select("file_key").distinct().collect()} == {"net3", "net10"}
