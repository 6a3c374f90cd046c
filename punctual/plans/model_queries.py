"""Fitted models and whole pipelines over the driver's tables; what they learn SQL can't say."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import parse, timeops
from punctual.operators import aggregates as agg
from punctual.operators import features, folds, metrics, recommend, relational, sampling, tuning
from punctual.plans import pipelines
from punctual.plans.queries import KEYS, READINGS, SKY, ZONES, returns
from punctual.plans.registry import Tables, query
from punctual.plans.store_queries import place

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _train(t: Tables) -> DataFrame:
    x = returns(t).withColumn("label", parse.flag((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 40)))
    return features.assemble(x.select(*KEYS, *COLS, "label", "l_shipdate"), COLS, "label")


def _scored(model, rows: DataFrame, name: str) -> DataFrame:
    out = metrics.metrics(model.transform(rows), "label", "prediction")
    return out.select(F.lit(name).alias("model"), "tp", "tn", "fp", "fn", F.round("fbeta", 4).alias("fbeta"), F.round("accuracy", 4).alias("accuracy"))


@query()
def l1_logistic_regression(t: Tables) -> DataFrame:
    rows = agg.class_weights(_train(t), "label")
    return _scored(tuning.train_lr(rows, weight="weight", maxIter=20), rows, "lr")


@query()
def l2_random_forest(t: Tables) -> DataFrame:
    rows = _train(t)
    return _scored(tuning.train_rf(rows, trees=10, depth=5), rows, "rf")


@query()
def l3_boosted_trees(t: Tables) -> DataFrame:
    rows = _train(t)
    return _scored(tuning.train_gbt(rows, maxIter=5, maxDepth=3), rows, "gbt")


@query()
def l4_depth_sweep(t: Tables) -> DataFrame:
    train, test = relational.time_split(_train(t), "l_shipdate", "1999-01-01")
    return tuning.depth_sweep(train, test, metrics.FBetaEvaluator(), [1, 3, 5])


@query()
def l8_als_top_items(t: Tables) -> DataFrame:
    """The three parts each customer segment's buyers would rate highest by quantity, for suppliers as users."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").cast("int").alias("u"), F.col("l_partkey").cast("int").alias("i")).agg(F.avg("l_quantity").cast("float").alias("r"))
    model = tuning.als(rows, user="u", item="i", rating="r", rank=5, iters=5)
    return recommend.top_items(model, 3).select(F.col("user").cast("long").alias("s_suppkey"), "rank", F.col("item").cast("long").alias("p_partkey"))


@query()
def g1_feature_ranking(t: Tables) -> DataFrame:
    rows = _train(t)
    return metrics.feature_ranking(tuning.train_rf(rows, trees=10, depth=5), rows)


@query()
def g6_loss_history(t: Tables) -> DataFrame:
    return metrics.loss_history(tuning.train_lr(_train(t), maxIter=10), t.spark)


@query("SELECT count(*) AS n, 3::int AS statuses, round(avg(CASE WHEN o_orderstatus = s.top THEN 1.0 ELSE 0.0 END), 6) AS top_share FROM orders, (SELECT o_orderstatus AS top FROM orders GROUP BY ALL ORDER BY count(*) DESC, o_orderstatus LIMIT 1) s")
def e1_one_hot(t: Tables) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    train = t.orders.withColumn("month", F.month("o_orderdate"))
    hot = features.fit_encoder(train, ["o_orderstatus"], ["month"]).transform(train)
    first = F.get(vector_to_array("_o_orderstatus"), F.lit(0))
    return hot.agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").cast("int").alias("statuses"), F.round(F.avg(first), 6).alias("top_share"))


@query("SELECT round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 2) AS tax, sum((l_returnflag = 'R')::int)::double AS label, count(*) AS n FROM lineitem")
def x4_sample_assembler(t: Tables) -> DataFrame:
    out = sampling.SampleAssembler(inputCols=["l_quantity", "l_tax"], labelCol="label", keyCols=KEYS, fraction=1.0).transform(returns(t))
    return out.agg(F.round(F.sum(F.get("features", F.lit(0))), 2).alias("quantity"), F.round(F.sum(F.get("features", F.lit(1))), 2).alias("tax"), F.sum("label").cast("double").alias("label"), F.count("*").alias("n"))


@query()
def x6_temporal_search(t: Tables) -> DataFrame:
    lr = LogisticRegression(maxIter=5)
    grid = tuning.lr_grid(lr, reg=[0.0, 0.1], elastic=[0.0], iters=[5])
    found = tuning.TemporalCrossValidator(lr, grid, metrics.FBetaEvaluator(), parallelism=2).fit(folds.folds(_train(t), "years", "l_shipdate", 1995, 1998))
    return tuning.grid_scores(found, grid, t.events).withColumn("score", F.round("score", 4))


def _weather(t: Tables) -> DataFrame:
    """Readings of stations (users) as dirty text made of events."""
    k = F.col("event_id")
    text = lambda m, values: parse.recode(F.pmod(k, F.lit(m)), values, F.format_string("%.2f", F.col("value")))
    return t.events.select(
        F.col("user_id").cast("string").alias("STATION"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("DATE"),
        text(16, {i: v for i, v in READINGS.items() if i < 9}).alias("HourlyPrecipitation"),
        text(5, {0: "10.00V", 1: "7V"}).alias("HourlyVisibility"),
        text(7, {0: "VRB", 1: "000"}).alias("HourlyWindDirection"),
        text(3, {0: "29.92s"}).alias("HourlyAltimeterSetting"),
        F.pmod(k, F.lit(9)).cast("string").alias("HourlyPressureTendency"),
        parse.recode(F.pmod(k, F.lit(8)), dict(enumerate(SKY)), F.lit(None)).alias("HourlySkyConditions"),
        parse.recode(F.pmod(k + 3, F.lit(8)), dict(enumerate(SKY)), F.lit(None)).alias("HourlyPresentWeatherType"),
    )


WEATHER_SQL = """
SELECT user_id::varchar AS STATION, date_trunc('hour', date_trunc('second', ts) + INTERVAL 59 MINUTE) AS DATEHOUR, count(*) AS n, max((event_id % 7 = 1)::int) AS Calm_Winds, max((event_id % 9 <= 3)::int) AS HourlyPressureTendency_Increasing,
  max((event_id % 8 = 1)::int) AS Sky_Conditions_CLR, max((event_id % 8 IN (1))::int) AS Present_Weather_Rain, round(avg(CASE WHEN event_id % 3 = 0 THEN 29.92 ELSE round(value, 2) END), 4) AS avg_HourlyAltimeterSetting FROM events GROUP BY ALL
"""


@query(WEATHER_SQL)
def q2_build_weather(t: Tables) -> DataFrame:
    raw = _weather(t)
    out = pipelines.build_weather(raw)
    counts = agg.count_by(pipelines.clean_weather(raw), "STATION", "DATEHOUR")
    joined = out.join(counts, ["STATION", "DATEHOUR"])
    return joined.select("STATION", F.col("DATEHOUR").cast("timestamp_ntz").alias("DATEHOUR"), "n", "Calm_Winds", "HourlyPressureTendency_Increasing", "Sky_Conditions_CLR", "Present_Weather_Rain", F.round("avg_HourlyAltimeterSetting", 4).alias("avg_HourlyAltimeterSetting"))


def _flights(t: Tables) -> DataFrame:
    """Flights between nations made of events: the station of nation n is user n."""
    k = F.col("event_id")
    return t.events.select(
        k.alias("flight"),
        F.to_date("ts").cast("string").alias("FL_DATE"),
        (F.hour("ts") * 100 + F.minute("ts")).alias("CRS_DEP_TIME"),
        F.pmod("user_id", F.lit(25)).cast("string").alias("ORIGIN"),
        F.pmod(k * 7, F.lit(25)).cast("string").alias("DEST"),
        F.col("user_id").alias("TAIL_NUM"),
        parse.flag(F.col("event_type") == "error").alias("DEP_DEL15"),
        parse.flag(k % 50 == 0).cast("double").alias("CANCELLED"),
        F.col("value"),
    )


def _airports(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    codes = t.nation.select(key.cast("string").alias("iata_code"), F.concat(F.lit("K"), key.cast("string")).alias("gps_code"), F.col("n_name").alias("name"), F.concat_ws(", ", (key - 100.0).cast("string"), (key + 25.0).cast("string")).alias("coordinates"))
    # every third airport has no station of its own and takes the nearest one
    stations = t.nation.where(key % 3 != 0).select(key.cast("string").alias("station_id"), F.concat(F.lit("K"), key.cast("string")).alias("neighbor_call"), F.lit(0.5).alias("distance_to_neighbor"))
    zones = t.nation.select(key.cast("string").alias("iata_code"), parse.recode(key % 5, dict(enumerate(ZONES)), F.lit(None)).alias("zone"))
    places = t.nation.select((key + 100).cast("string").alias("ws_station_id"), (key + 25.1).alias("lat"), (key - 100.1).alias("lon"))
    return pipelines.build_airports(_flights(t), codes, stations, zones, places)


@query("SELECT n_nationkey::varchar AS id, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey ELSE n_nationkey + 100 END::varchar AS station FROM nation")
def q1_build_airports(t: Tables) -> DataFrame:
    return _airports(t).select("id", "name", "station")


def _joined(t: Tables) -> DataFrame:
    return pipelines.build_joined(_flights(t), _airports(t), pipelines.build_weather(_weather(t)), key=["flight"])


@query(f"""
WITH f AS (SELECT event_id AS flight, user_id % 25 AS o, event_id * 7 % 25 AS d, date_trunc('minute', ts) AS local FROM events), z AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{z}')" for i, z in enumerate(ZONES))}) AS z(k, zone)),
h AS (SELECT user_id::varchar AS s, date_trunc('hour', date_trunc('second', ts) + INTERVAL 59 MINUTE) AS hour, round(avg(CASE WHEN event_id % 3 = 0 THEN 29.92 ELSE round(value, 2) END), 4) AS altimeter, max((event_id % 7 = 1)::int) AS calm FROM events GROUP BY ALL),
u AS (SELECT f.*, timezone('UTC', timezone(zone, local)) AS utc, CASE WHEN o % 3 <> 0 THEN o ELSE o + 100 END::varchar AS os, CASE WHEN d % 3 <> 0 THEN d ELSE d + 100 END::varchar AS ds FROM f JOIN z ON o % 5 = k)
SELECT flight, o::varchar AS ORIGIN, d::varchar AS DEST, utc AS utc_ts, os AS origin_station, ds AS dest_station, a.altimeter AS origin_altimeter, b.calm AS dest_weather_Calm_Winds
FROM u JOIN h a ON a.s = os AND a.hour = date_trunc('hour', utc - INTERVAL 2 HOUR) JOIN h b ON b.s = ds AND b.hour = date_trunc('hour', utc - INTERVAL 2 HOUR)
""")
def q3_build_joined(t: Tables) -> DataFrame:
    return _joined(t).select("flight", "ORIGIN", "DEST", F.col("utc_ts").cast("timestamp_ntz").alias("utc_ts"), "origin_station", "dest_station", F.round("origin_weather_avg_HourlyAltimeterSetting", 4).alias("origin_altimeter"), "dest_weather_Calm_Winds")


def _ready(t: Tables) -> DataFrame:
    return _flights(t).withColumn("ts", timeops.local_ts(F.col("FL_DATE"), F.col("CRS_DEP_TIME")))


SPEC = {"label": "DEP_DEL15", "aircraft": "TAIL_NUM", "place": "ORIGIN", "ts": "ts", "date": "FL_DATE", "cancelled": "CANCELLED", "numbers": ["value"]}
TRAIN = "FL_DATE < '2024-01-20'"


def _steps(t: Tables) -> dict[str, DataFrame]:
    return pipelines.build_features(_ready(t), timeops.holidays(t.spark, 2023, 2025), train=F.expr(TRAIN), **SPEC)


def _saved(t: Tables, **more) -> tuple[DataFrame, DataFrame]:
    """The written features and the audit log."""
    spec, folder, ready = pipelines.FeatureSpec(**SPEC, **more), place(t), _ready(t)
    pipelines.learn_features(ready, spec, F.expr(TRAIN)).save(f"{folder}/learned")
    learned = pipelines.Learned.load(t.spark, f"{folder}/learned", encoder=bool(spec.categories))
    saved = pipelines.save_features(ready, timeops.holidays(t.spark, 2023, 2025), spec, learned, dataset="flights", source="events", destination=f"{folder}/features", log=f"{folder}/audit")
    return saved, t.spark.read.parquet(f"{folder}/audit")


@query("""
WITH f AS (SELECT event_id AS flight, ts::date AS d, (user_id % 25)::varchar AS o, (event_type = 'error')::int AS y, value FROM events WHERE event_id % 50 <> 0),
m AS (SELECT o, avg(y) AS m FROM f WHERE d < '2024-01-20' GROUP BY o), r AS (SELECT min(value) AS lo, max(value) AS hi FROM f WHERE d < '2024-01-20')
SELECT flight, round(m, 4) AS place_mean, round((value - lo) / (hi - lo), 4) AS value, (d IN ('2024-01-01', '2024-01-15'))::int AS is_holiday, (d <= '2024-01-06' OR d BETWEEN '2024-01-10' AND '2024-01-20')::int AS near_holiday FROM f JOIN m USING (o), r
""")
def q4_build_features(t: Tables) -> DataFrame:
    out = _steps(t)["scaled"]
    return out.select("flight", "is_holiday", "near_holiday", F.round("place_mean", 4).alias("place_mean"), F.round("value", 4).alias("value"))


@query("""
SELECT 'flights' AS dataset, i::int AS sequence, s AS step, n AS rows_after FROM (VALUES (1, 'joined', 1), (2, 'not_cancelled', 0), (3, 'prior_flag', 0), (4, 'holidays', 0), (5, 'place_mean', 0), (6, 'complete', 0), (7, 'scaled', 0)) AS v(i, s, every),
  LATERAL (SELECT count(*) FILTER (every = 1 OR event_id % 50 <> 0) AS n FROM events)
""")
def q4_audit(t: Tables) -> DataFrame:
    return _saved(t)[1].where("step != 'saved'").select("dataset", "sequence", "step", "rows_after")


@query("""
WITH r AS (SELECT count(*) AS n, count(*) FILTER (event_id % 50 <> 0) AS kept FROM events)
SELECT 'flights' AS dataset, 'events' AS source, i::int AS sequence, s AS step, w::int AS cols_after, CASE WHEN i = 1 THEN n ELSE kept END AS rows_after, true AS timed
FROM r, (VALUES (1, 'joined', 10), (2, 'not_cancelled', 10), (3, 'prior_flag', 11), (4, 'holidays', 13), (5, 'place_mean', 14), (6, 'complete', 14), (7, 'encoded', 16), (8, 'scaled', 16), (9, 'saved', 16)) AS v(i, s, w)
""")
def q4_saved_audit(t: Tables) -> DataFrame:
    """The log of a run that encodes and saves, from one pass over the events."""
    _, log = _saved(t, categories=["DEST"])
    return log.select("dataset", "source", "sequence", "step", "cols_after", "rows_after", F.col("ts").isNotNull().alias("timed"))


@query("""
WITH f AS (SELECT event_id AS flight, ts::date AS d, event_id * 7 % 25 AS dest FROM events WHERE event_id % 50 <> 0),
o AS (SELECT dest, row_number() OVER (ORDER BY count(*) DESC, dest::varchar) - 1 AS i FROM f WHERE d < '2024-01-20' GROUP BY dest)
SELECT flight, coalesce(i, (SELECT count(*) FROM o))::int AS place, 1::int AS ones FROM f LEFT JOIN o USING (dest)
""")
def q4_saved_features(t: Tables) -> DataFrame:
    """The encoding of every saved row: which place of the vector is 1."""
    from pyspark.ml.functions import vector_to_array

    saved, _ = _saved(t, categories=["DEST"])
    hot = vector_to_array("_DEST")
    return saved.select("flight", (F.array_position(hot, 1.0) - 1).cast("int").alias("place"), F.size(F.filter(hot, lambda x: x != 0)).alias("ones"))


SCORED_SQL = """
WITH s AS (SELECT l_extendedprice / 200000 AS p, (l_returnflag = 'R')::int AS y FROM lineitem),
c AS (SELECT p AS threshold, count(*) FILTER (y = 1) AS yes, count(*) FILTER (y = 0) AS no FROM s GROUP BY p),
r AS (SELECT threshold, sum(yes) OVER w AS tp, sum(no) OVER w AS fp, sum(yes) OVER () AS ys, sum(no) OVER () AS ns FROM c WINDOW w AS (ORDER BY threshold DESC)),
cells AS (SELECT threshold, tp::bigint AS tp, (ns - fp)::bigint AS tn, fp::bigint AS fp, (ys - tp)::bigint AS fn FROM r)
"""


def _priced(t: Tables) -> DataFrame:
    return returns(t).select((F.col("l_extendedprice") / 200000).alias("p"), "label")


@query(SCORED_SQL + "SELECT threshold, tp, tn, fp, fn, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr FROM cells")
def g3_exact_curves(t: Tables) -> DataFrame:
    """A point for every different score."""
    return metrics.exact_curves(_priced(t), "label", "p").select("threshold", "tp", "tn", "fp", "fn", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(SCORED_SQL + "SELECT threshold, round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 6) AS fbeta FROM cells ORDER BY 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) DESC, threshold DESC LIMIT 1")
def g4_exact_best_threshold(t: Tables) -> DataFrame:
    return metrics.best_threshold(metrics.exact_curves(_priced(t), "label", "p")).withColumn("fbeta", F.round("fbeta", 6))


@query(SCORED_SQL + "SELECT round(sum(yes * (below + no / 2)) / (sum(yes) * sum(no)), 6) AS auc FROM (SELECT yes::double AS yes, no::double AS no, coalesce(sum(no) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS below FROM c)")
def g3_area_under_roc(t: Tables) -> DataFrame:
    return metrics.area_under_roc(_priced(t), "label", "p").withColumn("auc", F.round("auc", 6))


@query("""
WITH l AS (SELECT (l_returnflag = 'R' OR l_quantity > 40)::int AS y, year(l_shipdate) AS year FROM lineitem),
f AS (SELECT year, avg(y) AS p FROM l WHERE year IN (1996, 1998) GROUP BY year)
SELECT 'constant=0.0' AS params, 0.0::double AS score UNION ALL SELECT 'constant=1.0', round(avg(1.25 * p / (0.25 * p + 1)), 4) FROM f
""")
def x6_constant_search(t: Tables) -> DataFrame:
    """The search as a stage, saved and read before it is fitted; a constant classifier has the same score in SQL."""
    base = tuning.ConstantClassifier()
    grid = [{base.constant: 0.0}, {base.constant: 1.0}]
    search = tuning.TemporalCrossValidator(base, grid, metrics.FBetaEvaluator(), folds=folds.predicates("years", "l_shipdate", 1995, 1998), parallelism=2)
    search.write().overwrite().save(path := place(t))
    again = tuning.TemporalCrossValidator.load(path)
    found = again.fit(_train(t))
    return tuning.grid_scores(found, again.grid, t.events).withColumn("score", F.round("score", 4))


@query()
def q5_train_and_evaluate(t: Tables) -> DataFrame:
    rows = _train(t).drop("features")
    parts = folds.folds(rows, "years", "l_shipdate", 1995, 1998)
    grid = [{"regParam": 0.0, "maxIter": 5}, {"regParam": 0.1, "maxIter": 5}]
    out = pipelines.train_and_evaluate(rows, parts, cols=COLS, label="label", keys=KEYS, grid=grid)
    return out.select("model", "params", "tp", "tn", "fp", "fn", F.round("fbeta", 4).alias("fbeta"))


@query("SELECT l_suppkey, n, round(r, 4) AS rate, round(n / sum(n) OVER (), 6) AS share FROM (SELECT l_suppkey, count(*) AS n, avg((l_returnflag = 'R')::int) AS r FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY CASE WHEN n >= 500 THEN r ELSE -1 END DESC, l_suppkey) <= 20")
def q6_report(t: Tables) -> DataFrame:
    out = pipelines.report(returns(t), ["l_suppkey"], "label", min_total=500, n=20)
    return out.select("l_suppkey", "n", F.round("rate", 4).alias("rate"), F.round("share", 6).alias("share"))
