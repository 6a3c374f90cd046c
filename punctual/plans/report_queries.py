"""The exploration reports and the record of a run over the driver's tables, and small operators that had no query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.operators import aggregates as agg
from punctual.operators import descent, features, folds, metrics, sampling, tuning, windows
from punctual.plans import reports
from punctual.plans.model_queries import _train
from punctual.plans.queries import HASH_SQL, KEYS, errors, returns
from punctual.plans.registry import Tables, query
from punctual.plans.store_queries import place
from punctual.sources import readers, sinks

def _shares(df: DataFrame) -> DataFrame:
    return df.withColumn("share", F.round("share", 4))


@query("SELECT year(l_shipdate)::int AS year, month(l_shipdate)::int AS month, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS delayed, round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS share FROM lineitem GROUP BY GROUPING SETS ((year(l_shipdate), month(l_shipdate)), (year(l_shipdate)))")
def q6_by_period(t: Tables) -> DataFrame:
    return _shares(reports.by_period(returns(t), F.year("l_shipdate"), F.month("l_shipdate"), "label"))


SUMMARY_SQL = """
WITH l AS (SELECT l_suppkey % 25 AS origin, l_partkey % 25 AS dest, l_linenumber AS carrier, (l_returnflag = 'R')::int AS y FROM lineitem),
c AS (SELECT origin, dest, carrier, count(*) FILTER (y = 0) AS o, count(*) FILTER (y = 1) AS d FROM l GROUP BY ALL HAVING {having}),
g AS (SELECT 'origin' AS report, origin::varchar AS "group", sum(o)::bigint AS ontime, sum(d)::bigint AS delayed FROM c GROUP BY origin UNION ALL SELECT 'dest', dest::varchar, sum(o)::bigint, sum(d)::bigint FROM c GROUP BY dest
  UNION ALL SELECT 'pair', origin::varchar || '-' || dest::varchar, sum(o)::bigint, sum(d)::bigint FROM c GROUP BY origin, dest UNION ALL SELECT 'carrier', carrier::varchar, sum(o)::bigint, sum(d)::bigint FROM c GROUP BY carrier)
SELECT report, row_number() OVER (PARTITION BY report ORDER BY delayed / (ontime + delayed) DESC, ontime + delayed DESC, "group")::int AS place, "group", ontime, delayed, ontime + delayed AS total, round(delayed / (ontime + delayed), 4) AS share FROM g WHERE ontime + delayed >= {least} QUALIFY place <= 20
"""
REPORTS = {"origin": ["origin"], "dest": ["dest"], "pair": ["origin", "dest"], "carrier": ["carrier"]}


def _routes(t: Tables) -> DataFrame:
    return returns(t).select((F.col("l_suppkey") % 25).alias("origin"), (F.col("l_partkey") % 25).alias("dest"), F.col("l_linenumber").alias("carrier"), "label")


@query(SUMMARY_SQL.format(having="true", least=20))
def q6_delay_summaries(t: Tables) -> DataFrame:
    return _shares(reports.delay_summaries(_routes(t), REPORTS, "label", min_total=20))


@query(SUMMARY_SQL.format(having="o > 0 AND d > 0", least=1))
def q6_delay_summaries_both_sides(t: Tables) -> DataFrame:
    return _shares(reports.delay_summaries(_routes(t), REPORTS, "label", min_total=1, both=True))


@query("SELECT month(o_orderdate)::int AS month, count(*) FILTER (o_orderstatus <> 'P') AS operated, count(*) FILTER (o_orderstatus = 'P') AS cancelled, count(*) AS total, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 4) AS share FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL")
def q6_cancellations(t: Tables) -> DataFrame:
    rows = t.orders.where(F.year("o_orderdate") == 1996).select(F.month("o_orderdate").alias("month"), F.when(F.col("o_orderstatus") == "P", 1).alias("gone"))
    return _shares(reports.cancellations(rows, ["month"], "gone"))


@query("""
WITH p AS (SELECT *, (event_type = 'error')::int AS label, lag(ts) OVER w AS pt, lag((event_type = 'error')::int) OVER w AS pl FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT label, CASE WHEN user_id IS NOT NULL AND epoch_us(ts) // 1000000 - epoch_us(pt) // 1000000 > 8100 AND pt::date = ts::date THEN pl ELSE 0 END AS late FROM p),
c AS (SELECT label::varchar AS a, late::varchar AS b, count(*) AS n FROM f GROUP BY ALL),
w AS (SELECT 'label' AS given, a AS value, b AS outcome, n FROM c UNION ALL SELECT 'prior_flag', b, a, n FROM c)
SELECT given, value, outcome, n, round(n / sum(n) OVER (PARTITION BY given, value), 4) AS share FROM w
""")
def q6_late_aircraft(t: Tables) -> DataFrame:
    """How often an event is an error given that the user's one before was, and the other way round."""
    return _shares(reports.conditional_shares(windows.prior_flag(errors(t), "user_id", "ts", "label", tie="event_id"), "label", "prior_flag"))


@query("SELECT least(floor(l_quantity / 5) + 1, 8)::int AS \"group\", count(*) AS n, round(avg(l_quantity), 4) AS mean, count(*) FILTER (l_returnflag = 'R') AS delayed, round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS share FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def q6_durations(t: Tables) -> DataFrame:
    return _shares(reports.durations(returns(t), "l_quantity", "label", width=5.0, groups=8)).withColumn("mean", F.round("mean", 4))


@query("""
WITH j AS (SELECT p_brand AS brand, split_part(p_type, ' ', 1) AS kind, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, (l_returnflag = 'R')::int AS y FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) p ON p_partkey = l_partkey),
e AS (SELECT 'brand' AS attribute, brand AS value, y FROM j UNION ALL SELECT 'kind', kind, y FROM j UNION ALL SELECT 'size', CASE WHEN brand IS NULL THEN NULL ELSE size END, y FROM j)
SELECT attribute, value, count(*) AS n, count(*) FILTER (y = 1) AS delayed, round(avg(y), 4) AS share FROM e GROUP BY ALL
""")
def q6_aircraft(t: Tables) -> DataFrame:
    """Parts stand for aircraft; every fifth is unknown."""
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").when(F.col("p_size").isNotNull(), "large")
    parts = t.part.where("p_partkey % 5 != 0").withColumnRenamed("p_partkey", "l_partkey")
    shown = {"brand": F.col("p_brand"), "kind": F.get(F.split("p_type", " "), F.lit(0)), "size": size}
    return _shares(reports.attribute_report(returns(t), parts, ["l_partkey"], shown, "label"))


@query("""
WITH l AS (SELECT (l_returnflag = 'R' OR l_quantity > 40)::int AS y, year(l_shipdate) AS year FROM lineitem), d AS (SELECT 'test' AS dataset, y FROM l WHERE year = 1998 UNION ALL SELECT 'train', y FROM l WHERE year = 1997)
SELECT 'constant' AS model, '1.0' AS constant, 2::int AS settings, dataset, sum(y)::bigint AS tp, 0::bigint AS tn, sum(1 - y)::bigint AS fp, 0::bigint AS fn, round(avg(y), 4) AS accuracy FROM d GROUP BY dataset
""")
def g7_run_summary(t: Tables) -> DataFrame:
    """The nested record of a search over constants, written to the history and read again."""
    base = tuning.ConstantClassifier()
    grid = [{base.constant: 0.0}, {base.constant: 1.0}]
    rows = _train(t)
    found = tuning.TemporalCrossValidator(base, grid, metrics.FBetaEvaluator(), folds=folds.predicates("years", "l_shipdate", 1995, 1998)).fit(rows)
    predicted = {n: found.transform(rows.where(F.year("l_shipdate") == y)) for n, y in (("train", 1997), ("test", 1998))}
    tuning.record_run(tuning.run_summary("constant", "baseline", found, grid, predicted, seconds=1.0, strategies={"folds": "years"}), path := place(t))
    run = t.spark.read.parquet(path).select("model", F.col("parameters")["constant"].alias("constant"), F.size("settings").cast("int").alias("settings"), F.explode("datasets").alias("d"))
    return run.select("model", "constant", "settings", *[f"d.{c}" for c in ("dataset", "tp", "tn", "fp", "fn")], F.round("d.accuracy", 4).alias("accuracy"))


@query("SELECT count(*) AS orders, min(o_orderdate)::date AS first, max(o_orderdate)::date AS last, NULL::varchar AS note FROM orders")
def s7_rows_to_df(t: Tables) -> DataFrame:
    seen = t.orders.agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")).first()
    first, last = (d if isinstance(d, dt.date) else d.date() for d in (seen["a"], seen["b"]))
    return readers.rows_to_df(t.spark, [(seen["n"], first, last, None)], "orders long, first date, last date, note string")


@query("SELECT o_orderkey, i::int AS place FROM orders JOIN (SELECT p, row_number() OVER (ORDER BY n DESC, p) - 1 AS i FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)) ON p = o_orderpriority")
def k8_saved_transformer(t: Tables) -> DataFrame:
    """A fitted encoder is written, read and applied."""
    from pyspark.ml import PipelineModel

    sinks.save_model(features.fit_encoder(t.orders, ["o_orderpriority"]), path := place(t))
    out = sinks.load_model(PipelineModel, path).transform(t.orders)
    return out.select("o_orderkey", F.col("o_orderpriority_index").cast("int").alias("place"))


@query("SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, count(*) AS n FROM (DESCRIBE SELECT * FROM lineitem) AS d(column_name, data_type, a, b, c, e) GROUP BY 1")
def a14_type_census(t: Tables) -> DataFrame:
    return agg.type_census(t.lineitem)


@query("""
WITH s AS (SELECT p, row_number() OVER (ORDER BY n DESC, p) - 1 AS i FROM (SELECT o_orderstatus AS p, count(*) AS n FROM orders GROUP BY 1))
SELECT o_orderkey, i::int AS status_at, (SELECT count(*) + 1 FROM s)::int AS status_size, month(o_orderdate)::int AS month_at, (SELECT max(month(o_orderdate)) + 1 FROM orders)::int AS month_size FROM orders JOIN s ON p = o_orderstatus
""")
def e1_whole_encoding(t: Tables) -> DataFrame:
    """Of every row which place of each vector is 1, and how long the vectors are."""
    from pyspark.ml.functions import vector_to_array

    train = t.orders.withColumn("month", F.month("o_orderdate"))
    hot = features.fit_encoder(train, ["o_orderstatus"], ["month"]).transform(train)
    at = lambda c: (F.array_position(vector_to_array(c), 1.0) - 1).cast("int")
    size = lambda c: F.size(vector_to_array(c))
    return hot.select("o_orderkey", at("_o_orderstatus").alias("status_at"), size("_o_orderstatus").alias("status_size"), at("_month").alias("month_at"), size("_month").alias("month_size"))


@query(f"SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 2) AS tax, sum((l_returnflag = 'R')::int)::double AS label FROM lineitem WHERE {HASH_SQL.format(salt='')} < 0.25")
def x4_quarter_of_rows(t: Tables) -> DataFrame:
    out = sampling.SampleAssembler(inputCols=["l_quantity", "l_tax"], labelCol="label", keyCols=KEYS, fraction=0.25).transform(returns(t))
    return out.agg(F.count("*").alias("n"), F.round(F.sum(F.get("features", F.lit(0))), 2).alias("quantity"), F.round(F.sum(F.get("features", F.lit(1))), 2).alias("tax"), F.sum("label").cast("double").alias("label"))


def _history_sql(steps: int, rate: float = 0.5) -> str:
    """Losses of both sets with the weights of each step, which are learned from the early rows."""
    parts = ["w0 AS (SELECT 0.0::double AS a, 0.0::double AS b, 0.0::double AS c)"]
    for i in range(steps):
        parts.append(f"g{i} AS MATERIALIZED (SELECT avg(p - y) AS ga, avg((p - y) * x) AS gb, avg((p - y) * z) AS gc FROM (SELECT *, 1 / (1 + exp(-(a + b * x + c * z))) AS p FROM t, w{i} WHERE early))")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT a - {rate} * ga AS a, b - {rate} * gb AS b, c - {rate} * gc AS c FROM w{i}, g{i})")
    rows = " UNION ALL ".join(
        f"SELECT CASE WHEN early THEN 'train' ELSE 'test' END AS dataset, {i}::int AS step, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS loss, round(1.25 * sum(p * y) / (1.25 * sum(p * y) + 0.25 * sum((1 - p) * y) + sum(p * (1 - y))), 6) AS soft_fbeta FROM (SELECT *, 1 / (1 + exp(-(a + b * x + c * z))) AS p FROM t, w{i}) GROUP BY early"
        for i in range(steps + 1)
    )
    return f"WITH t AS (SELECT l_quantity / 50.0::double AS x, l_discount * 10.0::double AS z, CASE WHEN l_returnflag = 'R' THEN 1.0::double ELSE 0.0::double END AS y, year(l_shipdate) < 1997 AS early FROM lineitem), {', '.join(parts)} {rows}"


@query(_history_sql(2))
def l5_loss_history(t: Tables) -> DataFrame:
    """Losses of training and later rows before each step and after the last, with real weights."""
    rows = t.lineitem.select((F.col("l_quantity") / 50.0).cast("double").alias("x"), (F.col("l_discount") * 10.0).cast("double").alias("z"), (F.col("l_returnflag") == "R").cast("double").alias("label"), (F.year("l_shipdate") < 1997).alias("early"))
    found = descent.lr_gradient_descent(rows.where("early"), ["x", "z"], "label", steps=2)
    history = descent.loss_history({"train": rows.where("early"), "test": rows.where("not early")}, found, ["x", "z"], "label")
    return history.select("dataset", "step", F.round("loss", 6).alias("loss"), F.round("soft_fbeta", 6).alias("soft_fbeta"))
