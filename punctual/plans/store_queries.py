"""Sources and sinks, and operators on columns: what is written is read back and compared with the table it came from."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import formulas
from punctual.operators import relational, tuning
from punctual.plans.registry import Tables, query
from punctual.sources import readers, sinks


def place(t: Tables) -> str:
    """A new folder in the shared one."""
    return f"{sinks.shared_folder(t.spark)}/stored-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey FROM orders")
def s1_read_parquet(t: Tables) -> DataFrame:
    return readers.read_parquet(t.spark, t.path("orders"), cols=["o_orderkey", "o_custkey"])


@query("SELECT c_custkey, c_nationkey::int AS c_nationkey, c_mktsegment FROM customer")
def s2_k6_csv_round_trip(t: Tables) -> DataFrame:
    sinks.write_csv(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), path := place(t))
    return readers.read_reference_csv(t.spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment")


@query("SELECT event_id::varchar AS event_id, year(ts)::int AS year FROM events")
def s3_readings_csv(t: Tables) -> DataFrame:
    path = place(t)
    for part in (0, 1):  # files in folders below
        sinks.write_csv(t.events.where(F.col("event_id") % 2 == part).select(F.col("event_id").cast("string"), F.col("ts").cast("string").alias("DATE")), f"{path}/{part}")
    return readers.read_weather_csv(t.spark, path).select("event_id", "year")


@query("SELECT p_partkey, p_name FROM part")
def s4_csv_with_options(t: Tables) -> DataFrame:
    t.part.select("p_partkey", "p_name").write.option("sep", "|").csv(path := place(t))
    return readers.read_csv_opts(t.spark, path, "p_partkey long, p_name string", sep="|")


@query("SELECT p_partkey AS id, p_name AS title FROM part")
def s6_k7_index_text(t: Tables) -> DataFrame:
    sinks.write_text(t.part.select(F.concat_ws("\t", "p_name", F.col("p_partkey").cast("string")).alias("value")), path := place(t))
    return readers.read_index_text(t.spark, path)


@query("SELECT count(*) AS n, max(event_id) AS latest, max(value) AS top FROM events")
def s8_json_to_df(t: Tables) -> DataFrame:
    seen = t.events.agg(F.count("*").alias("n"), F.max("event_id").alias("latest"), F.max("value").alias("top")).first()
    value = {"ids": {"n": seen["n"], "latest": seen["latest"]}, "top": seen["top"]}
    return readers.json_to_df(t.spark, value, "ids struct<n: bigint, latest: bigint>, top double").select("ids.n", "ids.latest", "top")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def k1_parquet_overwrite(t: Tables) -> DataFrame:
    sinks.write_parquet(t.orders.select("o_orderkey", "o_totalprice"), path := place(t))
    sinks.write_parquet(t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), path)
    return readers.read_parquet(t.spark, path)


@query("SELECT year(o_orderdate)::int AS year, 2 * count(*) AS n, sum(o_orderkey)::bigint * 2 AS keys FROM orders GROUP BY ALL")
def k2_k3_partitioned(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    sinks.write_partitioned(rows, path := place(t), ["year"])
    sinks.append_partitioned(rows, path, ["year"], files_per_key=2)
    return readers.read_parquet(t.spark, path).groupBy("year").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL")
def k4_append_log(t: Tables) -> DataFrame:
    path = place(t)
    for status in ("F", "O"):
        sinks.append_log(t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderpriority"), path)
    return readers.read_parquet(t.spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey::int AS c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def k5_single_file(t: Tables) -> DataFrame:
    sinks.write_single(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), path := place(t))
    return readers.read_parquet(t.spark, path).select(F.col("c_nationkey").cast("int").alias("c_nationkey"), "n")


@query("SELECT CASE WHEN o_orderdate < DATE '1997-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ALL")
def k9_predictions(t: Tables) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("date")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    sinks.save_predictions({"train": rows.where(early), "test": rows.where(~early)}, path := place(t))
    both = [readers.read_parquet(t.spark, f"{path}/{x}").withColumn("part", F.lit(x)) for x in ("train", "test")]
    return both[0].unionByName(both[1]).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def k10_view(t: Tables) -> DataFrame:
    with sinks.cached_view(t.events.select("event_id", "event_type"), name := f"events_{uuid.uuid4().hex}"):
        return sinks.checkpointed(t.spark.sql(f"SELECT event_type, count(*) AS n FROM {name} GROUP BY event_type"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def m1_f15_keep_columns(t: Tables) -> DataFrame:
    return relational.keep(relational.drop_cols(t.orders, ["o_custkey", "no_such_column"], ["o_totalprice"]), ["o_orderkey", "o_orderstatus", "o_custkey", "nor_this"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def m2_leakage(t: Tables) -> DataFrame:
    flights = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col("l_quantity").alias(c) for c in ("ARR_DELAY", "CARRIER_DELAY", "TAXI_IN", "DEP_TIME", "DIVERTED")])
    return relational.drop_leakage(flights)


@query("SELECT l_orderkey, l_linenumber, l_quantity::double AS a, l_discount::double AS b FROM lineitem")
def v4_vector_to_columns(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    packed = VectorAssembler(inputCols=["q", "d"], outputCol="v").transform(rows)
    return formulas.vector_to_cols(packed, "v", ["a", "b"]).select("l_orderkey", "l_linenumber", "a", "b")


@query("SELECT p_partkey, lower(left(p_name, 3)) || '-' || right(p_brand, 2) AS code FROM part")
def f13_text_parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lower(F.left("p_name", F.lit(3))), F.lit("-"), F.right("p_brand", F.lit(2))).alias("code"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::int AS place FROM orders QUALIFY place <= 50")
def t1_t4_order_and_limit(t: Tables) -> DataFrame:
    top = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)  # the feature is the top
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("rows"))
    return listed.select(F.posexplode("rows").alias("i", "r")).select("r.o_orderkey", (-F.col("r.p")).alias("o_totalprice"), (F.col("i") + 1).alias("place"))


@query("""
WITH run AS (SELECT o_orderpriority AS model, max(o_orderdate)::timestamp AS ts, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY o_orderpriority, year(o_orderdate))
SELECT model, ts, score FROM run QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts DESC) = 1
""")
def g7_latest_runs(t: Tables) -> DataFrame:
    runs = t.orders.groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("y")).agg(F.max("o_orderdate").cast("timestamp").alias("ts"), F.round(F.avg("o_totalprice"), 2).alias("score"))
    path = place(t)
    for half in (0, 1):
        tuning.record_run(runs.where(F.col("y") % 2 == half).drop("y"), path)
    return tuning.latest_runs(readers.read_parquet(t.spark, path)).select("model", F.col("ts").cast("timestamp_ntz").alias("ts"), "score")


@query("""
WITH t AS (SELECT l_quantity / 50.0::double AS x, l_discount * 10.0::double AS z, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, year(l_shipdate) < 1997 AS early FROM lineitem)
SELECT CASE WHEN early THEN 'train' ELSE 'test' END AS dataset, 0 AS step, round(-avg(ln(0.5)), 6) AS loss,
  round(1.25 * sum(0.5 * y) / (1.25 * sum(0.5 * y) + 0.25 * sum(0.5 * y) + sum(0.5 * (1 - y))), 6) AS soft_fbeta FROM t GROUP BY early
""")
def l5_loss_history_first_step(t: Tables) -> DataFrame:
    from punctual.operators import descent

    rows = t.lineitem.select((F.col("l_quantity") / 50.0).cast("double").alias("x"), (F.col("l_discount") * 10.0).cast("double").alias("z"), (F.col("l_returnflag") == "R").cast("double").alias("label"), (F.year("l_shipdate") < 1997).alias("early"))
    found = descent.lr_gradient_descent(rows.where("early"), ["x", "z"], "label", steps=2)
    history = descent.loss_history({"train": rows.where("early"), "test": rows.where("not early")}, found, ["x", "z"], "label")
    return history.where("step = 0").select("dataset", "step", F.round("loss", 6).alias("loss"), F.round("soft_fbeta", 6).alias("soft_fbeta"))
