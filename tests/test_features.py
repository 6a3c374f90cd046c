import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from punctual.functions import timeops
from punctual.operators import folds, metrics, prefix, tuning
from punctual.plans import pipelines

SPEC = pipelines.FeatureSpec(label="y", aircraft="k", place="p", ts="ts", date="d", cancelled="c", numbers=["v"], categories=["q"])


def flights(spark, n=400):
    rng = np.random.default_rng(5)
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=97 * i)
    rows = [(i, int(rng.integers(9)), f"p{i % 7}", day(i), str(day(i).date()), float(i % 40 == 0), float(rng.normal()) if i % 11 else None, "abcz"[min(i % 5, 2) if i < 300 else 3], int(rng.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame(rows, "i int, k int, p string, ts timestamp, d string, c double, v double, q string, y int")


def test_features_are_learned_on_training_rows_alone(spark, tmp_path):
    df = flights(spark)
    early = F.col("d") < "2024-01-15"
    a = pipelines.learn_features(df, SPEC, early)
    b = pipelines.learn_features(df.where(early), SPEC, F.lit(True))
    assert (a.overall, a.ranges) == (b.overall, b.ranges)
    assert sorted(map(tuple, a.means.collect())) == sorted(map(tuple, b.means.collect()))
    a.save(str(tmp_path / "m"))
    c = pipelines.Learned.load(spark, str(tmp_path / "m"))
    assert (a.overall, a.ranges) == (c.overall, c.ranges) and sorted(map(tuple, a.means.collect())) == sorted(map(tuple, c.means.collect()))
    assert a.encoder.stages[0].labelsArray == c.encoder.stages[0].labelsArray
    rows = [r for r in df.where(early).collect() if r["c"] != 1 and r["v"] is not None]
    assert a.ranges["v"] == (min(r["v"] for r in rows), max(r["v"] for r in rows))


def test_audit_is_one_pass_and_right(spark, tmp_path):
    flights(spark).write.parquet(str(tmp_path / "in"))
    df, calendar = spark.read.parquet(str(tmp_path / "in")), timeops.holidays(spark, 2023, 2025)
    learned = pipelines.learn_features(df, SPEC, F.col("d") < "2024-01-15")
    frames = [df]
    for _, step in pipelines.feature_steps(SPEC, calendar, learned):
        frames.append(step(frames[-1]))
    plan = frames[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1, plan
    for k in (1, 2):  # the log is added to
        saved = pipelines.save_features(df, calendar, SPEC, learned, dataset=f"run{k}", source="in", destination=str(tmp_path / f"out{k}"), log=str(tmp_path / "log"))
        assert sorted(r["i"] for r in saved.select("i").collect()) == sorted(r["i"] for r in frames[-1].select("i").collect())
    log = spark.read.parquet(str(tmp_path / "log"))
    want = [f.count() for f in frames]
    for k in (1, 2):
        got = log.where(F.col("dataset") == f"run{k}").orderBy("sequence").collect()
        assert [r["rows_after"] for r in got] == [*want, want[-1]]
        assert [r["cols_after"] for r in got] == [*[len(f.columns) for f in frames], len(frames[-1].columns)]
        assert {(r["source"], r["destination"]) for r in got} == {("in", str(tmp_path / f"out{k}"))} and got[-1]["step"] == "saved"


def test_counts_that_do_not_fit_are_counted_anew(spark):
    a, b = spark.range(10), spark.range(8)
    frames = [("joined", a), ("not_cancelled", b), ("prior_flag", b), ("complete", b.limit(5)), ("scaled", b.limit(5))]
    assert pipelines.settled_counts(frames, [10, 8, 8, 5, 5]) == [10, 8, 8, 5, 5]
    assert pipelines.settled_counts(frames, [14, 11, 8, 5, 5]) == [10, 8, 8, 5, 5]


def test_models_still_run_after_an_audit(spark, tmp_path):
    test_audit_is_one_pass_and_right(spark, tmp_path)
    rows = VectorAssembler(inputCols=["i"], outputCol="features").transform(flights(spark).withColumn("label", F.col("y").cast("double")))
    assert LogisticRegression(maxIter=2).fit(rows).transform(rows).select("prediction").distinct().count() <= 2


def dated(spark):
    rng = np.random.default_rng(1)
    rows = [(dt.date(2015 + i % 4, 1 + i % 12, 1), float(rng.normal()), float(rng.normal()), float(i % 3 == 0)) for i in range(600)]
    return spark.createDataFrame([(d, x + y, z, y) for d, x, z, y in rows], "d date, a double, b double, label double")


def test_search_in_a_pipeline_saved_and_loaded(spark, tmp_path):
    df = dated(spark)
    lr = LogisticRegression(maxIter=5)
    grid = tuning.lr_grid(lr, reg=[0.0, 0.5], elastic=[0.0], iters=[5])
    search = tuning.TemporalCrossValidator(lr, grid, metrics.FBetaEvaluator(beta=2.0), folds=folds.predicates("years", "d"), parallelism=2, refit="all", collectSubModels=True)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), search])
    pipe.getStages()[1].save(str(tmp_path / "search"))
    again = tuning.TemporalCrossValidator.load(str(tmp_path / "search"))
    assert again.uid == search.uid and again.getParallelism() == 2 and again.getOrDefault(again.refit) == "all" and again.getOrDefault(again.folds) == folds.predicates("years", "d")
    assert again.evaluator.getOrDefault(again.evaluator.beta) == 2.0 and [sorted((p.name, v) for p, v in g.items()) for g in again.grid] == [sorted((p.name, v) for p, v in g.items()) for g in grid]
    fitted = pipe.fit(df)
    other = Pipeline(stages=[pipe.getStages()[0], again]).fit(df)
    a, b = fitted.stages[1], other.stages[1]
    assert a.avgMetrics == b.avgMetrics and a.bestIndex == b.bestIndex and [len(f) for f in a.subModels] == [2, 2]
    a.save(str(tmp_path / "model"))
    c = tuning.TemporalCrossValidatorModel.load(str(tmp_path / "model"))
    assert c.avgMetrics == a.avgMetrics and c.bestIndex == a.bestIndex and [len(f) for f in c.subModels] == [2, 2]
    ready = pipe.getStages()[0].transform(df)
    predicted = lambda m: [r["prediction"] for r in m.transform(ready).select("prediction").collect()]
    assert predicted(a) == predicted(c) == predicted(b)
    assert [c.subModels[i][j].coefficients for i in (0, 1) for j in (0, 1)] == [a.subModels[i][j].coefficients for i in (0, 1) for j in (0, 1)]
    assert PipelineModel(stages=[fitted.stages[0], c]).transform(df).count() == 600


@pytest.mark.parametrize("refit", ["last", "all"])
def test_search_fits_on_training_rows_only(spark, refit):
    """Testing rows that would mislead don't change the refitted model; frames by name give the same as conditions."""
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(dated(spark))
    lr = LogisticRegression(maxIter=5)
    grid = tuning.lr_grid(lr, reg=[0.1], elastic=[0.0], iters=[5])
    fit = lambda data, **more: tuning.TemporalCrossValidator(lr, grid, metrics.FBetaEvaluator(), refit=refit, **more).fit(data)
    by_name, by_condition = fit(folds.folds(df, "years", "d")), fit(df, folds=folds.predicates("years", "d"))
    assert by_name.avgMetrics == by_condition.avgMetrics
    wrong = df.withColumn("label", F.when(F.year("d").isin(2016, 2018), 1 - F.col("label")).otherwise(F.col("label")))
    np.testing.assert_allclose(fit(wrong, folds=folds.predicates("years", "d")).bestModel.coefficients, by_condition.bestModel.coefficients, rtol=1e-9)
    years = (2015, 2017) if refit == "all" else (2017,)
    np.testing.assert_allclose(lr.fit(df.where(F.year("d").isin(*years)), grid[0]).coefficients, by_condition.bestModel.coefficients, rtol=1e-6)


def test_running_totals_are_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(x) if x else None, float(x)) for k, x in zip(rng.permutation(3000), rng.integers(0, 5, 3000), strict=True)]
    df = spark.createDataFrame(rows, "k int, x int, z double").repartition(7)
    got = {r["k"]: (r["sx"], r["sz"]) for r in prefix.running_totals(df, [F.desc("k")], {"sx": "x", "sz": "z"}).collect()}
    sx = sz = 0
    for k, x, z in sorted(rows, reverse=True):
        sx, sz = sx + (x or 0), sz + z
        assert got[k] == (sx, sz)
    assert prefix.running_totals(df.limit(0), [F.desc("k")], {"sx": "x"}).count() == 0


def test_exact_curves_and_area(spark):
    rows = [(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 1), (0.1, 0), (0.0, 0), (None, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    got = [tuple(r) for r in metrics.exact_curves(df, "y", "p").select("threshold", "tp", "tn", "fp", "fn").orderBy("threshold").collect()]
    assert got == [(0.0, 3, 0, 3, 0), (0.1, 3, 1, 2, 0), (0.5, 3, 2, 1, 0), (0.9, 1, 2, 1, 2)]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y == 1 and a is not None for b, z in rows if z == 0]
    assert metrics.area_under_roc(df, "y", "p").first()["auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert metrics.exact_curves(df.limit(0), "y", "p").count() == 0 and metrics.area_under_roc(df.limit(0), "y", "p").first()["auc"] is None
