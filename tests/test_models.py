"""What holds for any fitted model, whatever it learned: cells sum to the rows, scores are shares, and testing rows teach nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.operators import features, metrics, tuning
from punctual.plans import pipelines, reports


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(17)
    data = [(float(a), float(b), float(rng.normal()), float(a + b > 0), i % 4) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))]
    return features.assemble(spark.createDataFrame(data, "a double, b double, noise double, y double, part int"), ["a", "b", "noise"], "y").cache()


LEARNERS = {
    "lr": lambda d: tuning.train_lr(d, maxIter=20),
    "rf": lambda d: tuning.train_rf(d, trees=8, depth=4),
    "gbt": lambda d: tuning.train_gbt(d, maxIter=5, maxDepth=3),
    "dt": lambda d: tuning.train_dt(d, depth=4),
}


@pytest.mark.parametrize("name", LEARNERS)
def test_cells_sum_to_rows_and_the_rule_is_learned(rows, name):
    train, test = rows.where("part < 3"), rows.where("part = 3")
    predicted = LEARNERS[name](train).transform(test)
    assert {r["prediction"] for r in predicted.select("prediction").distinct().collect()} <= {0.0, 1.0}
    m = metrics.metrics(predicted, "label", "prediction").first()
    assert m["tp"] + m["tn"] + m["fp"] + m["fn"] == test.count() and m["tp"] + m["fn"] == test.where("y = 1").count()
    assert all(0 <= m[c] <= 1 for c in ("precision", "recall", "fbeta", "accuracy", "tpr", "fpr")) and m["accuracy"] > 0.85


def test_weights_count_as_repeated_rows(rows):
    weighted = rows.withColumn("weight", F.when(F.col("y") == 1, 3.0).otherwise(1.0))
    repeated = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("y") == 1, 3).otherwise(1))))
    fit = lambda d, **more: tuning.train_lr(d, regParam=0.1, standardization=False, **more).coefficients.toArray()
    np.testing.assert_allclose(fit(weighted, weight="weight"), fit(repeated), rtol=1e-3)


def test_deeper_trees_fit_their_training_rows_no_worse(rows):
    got = {r["depth"]: r["score"] for r in tuning.depth_sweep(rows, rows, metrics.FBetaEvaluator(beta=1.0), [1, 4, 8]).collect()}
    assert 0 <= got[1] <= got[4] + 0.02 <= got[8] + 0.04 <= 1.04


def test_evaluator_is_the_formula(rows):
    predicted = tuning.train_dt(rows, depth=2).transform(rows)
    m = metrics.confusion(predicted, "label", "prediction").first()
    for beta in (0.5, 1.0, 2.0):
        want = (1 + beta**2) * m["tp"] / ((1 + beta**2) * m["tp"] + beta**2 * m["fn"] + m["fp"])
        assert metrics.FBetaEvaluator(beta=beta).evaluate(predicted) == pytest.approx(want)


def test_ranking_has_every_feature_by_its_name(rows):
    forest = tuning.train_rf(rows, trees=8, depth=4)
    got = metrics.feature_ranking(forest, rows).orderBy("rank").collect()
    assert {r["feature"] for r in got} == {"a", "b", "noise"} and [r["rank"] for r in got] == [1, 2, 3]
    assert sum(r["weight"] for r in got) == pytest.approx(1) and got[-1]["feature"] == "noise"
    linear = tuning.train_lr(rows, maxIter=20)
    assert {r["feature"]: r["weight"] for r in metrics.feature_ranking(linear, rows).collect()} == pytest.approx(dict(zip(["a", "b", "noise"], linear.coefficients, strict=True)))


def test_loss_never_rises(rows, spark):
    loss = [r["loss"] for r in metrics.loss_history(tuning.train_lr(rows, maxIter=10), spark).orderBy("iteration").collect()]
    assert len(loss) > 2 and all(b <= a + 1e-9 for a, b in zip(loss, loss[1:], strict=False))


def test_grid_is_every_combination():
    from pyspark.ml.classification import LogisticRegression

    grid = tuning.lr_grid(LogisticRegression(), reg=[0.0, 0.1], elastic=[0.0, 1.0], iters=[5, 6, 7])
    assert len({tuple(sorted((p.name, v) for p, v in g.items())) for g in grid}) == 12


def test_assembled_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, "old"), (None, 2.0, 0, "old")], "a double, b double, y int, features string")
    got = features.assemble(df, ["a", "b"], "y").collect()
    assert len(got) == 1 and list(got[0]["features"]) == [1.0, 2.0] and got[0]["label"] == 1.0  # rows with a missing feature are skipped


def test_recommended_items_follow_the_ratings(spark):
    rng = np.random.default_rng(3)
    u, v = rng.uniform(0.5, 2, (20, 2)), rng.uniform(0.5, 2, (15, 2))
    full = u @ v.T
    data = [(i, j, float(full[i, j])) for i in range(20) for j in range(15) if (i + j) % 5]
    model = tuning.als(spark.createDataFrame(data, "u int, i int, r float"), user="u", item="i", rating="r", rank=2, iters=15, reg=0.001)
    top = {r["u"]: [(x["i"], x["rating"]) for x in r["recommendations"]] for r in model.recommendForAllUsers(3).collect()}
    assert len(top) == 20 and all(len(x) == 3 and [r for _, r in x] == sorted((r for _, r in x), reverse=True) for x in top.values())
    assert np.mean([abs(full[k, i] - r) for k, x in top.items() for i, r in x]) < 0.5


def test_training_run_scores_all_rows(spark, tmp_path):
    from punctual.operators import folds

    rng = np.random.default_rng(4)
    data = [(i, 2015 + i % 4, float(a), float(a + rng.normal() > 0)) for i, a in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(data, "id int, y int, a double, late double").withColumn("d", F.make_date("y", F.lit(1), F.lit(1)))
    out = pipelines.train_and_evaluate(df, folds.folds(df, "years", "d"), cols=["a"], label="late", keys=["id"], grid=[{"regParam": 0.0, "maxIter": 5}, {"regParam": 5.0, "maxIter": 5}], history=str(tmp_path / "h"))
    row = out.first()
    assert row["tp"] + row["tn"] + row["fp"] + row["fn"] == 600 and row["params"] in ("maxIter=5, regParam=0.0", "maxIter=5, regParam=5.0")
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1


# Reports


def test_reports_bear_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 0), ("a", None, 1), (None, "x", 0), (None, None, None)], "o string, d string, y int")
    got = reports.delay_summaries(df, {"from": ["o"], "both": ["o", "d"]}, "y")
    told = {(r["report"], r["group"]): (r["place"], r["ontime"], r["delayed"]) for r in got.collect()}
    assert told == {("from", "a"): (1, 1, 2), ("from", "?"): (2, 1, 0), ("both", "a-?"): (1, 0, 1), ("both", "a-x"): (2, 1, 1), ("both", "?-x"): (3, 1, 0)}
    with pytest.raises(ValueError):
        reports.delay_summaries(df, {"a": ["o"], "b": ["o"]}, "y")
    assert reports.delay_summaries(df.limit(0), {"from": ["o"]}, "y").count() == 0
    shares = {(r["given"], r["value"], r["outcome"]): r["share"] for r in reports.conditional_shares(df.withColumn("z", F.when(F.col("o") == "a", 1).otherwise(0)), "y", "z").collect()}
    assert shares["z", "1", "1"] == pytest.approx(2 / 3) and shares["y", "1", "1"] == 1 and shares["y", "0", "1"] == 0.5
    known = spark.createDataFrame([("a", 3)], "o string, seats int")
    got = {(r["attribute"], r["value"]): (r["n"], r["delayed"]) for r in reports.attribute_report(df, known, ["o"], {"seats": F.col("seats")}, "y").collect()}
    assert got == {("seats", "3"): (3, 2), ("seats", None): (1, 0)}
    assert reports.cancellations(df, ["o"], "y").where("o IS NULL").first()["operated"] == 2
    assert reports.durations(df.withColumn("t", F.lit(0.0)), "t", "y", width=5.0, groups=3).count() == 0
    assert reports.by_period(df.withColumn("m", F.lit(1)), F.lit(2020), "m", "y").count() == 2




def test_a_task_learns_from_a_bounded_number_of_rows(rows, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    one = rows.coalesce(1)
    assert tuning.dealt(one).rdd.getNumPartitions() == 1  # few rows stay as they come
    learner = GBTClassifier(maxIter=2, maxDepth=2, seed=1)
    many = tuning.dealt(one, learner, few=100, rows_per_task=100)
    assert many.rdd.getNumPartitions() == 8 and many.columns == ["features", "label"] and many.count() == 800
    learned_from = []
    monkeypatch.setattr(tuning, "dealt", lambda train, *a: learned_from.append(train) or many)
    tuning.train_gbt(one, maxIter=2, maxDepth=2)
    assert learned_from == [one]


def test_largest_products_are_brute_force(spark):
    from punctual.operators import recommend

    rng = np.random.default_rng(29)
    u, v = rng.normal(size=(700, 4)).astype(np.float32), (rng.normal(size=(3000, 4)) + 0.3).astype(np.float32)
    u[:300] += 4  # many users of nearly one direction
    v[5] = v[2999]  # a tie goes to the smaller id
    v[5:9] *= 3
    table = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<float>")
    scores = u.astype(np.float64) @ v.astype(np.float64).T
    want = {i: np.lexsort((np.arange(len(v)), -s))[:3].tolist() for i, s in enumerate(scores)}
    for more in ({"cells": 60, "longest": 50}, {"cells": 7, "longest": 2, "users_at_once": 40, "items_at_once": 500}):
        got = {}
        for r in recommend.largest_products(table(u), table(v), 3, **more).orderBy("user", "rank").collect():
            got.setdefault(r["user"], []).append(r["item"])
        assert got == want


def test_both_ways_to_recommend_agree(spark):
    from punctual.operators import recommend

    rng = np.random.default_rng(31)
    ratings = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 40, 900), rng.integers(0, 90, 900), rng.uniform(1, 50, 900), strict=True)], "u int, i int, r float")
    model = tuning.als(ratings, user="u", item="i", rating="r", rank=3, iters=3)
    all_pairs, pruned = (sorted(map(tuple, recommend.top_items(model, 3, **more).collect())) for more in ({}, {"few": 0}))
    assert all_pairs == pruned and len(pruned) == 3 * model.userFactors.count()
