"""Metrics of classifiers, each in one pass over the predictions."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.formulas import prf, ratio, weighted_prf
from punctual.operators.prefix import running_totals

CELLS = ["tp", "tn", "fp", "fn"]


def cells(label: str, pred: str | Column) -> list[Column]:
    y, p = F.col(label), F.col(pred) if isinstance(pred, str) else pred
    return [F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))]


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(*cells(label, pred))


def scores(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    """Confusion counts with all scores, plain and weighted by class, and the rates of false and true positives."""
    c = [F.col(x) for x in CELLS]
    out = counts.withColumns(prf(*c, beta) | weighted_prf(*c, beta))
    return out.withColumns({"fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "tpr": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def metrics(df: DataFrame, label: str, pred: str, beta: float = 0.5) -> DataFrame:
    return scores(confusion(df, label, pred), beta)


def segment_metrics(df: DataFrame, keys: list[str], label: str, pred: str, beta: float = 0.5) -> DataFrame:
    """Scores of every segment, also of those that lack some cell; weights are the segment's own classes."""
    return scores(df.groupBy(*keys).agg(*cells(label, pred)), beta)


def constant_baseline(df: DataFrame, label: str, beta: float = 0.5) -> DataFrame:
    """constant, scores: what always saying 0 or 1 would give."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("yes"), F.count_if(F.col(label) == 0).alias("no"))
    zero, one = F.lit(0).cast("long"), F.array(F.lit(0), F.lit(1))
    rows = n.withColumn("constant", F.explode(one))
    said = F.col("constant") == 1
    counts = rows.select("constant", F.when(said, F.col("yes")).otherwise(zero).alias("tp"), F.when(said, zero).otherwise(F.col("no")).alias("tn"), F.when(said, F.col("no")).otherwise(zero).alias("fp"), F.when(said, zero).otherwise(F.col("yes")).alias("fn"))
    return scores(counts, beta)


def curves(df: DataFrame, label: str, prob: str, bins: int = 100, beta: float = 0.5) -> DataFrame:
    """threshold, confusion counts and scores at every bin of the score: rows for ROC, precision-recall and F by threshold.

    Scores are counted by bin first, so the cumulative sums run over at most bins + 1 rows.
    """
    cut = F.greatest(F.lit(0), F.least(F.lit(bins), F.floor(F.col(prob) * bins)))
    binned = df.where(F.col(prob).isNotNull()).groupBy(cut.alias("b")).agg(F.count_if(F.col(label) == 1).alias("yes"), F.count_if(F.col(label) == 0).alias("no"))
    up = Window.orderBy(F.desc("b"))
    all_ = Window.partitionBy()
    run = binned.select("b", F.sum("yes").over(up).alias("tp"), F.sum("no").over(up).alias("fp"), F.sum("yes").over(all_).alias("_yes"), F.sum("no").over(all_).alias("_no"))
    counts = run.select((F.col("b") / bins).alias("threshold"), "tp", (F.col("_no") - F.col("fp")).alias("tn"), "fp", (F.col("_yes") - F.col("tp")).alias("fn"))
    return scores(counts, beta)


def exact_curves(df: DataFrame, label: str, prob: str, beta: float = 0.5) -> DataFrame:
    """threshold, confusion counts and scores at every different score, without bins.

    Rows are counted by score, then summed up from the highest score down over ranges of scores. Null scores are left out;
    labels other than 0 and 1 count as neither.
    """
    counted = df.where(F.col(prob).isNotNull()).groupBy(F.col(prob).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("yes"), F.count_if(F.col(label) == 0).alias("no"))
    ran = running_totals(counted, [F.desc("threshold")], {"tp": "yes", "fp": "no"})
    all_ = ran.agg(F.max("tp").alias("_yes"), F.max("fp").alias("_no"))
    counts = ran.join(F.broadcast(all_)).select("threshold", "tp", (F.col("_no") - F.col("fp")).alias("tn"), "fp", (F.col("_yes") - F.col("tp")).alias("fn"))
    return scores(counts, beta)


def area_under_roc(df: DataFrame, label: str, prob: str) -> DataFrame:
    """auc: the share of pairs of a row of class 1 and one of class 0 in which the first scores higher; equal scores count half.

    Exact: each score's rows of class 1 meet all rows of class 0 below it, which running totals give.
    """
    counted = df.where(F.col(prob).isNotNull()).groupBy(F.col(prob).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("yes"), F.count_if(F.col(label) == 0).alias("no"))
    ran = running_totals(counted, [F.asc("threshold")], {"upto": "no"})
    pairs = F.sum(F.col("yes").cast("double") * (F.col("upto") - F.col("no") / 2))
    return ran.agg(F.try_divide(pairs, F.sum("yes").cast("double") * F.sum("no")).alias("auc"))


def best_threshold(curve: DataFrame, by: str = "fbeta") -> DataFrame:
    """threshold and value of the largest score; of equal ones the higher threshold."""
    return curve.agg(F.max(F.struct(by, "threshold")).alias("m")).select("m.threshold", F.col(f"m.{by}").alias(by))


def errors(df: DataFrame, label: str, pred: str, cols: list[str]) -> DataFrame:
    """Wrong predictions with `error`, FP or FN."""
    return df.where(F.col(label) != F.col(pred)).withColumn("error", F.when(F.col(pred) == 1, "FP").otherwise("FN")).select(*cols, "error")


def feature_ranking(model, df: DataFrame, features: str = "features") -> DataFrame:
    """rank, feature, weight of a model's importances or coefficients, named by the vector's attributes."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = sorted(((names.get(i, f"f{i}"), float(w)) for i, w in enumerate(weights.toArray())), key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame([(k, n, w) for k, (n, w) in enumerate(rows, 1)], "rank int, feature string, weight double")


def loss_history(model, spark) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.summary.objectiveHistory)], "iteration int, loss double")


class FBetaEvaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """F-beta of class 1; one job."""

    beta = Param(Params._dummy(), "beta", "how many times recall weighs precision", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", beta: float = 0.5):
        super().__init__()
        self._setDefault(beta=0.5)
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        return metrics(dataset, self.getLabelCol(), self.getPredictionCol(), self.getOrDefault(self.beta)).first()["fbeta"]

    def isLargerBetter(self) -> bool:
        return True
