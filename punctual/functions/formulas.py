"""Formulas: distances, scores, vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_MILES = 3958.756


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_MILES) -> Column:
    """Distance on the globe between points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    square = lambda x: x * x
    h = square(F.sin((b - a) / 2)) + F.cos(a) * F.cos(b) * square(F.sin((F.radians(lon2) - F.radians(lon1)) / 2))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, tn: Column, fp: Column, fn: Column, beta: float = 0.5) -> dict[str, Column]:
    """precision, recall, f1, fbeta and accuracy of confusion counts; 0 where a denominator is 0."""
    p, r, b = ratio(tp, tp + fp), ratio(tp, tp + fn), beta * beta
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "fbeta": ratio((1 + b) * p * r, b * p + r), "accuracy": ratio(tp + tn, tp + tn + fp + fn)}


def weighted_prf(tp: Column, tn: Column, fp: Column, fn: Column, beta: float = 0.5) -> dict[str, Column]:
    """The same, each class weighted by its rows; weighted recall equals accuracy."""
    yes, no, n = prf(tp, tn, fp, fn, beta), prf(tn, tp, fn, fp, beta), tp + tn + fp + fn
    return {f"weighted_{k}": ratio(yes[k] * (tp + fn) + no[k] * (tn + fp), n) for k in ("precision", "recall", "f1", "fbeta")}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(label: Column, p: Column, eps: float = 1e-15) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


def vector_to_cols(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """The parts of an ML vector as columns."""
    parts = df.withColumn("_parts", vector_to_array(vector))
    return parts.withColumns({n: F.get("_parts", F.lit(i)) for i, n in enumerate(names)}).drop("_parts")
