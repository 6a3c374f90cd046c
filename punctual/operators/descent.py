"""Batch gradient descent: each step is one aggregate of the gradient's parts over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.formulas import log_loss, sigmoid
from punctual.sources.sinks import cached


def _linear(weights: list[float], cols: list[str]) -> Column:
    out = F.lit(weights[0])
    for w, c in zip(weights[1:], cols, strict=True):
        out = out + F.lit(w) * F.col(c)
    return out


def _descend(train: DataFrame, cols: list[str], label: str, steps: int, rate: float, reg: float, lasso: bool, link, loss) -> DataFrame:
    with cached(train.select(*cols, label)) as kept:  # every step reads it
        return _steps(kept, cols, label, steps, rate, reg, lasso, link, loss)


def _steps(train: DataFrame, cols: list[str], label: str, steps: int, rate: float, reg: float, lasso: bool, link, loss) -> DataFrame:
    weights, rows = [0.0] * (len(cols) + 1), []
    for step in range(steps):
        p = link(_linear(weights, cols))
        error = p - F.col(label)
        got = train.agg(F.avg(loss(F.col(label), p)).alias("loss"), F.avg(error).alias("g0"), *[F.avg(error * F.col(c)).alias(f"g{i}") for i, c in enumerate(cols, 1)]).first()
        rows.append((step, float(got["loss"]), [float(w) for w in weights]))
        grow = [0.0, *[reg * ((w > 0) - (w < 0) if lasso else w) for w in weights[1:]]]
        weights = [w - rate * (got[f"g{i}"] + g) for i, (w, g) in enumerate(zip(weights, grow, strict=True))]
    rows.append((steps, float(train.agg(F.avg(loss(F.col(label), link(_linear(weights, cols))))).first()[0]), [float(w) for w in weights]))
    return train.sparkSession.createDataFrame(rows, "step int, loss double, weights array<double>")


def lr_gradient_descent(train: DataFrame, cols: list[str], label: str, *, steps: int = 15, rate: float = 0.5, reg: float = 0.0, lasso: bool = False) -> DataFrame:
    """step, loss, weights (the intercept first) before each step and after the last, of logistic regression."""
    return _descend(train, cols, label, steps, rate, reg, lasso, sigmoid, log_loss)


def ols_gradient_descent(train: DataFrame, cols: list[str], label: str, *, steps: int = 15, rate: float = 0.1, reg: float = 0.0, lasso: bool = False) -> DataFrame:
    """The same of linear regression by squared error (half of it, so that the gradient has no factor)."""
    return _descend(train, cols, label, steps, rate, reg, lasso, lambda x: x, lambda y, p: (p - y) * (p - y) / 2)


def loss_history(frames: dict[str, DataFrame], found: DataFrame, cols: list[str], label: str, *, beta: float = 0.5) -> DataFrame:
    """dataset, step, loss, soft_fbeta of every frame with the weights of every step (rows of `found`), each frame in one pass.

    The soft F-beta counts probabilities instead of verdicts.
    """
    steps = [(r["step"], r["weights"]) for r in found.orderBy("step").collect()]
    out = []
    for name, df in frames.items():
        y, parts = F.col(label), []
        for _, weights in steps:
            p = sigmoid(_linear(weights, cols))
            hit, false, missed = F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y)
            soft = F.try_divide((1 + beta * beta) * hit, (1 + beta * beta) * hit + beta * beta * missed + false)
            parts.append(F.struct(F.avg(log_loss(y, p)).alias("loss"), soft.alias("soft_fbeta")))
        one = df.agg(F.array(*parts).alias("all")).select(F.posexplode("all").alias("i", "x"))
        number = F.get(F.lit([s for s, _ in steps]), F.col("i"))
        out.append(one.select(F.lit(name).alias("dataset"), number.alias("step"), "x.loss", "x.soft_fbeta"))
    return reduce(DataFrame.unionByName, out)
