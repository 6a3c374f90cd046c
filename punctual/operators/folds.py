"""Temporal folds: by name a frame with a column cv, train or test, where all training is before all testing."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Years after the first that train and test, and the quarter.
QUARTER_BLOCKS = [(0, 1, 1), (0, 1, 3), (1, 2, 2), (1, 2, 4), (2, 3, 1), (2, 3, 3), (0, 3, 2), (0, 3, 4)]


@dataclass(frozen=True)
class Fold:
    name: str
    train: str
    test: str


def fold_specs(kind: str, first_year: int = 2015, last_year: int = 2018) -> list[Fold]:
    """Conditions on `y` and `q` of each fold.

    none: the last year tests. rolling: each later year tests all before it. years: pairs of years.
    quarters: one quarter of one year is tested by the same quarter of a later one (QUARTER_BLOCKS).
    """
    years = list(range(first_year, last_year + 1))
    if kind == "none":
        return [Fold("all", f"y < {years[-1]}", f"y = {years[-1]}")]
    if kind == "rolling":
        return [Fold(f"to_{y}", f"y < {y}", f"y = {y}") for y in years[1:]]
    if kind == "years":
        return [Fold(f"{a}_{b}", f"y = {a}", f"y = {b}") for a, b in zip(years[::2], years[1::2], strict=False)]
    if kind == "quarters":
        at = lambda k, q: f"y = {first_year + k} and q = {q}"
        return [Fold(f"{first_year + a}_{first_year + b}_q{q}", at(a, q), at(b, q)) for a, b, q in QUARTER_BLOCKS if first_year + b <= last_year]
    raise ValueError(f"no such folds: {kind}")


def folds(df: DataFrame, kind: str, date: str, first_year: int = 2015, last_year: int = 2018) -> dict[str, DataFrame]:
    dated = df.where(F.year(date).between(first_year, last_year)).withColumns({"y": F.year(date), "q": F.quarter(date)})
    return {f.name: dated.withColumn("cv", _side(f)).where("cv is not null").drop("y", "q") for f in fold_specs(kind, first_year, last_year)}


def predicates(kind: str, date: str, first_year: int = 2015, last_year: int = 2018) -> list[list[str]]:
    """[name, training condition, testing condition] of each fold, on the column `date` of one frame."""
    within = f"year(`{date}`) BETWEEN {first_year} AND {last_year}"
    said = lambda c: f"{within} AND {re.sub(r'\b[yq]\b', lambda m: {'y': f'year(`{date}`)', 'q': f'quarter(`{date}`)'}[m[0]], c)}"
    return [[f.name, said(f.train), said(f.test)] for f in fold_specs(kind, first_year, last_year)]


def _side(f: Fold) -> Column:
    return F.when(F.expr(f.train), "train").when(F.expr(f.test), "test")


def fold_counts(df: DataFrame, kind: str, date: str, first_year: int, last_year: int) -> DataFrame:
    """fold, cv, year, n of all folds in one pass."""
    dated = df.where(F.year(date).between(first_year, last_year)).withColumns({"y": F.year(date), "q": F.quarter(date)})
    sides = F.array(*[F.struct(F.lit(f.name).alias("fold"), _side(f).alias("cv")) for f in fold_specs(kind, first_year, last_year)])
    rows = dated.groupBy("y", "q").agg(F.count("*").alias("n")).withColumn("f", F.explode(sides)).where("f.cv is not null")
    return rows.groupBy("f.fold", "f.cv", F.col("y").alias("year")).agg(F.sum("n").alias("n"))
