"""Feature preparation. What is learned is learned on training rows and applied to others."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_target_mean(train: DataFrame, key: str, label: str) -> DataFrame:
    """key, target_mean."""
    return train.groupBy(key).agg(F.avg(label).alias("target_mean"))


def target_mean_encode(train: DataFrame, df: DataFrame, key: str, label: str, name: str = "target_mean") -> DataFrame:
    """`df` with the training mean of its key; keys that training lacks get the mean of all."""
    groups = train.groupBy(key).agg(F.sum(label).alias("_yes"), F.count(label).alias("_n"))
    means = groups.select(key, F.try_divide("_yes", "_n").alias("_mean"))
    overall = groups.agg(F.try_divide(F.sum("_yes"), F.sum("_n")).alias("_all"))  # of the same groups: training rows are shuffled once
    joined = df.join(means, key, "left").join(F.broadcast(overall))
    return joined.withColumn(name, F.coalesce("_mean", "_all")).drop("_mean", "_all")


def fit_encoder(train: DataFrame, categories: list[str], ints: list[str] = ()) -> PipelineModel:
    """Index and one-hot encode; values that training lacks have a place of their own."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}_index" for c in categories], handleInvalid="keep", stringOrderType="frequencyDesc")
    hot = OneHotEncoder(inputCols=[*(f"{c}_index" for c in categories), *ints], outputCols=[f"_{c}" for c in (*categories, *ints)], handleInvalid="keep")
    return Pipeline(stages=[index, hot]).fit(train)


def _facts(train: DataFrame, cols: list[str], low, high) -> DataFrame:
    return train.agg(*[x for c in cols for x in (low(c).alias(f"_lo_{c}"), high(c).alias(f"_hi_{c}"))])


def _apply(df: DataFrame, facts: DataFrame, cols: list[str], formula) -> DataFrame:
    joined = df.join(F.broadcast(facts))  # one row
    return joined.withColumns({c: formula(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols}).drop(*facts.columns)


def minmax(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """`df` with columns scaled by the training range; 0.5 where that is one value."""
    scale = lambda x, lo, hi: F.coalesce(F.try_divide(x - lo, hi - lo), F.when(x.isNotNull(), 0.5))
    return _apply(df, _facts(train, cols, F.min, F.max), cols, scale)


def zscore(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """`df` with columns in training standard deviations from the training mean; 0 where there is no spread."""
    scale = lambda x, mean, sd: F.coalesce(F.try_divide(x - mean, sd), F.when(x.isNotNull(), 0.0))
    return _apply(df, _facts(train, cols, F.avg, F.stddev_samp), cols, scale)


def assemble(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """`df` with features and label; an old features column goes."""
    named = df.drop("features").withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(named)
