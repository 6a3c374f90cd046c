"""Sampling and class balance, the same in every run: rows are chosen by the hash of their key."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.relational import replicate


def unit(keys: list[str], salt: str = "") -> Column:
    """A number from 0 to 1 by the MD5 of the keys and a salt."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample(df: DataFrame, fraction: float, keys: list[str], salt: str = "") -> DataFrame:
    return df.where(unit(keys, salt) < fraction)


def take_sample(df: DataFrame, n: int, keys: list[str], salt: str = "") -> DataFrame:
    """n rows: those with the least hashes."""
    return df.orderBy(unit(keys, salt), *keys).limit(n)


def undersample(df: DataFrame, label: str, ratio: float, keys: list[str], salt: str = "") -> DataFrame:
    """All rows of class 1 and one in `ratio` of class 0."""
    return df.where((F.col(label) == 1) | ((F.col(label) == 0) & (unit(keys, salt) < 1 / ratio)))


def oversample(df: DataFrame, label: str, ratio: int) -> DataFrame:
    """Class 1 `ratio` times."""
    return df.where(F.col(label) == 0).unionByName(replicate(df.where(F.col(label) == 1), ratio))


class DownSampler(Transformer, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps class 1 and a share of class 0 of 1 / ratio."""

    ratio = Param(Params._dummy(), "ratio", "how many of class 0 one stands for", TypeConverters.toFloat)
    keyCols = Param(Params._dummy(), "keyCols", "what a row is chosen by", TypeConverters.toListString)
    salt = Param(Params._dummy(), "salt", "another one gives another sample", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", ratio: float = 3.0, keyCols: list[str] | None = None, salt: str = ""):
        super().__init__()
        self._setDefault(ratio=3.0, salt="", keyCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keys = self.getOrDefault(self.keyCols) or dataset.columns
        return undersample(dataset, self.getLabelCol(), self.getOrDefault(self.ratio), keys, self.getOrDefault(self.salt))


class SampleAssembler(Transformer, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """A sample of rows as label and an array of features."""

    inputCols = Param(Params._dummy(), "inputCols", "features", TypeConverters.toListString)
    keyCols = Param(Params._dummy(), "keyCols", "what a row is chosen by", TypeConverters.toListString)
    fraction = Param(Params._dummy(), "fraction", "share of rows", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str = "label", keyCols: list[str] | None = None, fraction: float = 1.0):
        super().__init__()
        self._setDefault(inputCols=[], keyCols=[], fraction=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        inputs, label = self.getOrDefault(self.inputCols), self.getLabelCol()
        chosen = sample(dataset, self.getOrDefault(self.fraction), self.getOrDefault(self.keyCols) or dataset.columns)
        vector = VectorAssembler(inputCols=inputs, outputCol="_v", handleInvalid="skip").transform(chosen.select(*inputs, label))
        return vector.select(vector_to_array("_v").alias("features"), F.col(label).alias("label"))
