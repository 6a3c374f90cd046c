"""Search over folds in time, run records, and learners."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasCollectSubModels, HasLabelCol, HasParallelism, HasPredictionCol
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MetaAlgorithmReadWrite, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.operators.metrics import segment_metrics
from punctual.operators.windows import latest_per
from punctual.sources.sinks import append_log, cached


class ConstantClassifier(Estimator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Always predicts `constant`: the baseline that any classifier must beat. It learns nothing."""

    constant = Param(Params._dummy(), "constant", "what is predicted", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", constant: float = 1.0):
        super().__init__()
        self._setDefault(constant=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ConstantModel:
        return ConstantModel(predictionCol=self.getPredictionCol(), constant=self.getOrDefault(self.constant))


class ConstantModel(Model, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    constant = Param(Params._dummy(), "constant", "what is predicted", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, predictionCol: str = "prediction", constant: float = 1.0):
        super().__init__()
        self._setDefault(constant=1.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), F.lit(self.getOrDefault(self.constant)))


def _settings_out(grid: list[dict]) -> list[list[dict]]:
    return [[{"parent": p.parent, "name": p.name, "value": v} for p, v in setting.items()] for setting in grid]


def _settings_in(told: list[list[dict]], estimator: Estimator) -> list[dict]:
    """The settings of an estimator that was read again; its stages have the ids they were written with."""
    stages = MetaAlgorithmReadWrite.getUidMap(estimator)
    return [{stages[x["parent"]].getParam(x["name"]): x["value"] for x in setting} for setting in told]


class TemporalCrossValidator(Estimator, HasParallelism, HasCollectSubModels, MLReadable, MLWritable):
    """Fits every setting on each fold's train rows, scores it on the test rows, and refits the best.

    `folds` are [name, condition of training rows, condition of testing rows] on the columns of the frame that is
    fitted, such as `folds.predicates` gives; then it is a stage like any other, also inside a Pipeline. Or `fit` takes frames by name that
    have a column cv (train or test). refit: "last" fits on the last fold's training rows, "all" on those of every fold.
    A fold without rows on either side can't be fitted and raises what the estimator raises.
    """

    folds = Param(Params._dummy(), "folds", "name, training and testing condition of every fold", TypeConverters.identity)
    refit = Param(Params._dummy(), "refit", "last or all", TypeConverters.toString)

    def __init__(self, estimator: Estimator | None = None, grid: list[dict] | None = None, evaluator: Evaluator | None = None, *, folds: list[list[str]] | None = None, parallelism: int = 4, refit: str = "last", collectSubModels: bool = False):
        super().__init__()
        self.estimator, self.grid, self.evaluator = estimator, grid, evaluator
        self._setDefault(parallelism=1, collectSubModels=False, refit="last", folds=[])
        if refit not in ("last", "all"):
            raise ValueError(f"no such refit: {refit}")
        self._set(parallelism=parallelism, refit=refit, collectSubModels=collectSubModels, folds=[list(f) for f in folds or []])

    def copy(self, extra: dict | None = None) -> TemporalCrossValidator:
        out = super().copy(extra)
        out.estimator, out.evaluator = self.estimator.copy(extra), self.evaluator.copy(extra)
        return out

    def _sides(self, data) -> list[tuple[DataFrame, DataFrame]]:
        if isinstance(data, dict):
            return [(f.where("cv = 'train'"), f.where("cv = 'test'")) for f in data.values()]
        return [(data.where(a), data.where(b)) for _, a, b in self.getOrDefault(self.folds)]

    def _all_training(self, data) -> DataFrame:
        if not isinstance(data, dict):
            return data.where(" OR ".join(f"({a})" for _, a, _ in self.getOrDefault(self.folds)))
        parts = [f.where("cv = 'train'") for f in data.values()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.distinct()

    def _fit(self, dataset) -> TemporalCrossValidatorModel:
        sides, keep = self._sides(dataset), self.getOrDefault(self.collectSubModels)
        if not sides:
            raise ValueError("no folds")
        totals, kept = [0.0] * len(self.grid), []
        for train, test in sides:
            with cached(dealt(train)) as train, cached(dealt(test)) as test, ThreadPoolExecutor(self.getParallelism()) as pool:

                def score(setting, train=train, test=test):
                    model = self.estimator.fit(train, setting)
                    return self.evaluator.evaluate(model.transform(test)), model if keep else None

                got = list(pool.map(inheritable_thread_target(train.sparkSession)(score), self.grid))
            totals = [a + x / len(sides) for a, (x, _) in zip(totals, got, strict=True)]
            kept.append([m for _, m in got])
        best = (max if self.evaluator.isLargerBetter() else min)(range(len(self.grid)), key=totals.__getitem__)
        rows = self._all_training(dataset) if self.getOrDefault(self.refit) == "all" else sides[-1][0]
        return TemporalCrossValidatorModel(self.estimator.fit(dealt(rows), self.grid[best]), totals, best, kept if keep else None)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class TemporalCrossValidatorModel(Model, MLReadable, MLWritable):
    """The best model refitted, the mean score of every setting, which was best, and on demand the models of every fold and setting."""

    def __init__(self, bestModel: Model | None = None, avgMetrics: list[float] = (), bestIndex: int = 0, subModels: list[list[Model]] | None = None):
        super().__init__()
        self.bestModel, self.avgMetrics, self.bestIndex, self.subModels = bestModel, list(avgMetrics), bestIndex, subModels

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.bestModel.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Metadata as for any stage, and the stages inside in folders of their own."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        x = self.instance
        if isinstance(x, TemporalCrossValidator):
            extra, inside = {"grid": _settings_out(x.grid)}, {"estimator": x.estimator, "evaluator": x.evaluator}
        else:
            extra = {"avgMetrics": x.avgMetrics, "bestIndex": x.bestIndex, "subModels": [len(f) for f in x.subModels or []]}
            inside = {"bestModel": x.bestModel} | {f"subModels/{i}/{j}": m for i, f in enumerate(x.subModels or []) for j, m in enumerate(f)}
        DefaultParamsWriter.saveMetadata(x, path, self.sparkSession, extraMetadata=extra)
        for name, stage in inside.items():
            stage.write().overwrite().save(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        inner = lambda name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", self.sparkSession)
        if self.cls is TemporalCrossValidator:
            estimator = inner("estimator")
            out = TemporalCrossValidator(estimator, _settings_in(told["grid"], estimator), inner("evaluator"))
        else:
            subs = [[inner(f"subModels/{i}/{j}") for j in range(n)] for i, n in enumerate(told["subModels"])] or None
            out = TemporalCrossValidatorModel(inner("bestModel"), told["avgMetrics"], told["bestIndex"], subs)
        out._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(out, told)
        return out


def grid_scores(model: TemporalCrossValidatorModel, grid: list[dict], df: DataFrame) -> DataFrame:
    """params, score: one row for each setting."""
    rows = [(", ".join(sorted(f"{p.name}={v}" for p, v in g.items())), float(s)) for g, s in zip(grid, model.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "params string, score double")


def run_summary(name: str, family: str, found: TemporalCrossValidatorModel, grid: list[dict], predictions: dict[str, DataFrame], *, seconds: float, strategies: dict[str, str] | None = None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One nested record of a run: model, family, seconds, strategies, parameters of the best setting, settings with their scores, and datasets with
    their confusion counts and scores. `record_run` adds it to the history.

    All datasets are scored in one pass; those without rows have no entry.
    """
    said = [{p.name: str(v) for p, v in g.items()} for g in grid]
    spark = next(iter(predictions.values())).sparkSession
    settings = [(x, float(s), i == found.bestIndex) for i, (x, s) in enumerate(zip(said, found.avgMetrics, strict=True))]
    schema = "model string, family string, seconds double, strategies map<string,string>, parameters map<string,string>, settings array<struct<params: map<string,string>, score: double, best: boolean>>"
    run = spark.createDataFrame([(name, family, float(seconds), strategies or {}, said[found.bestIndex], settings)], schema)
    rows = reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("dataset"), F.col(label).alias("_y"), F.col(prediction).alias("_p")) for n, p in predictions.items()])
    scored = segment_metrics(rows, ["dataset"], "_y", "_p")
    told = scored.agg(F.sort_array(F.collect_list(F.struct(*scored.columns))).alias("datasets"))  # a row for each dataset
    return run.join(F.broadcast(told))


def lr_grid(lr: LogisticRegression, reg: list[float] = (0.0, 0.01, 0.1, 0.5), elastic: list[float] = (0.0, 0.5, 1.0), iters: list[int] = (10, 20, 30)) -> list[dict]:
    return ParamGridBuilder().addGrid(lr.regParam, list(reg)).addGrid(lr.elasticNetParam, list(elastic)).addGrid(lr.maxIter, list(iters)).build()


#: Rows that one task learns from, and rows up to which a frame is learned from as it comes.
ROWS_PER_TASK, FEW_ROWS = 1_000_000, 4_000_000


def dealt(train: DataFrame, estimator: Estimator | None = None, *, rows_per_task: int = ROWS_PER_TASK, few: int = FEW_ROWS) -> DataFrame:
    """`train` in as many partitions as its rows need; only the columns that `estimator` learns from, if one is given.

    A learner keeps the rows in as many tasks as the frame comes in, and goes over them again and again: a task would hold ever more of a growing
    table. Frames of up to `few` rows stay as they are.
    """
    rows = train.count()
    if rows <= few:
        return train
    used = ("featuresCol", "labelCol", "weightCol", "validationIndicatorCol")
    cols = [estimator.getOrDefault(p) for p in estimator.params if p.name in used and estimator.isDefined(p)] if estimator else train.columns
    return train.select(*cols).repartition(-(-rows // rows_per_task))


def train_lr(train: DataFrame, *, weight: str | None = None, **params):
    return LogisticRegression(**params, **({"weightCol": weight} if weight else {})).fit(dealt(train))


def train_rf(train: DataFrame, *, trees: int = 30, depth: int = 20, seed: int = 1, **params):
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **params)
    return learner.fit(dealt(train, learner))


def train_gbt(train: DataFrame, *, seed: int = 1, **params):
    learner = GBTClassifier(seed=seed, **params)
    return learner.fit(dealt(train, learner))


def train_dt(train: DataFrame, *, depth: int = 5, seed: int = 1, **params):
    learner = DecisionTreeClassifier(maxDepth=depth, seed=seed, **params)
    return learner.fit(dealt(train, learner))


def depth_sweep(train: DataFrame, test: DataFrame, evaluator: Evaluator, depths: list[int]) -> DataFrame:
    """depth, score of trees."""
    with cached(dealt(train)) as train, cached(dealt(test)) as test:
        rows = [(d, float(evaluator.evaluate(DecisionTreeClassifier(maxDepth=d, seed=1).fit(train).transform(test)))) for d in depths]
    return train.sparkSession.createDataFrame(rows, "depth int, score double")


def als(ratings: DataFrame, *, user: str, item: str, rating: str, rank: int = 5, iters: int = 10, reg: float = 0.1, seed: int = 1):
    return ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=iters, regParam=reg, seed=seed, coldStartStrategy="drop").fit(ratings)


def record_run(df: DataFrame, path: str) -> None:
    """Add model, ts, params, scores rows to the history."""
    append_log(df.withColumn("ts", F.current_timestamp()) if "ts" not in df.columns else df, path)


def latest_runs(history: DataFrame) -> DataFrame:
    return latest_per(history, "model", "ts")
