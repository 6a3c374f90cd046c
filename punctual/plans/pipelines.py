"""Whole pipelines, made of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from punctual.functions import parse, timeops
from punctual.operators import aggregates as agg
from punctual.operators import features, joins, metrics, relational, sampling, tuning, windows
from punctual.sources import sinks

# Readings by what is taken of them in an hour.
NUMBERS = ["HourlyAltimeterSetting", "HourlyDewPointTemperature", "HourlyDryBulbTemperature", "HourlyPressureChange", "HourlyRelativeHumidity", "HourlySeaLevelPressure", "HourlyStationPressure", "HourlyWetBulbTemperature", "HourlyWindGustSpeed", "HourlyWindSpeed"]


def build_airports(flights: DataFrame, codes: DataFrame, stations: DataFrame, zones: DataFrame, places: DataFrame, *, origin: str = "ORIGIN", dest: str = "DEST", miles: float = 20.0) -> DataFrame:
    """Airports that flights use, with code row, zone and one station: their own, else the nearest within `miles`.

    `places` has ws_station_id, lat, lon of stations. Airports without any station stay, with none.
    """
    ids = relational.distinct_ids([flights], [origin, dest])
    lon, lat = parse.coords(F.col("coordinates"))
    master = joins.build_airport_master(ids, codes.withColumns({"lat": lat, "lon": lon}), stations, zones)
    near = joins.knn_within(master.select("id", "lat", "lon"), places, left_key="id", right_key="ws_station_id", k=1, miles=miles)
    return joins.resolve_station(master, near, key="id", own="station_id", other="ws_station_id")


def clean_weather(raw: DataFrame) -> DataFrame:
    """Text readings as numbers and 0/1 flags, with the hour at which they are known; columns that are missing are left out."""
    out: dict[str, Column] = {"DATEHOUR": timeops.ceil_hour(F.col("DATE").try_cast("timestamp"))}
    have = set(raw.columns)
    out |= {c: parse.suffix_num(F.col(c)) for c in NUMBERS if c in have}
    if "HourlyVisibility" in have:
        out["HourlyVisibility"] = parse.visibility(F.col("HourlyVisibility"))
    if "HourlyPrecipitation" in have:
        rain = F.col("HourlyPrecipitation")
        trace, some = parse.precip_flags(rain)
        out |= {"Precip_Double": parse.precip(rain), "Trace_Rain": trace, "NonZero_Rain": some}
    if "HourlyWindDirection" in have:
        out["HourlyWindDirection"], out["Calm_Winds"] = parse.wind_dir(F.col("HourlyWindDirection"))
    if "HourlyPressureTendency" in have:
        out |= {f"HourlyPressureTendency_{k.capitalize()}": c for k, c in parse.tendency_flags(F.col("HourlyPressureTendency")).items()}
    if "HourlySkyConditions" in have:
        out |= {f"Sky_Conditions_{k}": c for k, c in parse.contains_flags(F.col("HourlySkyConditions"), parse.SKY_CODES).items()}
    if "HourlyPresentWeatherType" in have:
        out |= {f"Present_Weather_{k}": c for k, c in parse.contains_any_flags(F.col("HourlyPresentWeatherType"), parse.PRESENT_WEATHER).items()}
    return raw.select("STATION", *[c.alias(n) for n, c in out.items()])


def build_weather(raw: DataFrame) -> DataFrame:
    """STATION, DATEHOUR with the mean of every number and the maximum of every flag."""
    clean = clean_weather(raw)
    kinds = dict(clean.dtypes)
    numbers = [c for c in clean.columns if kinds[c] == "double"]
    flags = [c for c in clean.columns if kinds[c] == "int"]
    return agg.hourly_rollup(clean, "STATION", "DATEHOUR", numbers, flags)


def build_joined(flights: DataFrame, airports: DataFrame, weather: DataFrame, *, date: str = "FL_DATE", clock: str = "CRS_DEP_TIME", origin: str = "ORIGIN", dest: str = "DEST", key: list[str]) -> DataFrame:
    """Flights, once for each `key`, with both airports, departure in UTC, and both stations' readings known two hours before."""
    others = [c for c in flights.columns if c not in key]
    # of several rows with one key the least: the same in every run
    once = flights.groupBy(*key).agg(F.min(F.struct(*others)).alias("_least")).select(*key, "_least.*") if others else flights.distinct()
    local = once.withColumn("local_ts", timeops.local_ts(F.col(date), F.col(clock)))
    placed = joins.join_roles(local, airports, {"origin": origin, "dest": dest}, "id")
    utc = placed.withColumn("utc_ts", timeops.to_utc(F.col("local_ts"), F.col("origin_zone")))
    hourly = weather.withColumnsRenamed({"STATION": "station", "DATEHOUR": "hour"})
    side = lambda role: hourly.withColumnsRenamed({c: f"weather_{c}" for c in hourly.columns})
    at = timeops.lead_hour(F.col("utc_ts"))
    return joins.hour_join(utc, side("x"), entity="weather_station", hour="weather_hour", roles={"origin": "origin_station", "dest": "dest_station"}, fact_hour=at)


@dataclass(frozen=True)
class FeatureSpec:
    """The columns that features are made of: `numbers` are scaled, `categories` and `ints` one-hot encoded."""

    label: str
    aircraft: str
    place: str
    ts: str
    date: str
    cancelled: str
    numbers: list[str]
    categories: list[str] = field(default_factory=list)
    ints: list[str] = field(default_factory=list)

    def complete(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (self.label, *self.numbers)])


@dataclass(frozen=True)
class Learned:
    """What features take from training rows: the mean label by place and of all, ranges of numbers, the encoder."""

    means: DataFrame
    overall: float | None
    ranges: dict[str, tuple[float | None, float | None]]
    encoder: PipelineModel | None

    def save(self, path: str) -> None:
        spark = self.means.sparkSession
        sinks.write_parquet(self.means, f"{path}/means")
        rows = [(c, None if lo is None else float(lo), None if hi is None else float(hi)) for c, (lo, hi) in self.ranges.items()]
        sinks.write_parquet(spark.createDataFrame([(None, self.overall, None), *rows], "column string, low double, high double"), f"{path}/ranges")
        if self.encoder:
            sinks.save_model(self.encoder, f"{path}/encoder")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, encoder: bool = True) -> Learned:
        rows = {r["column"]: (r["low"], r["high"]) for r in spark.read.parquet(f"{path}/ranges").collect()}
        return cls(spark.read.parquet(f"{path}/means"), rows.pop(None)[0], rows, sinks.load_model(PipelineModel, f"{path}/encoder") if encoder else None)


def learn_features(joined: DataFrame, spec: FeatureSpec, train: Column) -> Learned:
    """One pass over the training rows groups them by place; the means and ranges of all come from those groups."""
    rows = relational.drop_cancelled(joined, spec.cancelled).where(train)
    valid = lambda c: F.when(spec.complete(), F.col(c))
    ends = [x for c in spec.numbers for x in (F.min(valid(c)).alias(f"_lo_{c}"), F.max(valid(c)).alias(f"_hi_{c}"))]
    groups = sinks.checkpointed(rows.groupBy(spec.place).agg(F.sum(spec.label).alias("_yes"), F.count(spec.label).alias("_n"), *ends))
    all_ = groups.agg(F.try_divide(F.sum("_yes"), F.sum("_n")).alias("overall"), *[f(f"{p}{c}").alias(f"{p}{c}") for c in spec.numbers for f, p in ((F.min, "_lo_"), (F.max, "_hi_"))]).first()
    encoder = features.fit_encoder(rows.where(spec.complete()), spec.categories, spec.ints) if spec.categories else None
    means = groups.select(spec.place, F.try_divide("_yes", "_n").alias("_mean"))
    return Learned(means, all_["overall"], {c: (all_[f"_lo_{c}"], all_[f"_hi_{c}"]) for c in spec.numbers}, encoder)


def feature_steps(spec: FeatureSpec, calendar: DataFrame, learned: Learned) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The steps from joined rows to features, by name and in order; none of them reads training rows again."""

    def place_mean(df: DataFrame) -> DataFrame:
        return df.join(learned.means, spec.place, "left").withColumn("place_mean", F.coalesce("_mean", F.lit(learned.overall))).drop("_mean")

    def scaled(df: DataFrame) -> DataFrame:
        at = {c: (F.lit(lo).cast("double"), F.lit(hi).cast("double")) for c, (lo, hi) in learned.ranges.items()}
        return df.withColumns({c: F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.when(F.col(c).isNotNull(), 0.5)) for c, (lo, hi) in at.items()})

    steps = [
        ("not_cancelled", lambda df: relational.drop_cancelled(df, spec.cancelled)),
        ("prior_flag", lambda df: windows.prior_flag(df, spec.aircraft, spec.ts, spec.label, one_pass=True)),
        ("holidays", lambda df: timeops.holiday_flags(df, spec.date, calendar)),
        ("place_mean", place_mean),
        ("complete", lambda df: relational.require_not_null(relational.drop_leakage(df), [spec.label, *spec.numbers])),
    ]
    if learned.encoder:
        steps.append(("encoded", learned.encoder.transform))
    return [*steps, ("scaled", scaled)]


def build_features(joined: DataFrame, calendar: DataFrame, *, train: Column, **spec) -> dict[str, DataFrame]:
    """The frame after each step by name, the features last. What is learned is learned where `train` holds, a condition on `joined`."""
    given = FeatureSpec(**spec)
    frames = {"joined": joined}
    for name, step in feature_steps(given, calendar, learn_features(joined, given, train)):
        frames[name] = step(list(frames.values())[-1])
    return frames


AUDIT = "dataset string, ts timestamp, source string, destination string, sequence int, step string, cols_after int, rows_after long"


#: Steps that neither add nor drop rows.
KEEPING = {"prior_flag", "holidays", "place_mean", "encoded", "scaled"}


def settled_counts(frames: list[tuple[str, DataFrame]], observed: list[int]) -> list[int]:
    """Rows of each step: those observed, if every step that keeps rows has as many as the one before it; else all are counted anew.

    Observed counts of a stage whose output was lost with an executor and made again may be too high; what comes after its
    shuffle is counted in another stage, so the two differ.
    """
    fits = all(n == before for (name, _), before, n in zip(frames[1:], observed, observed[1:], strict=False) if name in KEEPING)
    return observed if fits else [df.count() for _, df in frames]


def save_features(joined: DataFrame, calendar: DataFrame, spec: FeatureSpec, learned: Learned, *, dataset: str, source: str, destination: str, log: str, by: list[str] | None = None) -> DataFrame:
    """Write the features of `joined` to `destination`, add what every step left over to the log, and read the features.

    Rows are counted by metrics that Spark observes while the features are written, so the whole of it is one pass
    over `joined` (they are checked, see `settled_counts`). The log gets the step `saved` last, whose rows are those of the written files.
    """
    spark = joined.sparkSession
    seen: list[Observation] = []
    frames: list[tuple[str, DataFrame]] = []

    def watched(name: str, df: DataFrame) -> DataFrame:
        seen.append(Observation(f"{name} {uuid.uuid4().hex}"))
        frames.append((name, df))
        return df.observe(seen[-1], F.count(F.lit(1)).alias("rows"))

    with sinks.in_new_session(joined=joined, calendar=calendar, means=learned.means) as there:
        df = watched("joined", there["joined"])
        for name, step in feature_steps(spec, there["calendar"], replace(learned, means=there["means"])):
            df = watched(name, step(df))
        sinks.write_partitioned(df, destination, by) if by else sinks.write_parquet(df, destination)
        counts = settled_counts(frames, [x.get["rows"] for x in seen])
    saved = spark.read.parquet(destination)
    told = [(name, len(df.columns), n) for (name, df), n in zip(frames, counts, strict=True)] + [("saved", len(saved.columns), saved.count())]
    now = datetime.now(UTC).replace(tzinfo=None)
    rows = [(dataset, now, source, destination, i, name, width, n) for i, (name, width, n) in enumerate(told, 1)]
    sinks.append_log(spark.createDataFrame(rows, AUDIT), log)
    return saved


def train_and_evaluate(df: DataFrame, folds: dict[str, DataFrame], *, cols: list[str], label: str, keys: list[str], grid: list[dict] | None = None, ratio: float = 3.0, history: str | None = None) -> DataFrame:
    """model, params and scores of the best logistic regression: balanced folds in time, searched by F-beta, scored on all of `df`."""
    lr = LogisticRegression()
    ready = {n: features.assemble(f, cols, label) for n, f in folds.items()}
    balanced = {n: sampling.undersample(f.where("cv = 'train'"), "label", ratio, keys).unionByName(f.where("cv = 'test'")) for n, f in ready.items()}
    settings = grid if grid is not None else tuning.lr_grid(lr)
    named = [{getattr(lr, p) if isinstance(p, str) else lr.getParam(p.name): v for p, v in g.items()} for g in settings]
    found = tuning.TemporalCrossValidator(lr, named, metrics.FBetaEvaluator()).fit(balanced)
    predicted = found.transform(features.assemble(df, cols, label))
    out = metrics.metrics(predicted, "label", "prediction").withColumn("model", F.lit("logistic_regression"))
    best = max(range(len(named)), key=found.avgMetrics.__getitem__)
    out = out.withColumn("params", F.lit(", ".join(sorted(f"{p.name}={v}" for p, v in named[best].items()))))
    if history:
        tuning.record_run(out, history)
    return out


def report(df: DataFrame, keys: list[str], label: str, *, min_total: int = 0, n: int = 20) -> DataFrame:
    """The groups with the highest rate, their rows and share of all rows."""
    rates = agg.rate_by(df, keys, label)
    return relational.top_n(joins.share_of_total(rates, "n").where(F.col("n") >= min_total), "rate", n, keys)


def save_by_year(df: DataFrame, path: str, year: str = "YEAR") -> None:
    sinks.write_partitioned(df, path, [year])
