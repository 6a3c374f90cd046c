import datetime as dt

import pytest
from pyspark.sql import functions as F

from punctual.functions import formulas, parse, timeops

PRECIP = [
    ("0.02s", 0.02, 0, 1),
    ("T", 0.0, 1, 1),
    ("0.00T", 0.0, 1, 1),
    ("*", 0.0, 0, 0),
    (None, 0.0, 0, 0),
    ("0.020.05", 0.05, 0, 1),
    ("0.100.050.20", 0.2, 0, 1),
    ("0.020.100.05s", 0.1, 0, 1),
    ("1.2345.678", 5.678, 0, 1),
    ("0.010.020.030.040.05", 0.03, 0, 1),
]


def test_precipitation(spark):
    df = spark.createDataFrame([(i, x) for i, (x, *_) in enumerate(PRECIP)], "i int, x string")
    trace, some = parse.precip_flags(F.col("x"))
    got = df.select("i", parse.precip(F.col("x")).alias("v"), trace.alias("t"), some.alias("n")).orderBy("i").collect()
    assert [(r["v"], r["t"], r["n"]) for r in got] == [tuple(p[1:]) for p in PRECIP]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_readings(spark):
    assert one(spark, "10.00V", parse.visibility) == 10.0
    assert one(spark, "29.92s", parse.suffix_num) == 29.92
    assert one(spark, "7V", parse.suffix_num) is None
    assert one(spark, "VRB", lambda x: parse.wind_dir(x)[0]) is None
    assert one(spark, "000", lambda x: parse.wind_dir(x)[0]) == 0.0
    assert one(spark, "000", lambda x: parse.wind_dir(x)[1]) == 1
    assert [one(spark, "3", lambda x, k=k: parse.tendency_flags(x)[k]) for k in ("increasing", "constant", "decreasing")] == [1, 0, 0]
    assert one(spark, 905, parse.dep_hour, "int") == 9
    assert one(spark, "|27", lambda x: parse.contains_any_flags(x, parse.PRESENT_WEATHER)["Hail"]) == 1
    assert one(spark, None, lambda x: parse.contains_flags(x, ["CLR"])["CLR"]) == 0


def test_hours(spark):
    ts = lambda h, m: dt.datetime(2015, 1, 1, h, m)
    assert one(spark, ts(14, 0), timeops.ceil_hour, "timestamp") == ts(14, 0)
    assert one(spark, ts(14, 1), timeops.ceil_hour, "timestamp") == ts(15, 0)
    assert one(spark, ts(17, 30), timeops.lead_hour, "timestamp") == ts(15, 0)


@pytest.mark.parametrize(
    ("zone", "date", "clock", "utc"),
    [
        ("America/New_York", "2015-01-15", 1730, dt.datetime(2015, 1, 15, 22, 30)),
        ("America/Chicago", "2015-07-15", 1730, dt.datetime(2015, 7, 15, 22, 30)),
        ("America/New_York", "2015-03-08", 230, dt.datetime(2015, 3, 8, 7, 30)),
        ("America/New_York", "2015-11-01", 130, dt.datetime(2015, 11, 1, 5, 30)),
        ("America/New_York", "2015-11-01", 2400, None),
    ],
)
def test_local_to_utc(spark, zone, date, clock, utc):
    df = spark.createDataFrame([(date, clock, zone)], "d string, c int, z string")
    assert df.select(timeops.to_utc(timeops.local_ts(F.col("d"), F.col("c")), F.col("z")).alias("t")).first()["t"] == utc


def test_holidays(spark):
    found = {(r["holiday"], str(r["day"])) for r in timeops.holidays(spark, 2015, 2015).collect()}
    assert {("thanksgiving", "2015-11-26"), ("memorial", "2015-05-25"), ("labor", "2015-09-07"), ("independence", "2015-07-03")} <= found


def test_haversine(spark):
    far = lambda *p: spark.range(1).select(F.round(formulas.haversine(*map(F.lit, p)), 4).alias("d")).first()["d"]
    assert far(37.362598, -121.929001, 37.618999, -122.375) == pytest.approx(30.1939, abs=1e-3)
    assert far(50.940299, 7.019147, 50.920730, 6.975269) == pytest.approx(2.3407, abs=1e-3)


def test_scores(spark):
    df = spark.createDataFrame([(3, 4, 1, 2), (0, 0, 0, 0)], "tp long, tn long, fp long, fn long")
    c = [F.col(x) for x in ("tp", "tn", "fp", "fn")]
    a, b = df.withColumns(formulas.prf(*c) | formulas.weighted_prf(*c)).collect()
    assert (a["precision"], a["recall"]) == (0.75, 0.6)
    assert a["f1"] == pytest.approx(0.6667, abs=1e-4)
    assert a["fbeta"] == pytest.approx(0.7143, abs=1e-4)
    assert a["weighted_recall"] == pytest.approx(a["accuracy"]) == pytest.approx(0.7)
    assert b["fbeta"] == 0
