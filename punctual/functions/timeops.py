"""Times: clock readings to timestamps, zones, hours and holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.parse import flag, hhmm


def local_ts(date: Column, clock: Column) -> Column:
    """Local wall clock of a date (text or date) and HHMM; null for times that no clock shows, such as 2400."""
    return F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), F.concat(hhmm(clock), F.lit("00"))), F.lit("yyyy-MM-dd HHmmss"))


def shift(ts: Column, interval: str) -> Column:
    return ts + F.expr(f"INTERVAL {interval}")


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(mins=minutes.cast("int"))


def to_utc(ts: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(ts, zone)


def ceil_hour(ts: Column) -> Column:
    """The hour that a reading is known at: 14:01 to 15:00 give 15:00."""
    return F.date_trunc("hour", ts + F.expr("INTERVAL '59' MINUTE"))


def lead_hour(ts: Column, lead: str = "'2' HOUR") -> Column:
    """The hour whose readings are known `lead` before."""
    return F.date_trunc("hour", ts - F.expr(f"INTERVAL {lead}"))


def seconds_between(a: Column, b: Column) -> Column:
    """From a to b."""
    return F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))


# Holidays as (month, day), and as (month, weekday with Sunday = 1, which one; -1: the last).
FIXED_HOLIDAYS = {"new_year": (1, 1), "independence": (7, 4), "veterans": (11, 11), "christmas": (12, 25)}
FLOATING_HOLIDAYS = {
    "king": (1, 2, 3),
    "presidents": (2, 2, 3),
    "memorial": (5, 2, -1),
    "labor": (9, 2, 1),
    "columbus": (10, 2, 2),
    "thanksgiving": (11, 5, 4),
}


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """holiday, day: federal holidays of the years, and the day off for a fixed one on a weekend."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    parts = []
    for name, (m, d) in FIXED_HOLIDAYS.items():
        day = F.make_date("y", F.lit(m), F.lit(d))
        off = F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)
        parts.append(years.select(F.lit(name).alias("holiday"), F.explode(F.array_distinct(F.array(day, off))).alias("day")))
    for name, (m, weekday, k) in FLOATING_HOLIDAYS.items():
        first = F.make_date("y", F.lit(m), F.lit(1))
        if k > 0:
            day = F.date_add(first, (weekday - F.dayofweek(first) + 7) % 7 + 7 * (k - 1))
        else:
            last = F.last_day(first)
            day = F.date_sub(last, (F.dayofweek(last) - weekday + 7) % 7)
        parts.append(years.select(F.lit(name).alias("holiday"), day.alias("day")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holiday_flags(df: DataFrame, date: str, calendar: DataFrame, n: int = 5) -> DataFrame:
    """`df` with is_holiday and near_holiday (within n days on either side). The calendar has a few rows a year."""
    near = calendar.select(F.col("day").alias("_day"), F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("_off"))
    near = near.select(F.date_add("_day", F.col("_off")).alias("_day"), (F.col("_off") == 0).alias("_is")).groupBy("_day").agg(F.max("_is").alias("_is"))
    joined = df.join(F.broadcast(near), F.to_date(date) == F.col("_day"), "left")
    return joined.withColumn("is_holiday", flag(F.col("_is"))).withColumn("near_holiday", flag(F.col("_day").isNotNull())).drop("_day", "_is")
