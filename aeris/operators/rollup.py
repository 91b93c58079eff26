"""Incremental means: mergeable partial states per key, hour or day, merged into the days that new readings touch.

The reference averages all readings anew at every refresh. Here each arrival is reduced to states (sum, count, least
and greatest value) once, and the states are merged into a table of days (``sources.daystore``): an update reads the
arrival and the stored states of the days it touches, never the readings before it. Sums of sums, counts of counts,
minimums and maximums of such give what one pass over all readings gives, in any order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeris.functions.keys import short_id
from aeris.functions.timefmt import floor_hour
from aeris.operators.clean import clean_readings
from aeris.sources import daystore

STATION = "station_id"
STATION_HOUR = ["country", "pollutant", STATION, "hour"]
STATE = [("sum_value", "sum", "double"), ("n", "sum", "long"), ("min_value", "min", "double"), ("max_value", "max", "double")]

HOURLY_SCHEMA = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("pollutant", T.StringType()),
    T.StructField("station_id", T.StringType()), T.StructField("hour", T.TimestampNTZType()),
    *(T.StructField(c, T.DoubleType() if kind == "double" else T.LongType()) for c, _, kind in STATE),
    T.StructField(daystore.DAY, T.DateType())])
DAILY_SCHEMA = T.StructType([
    T.StructField("pollutant", T.StringType()), T.StructField("Date", T.DateType()),
    *(T.StructField(c, T.DoubleType() if kind == "double" else T.LongType()) for c, _, kind in STATE),
    T.StructField(daystore.DAY, T.DateType())])


def partials(rows: DataFrame, keys: list[str], day: Column, value: str = "Value") -> DataFrame:
    """One state per key: the first step of every average, with a partial step before the shuffle."""
    v = F.col(value)
    return rows.withColumn(daystore.DAY, day).groupBy(*keys, daystore.DAY).agg(
        F.sum(v).alias("sum_value"), F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value")) \
        .select(*keys, *(c for c, _, _ in STATE), daystore.DAY)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of both sides as one per key. States of stations are dealt by day and station, as ``merge_days`` writes
    them: one shuffle serves both."""
    keys = [c for c in old.columns if c not in {s for s, _, _ in STATE}]
    both = old.unionByName(new)
    if STATION in keys:
        both = both.repartition(F.col(daystore.DAY), F.col(STATION))
    return both.groupBy(*keys).agg(
        *[{"sum": F.sum, "min": F.min, "max": F.max}[how](c).alias(c) for c, how, _ in STATE]).select(*old.columns)


def _hours(clean: DataFrame) -> DataFrame:
    return clean.withColumn(STATION, short_id(F.col("Samplingpoint"))).withColumn("hour", floor_hour(F.col("Start")))


def station_hour_states(clean: DataFrame) -> DataFrame:
    """States of cleaned readings per station and hour."""
    return partials(_hours(clean), STATION_HOUR, F.to_date("hour"))


def reading_states(clean: DataFrame) -> DataFrame:
    """A state of its own for each cleaned reading, in the columns of ``station_hour_states``: ``merged`` adds them up."""
    v = F.col("Value")
    return _hours(clean).select(*STATION_HOUR, v.alias("sum_value"), F.lit(1).cast("long").alias("n"), v.alias("min_value"),
                                v.alias("max_value"), F.to_date("hour").alias(daystore.DAY))


def day_states(hist: DataFrame) -> DataFrame:
    """States of the historic table per pollutant and day (null values don't count), kept by year: a day has a row per
    pollutant."""
    rows = hist.where(F.col("Value").isNotNull()).withColumn("Date", F.to_date("Date"))
    return partials(rows, ["pollutant", "Date"], F.trunc("Date", "year"))


def add_readings(raw: DataFrame, root: str, version: int) -> list[str]:
    """Merge an arrival of raw readings into the station-hour table in ``root``; returns the days it touched."""
    return daystore.merge_days(station_hour_states(clean_readings(raw)), root, version, merged, STATION)


def add_days(hist: DataFrame, root: str, version: int) -> list[str]:
    """Merge an arrival of the historic table into the daily table in ``root``; returns the years it touched."""
    return daystore.merge_days(day_states(hist), root, version, merged)


def hourly(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame:
    """Means per station and hour from the stored states, of all days or of those given."""
    return daystore.read_days(spark, root, HOURLY_SCHEMA, days).select(
        *STATION_HOUR, (F.col("sum_value") / F.col("n")).alias("Value"), "n", "min_value", "max_value")


def daily(spark: SparkSession, root: str, years: list[str] | None = None) -> DataFrame:
    """Means per pollutant and day over all stations from the stored states, of all years or of those given (by their
    first days)."""
    return daystore.read_days(spark, root, DAILY_SCHEMA, years).select(
        "pollutant", "Date", (F.col("sum_value") / F.col("n")).alias("AvgValue"), "n")
