"""Frames as intervals: one row per station, value and stretch of time.

The animations of the reference show every station in every frame; as a table that is stations times frames. Here a
station has a row per stretch of frames in which its value stands (gaps and islands), so there are never more rows
than readings, and a frame is looked up by its time: the stations whose interval holds it, every other known station
as missing, styled like a frame of its own.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeris.functions.timefmt import ntz_lit
from aeris.operators.historic import dedup_latlon, master_stations, style_frames
from aeris.operators.live import GROUP, _styled

PLACE = ["pollutant", "lat", "lon"]


def islands(frames: DataFrame, station: list[str], at: str, number: Column, value: str = "Value") -> DataFrame:
    """``station, value, from, to`` of every stretch of successive frames with the same value. ``number`` counts frames
    (days, hours), one row per station and frame. A station's rows meet in one task, as many as it has frames."""
    w = Window.partitionBy(*station).orderBy(at)
    rows = frames.withColumn("_n", number)
    new = F.lag("_n").over(w).isNull() | (F.col("_n") != F.lag("_n").over(w) + 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    marked = rows.withColumn("_new", new.cast("int")) \
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*station, "_island").agg(F.first(value).alias(value), F.min(at).alias("from"), F.max(at).alias("to")) \
        .drop("_island")


def day_intervals(hist: DataFrame) -> DataFrame:
    """``pollutant, lat, lon, Value, from, to``: the station-day values of the historic table as stretches of days."""
    return islands(dedup_latlon(hist), PLACE, "Date", F.date_diff("Date", F.lit("1970-01-01").cast("date")))


def hour_intervals(hourly: DataFrame) -> DataFrame:
    """``country, pollutant, station_id, Value, from, to``: hourly means as stretches of hours."""
    number = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("hour"))
    return islands(hourly.select(*GROUP, "station_id", "hour", "Value"), [*GROUP, "station_id"], "hour", number)


def _holding(intervals: DataFrame, at: Column) -> DataFrame:
    return intervals.where((F.col("from") <= at) & (F.col("to") >= at)).drop("from", "to")


def day_frame(intervals: DataFrame, stations: DataFrame, day: str) -> DataFrame:
    """One day's map from ``day_intervals``: every station of ``stations(pollutant, lat, lon)``, its value or missing."""
    now = _holding(intervals, F.lit(day).cast("date"))
    frame = stations.join(now, PLACE, "left").withColumn("Date", F.lit(day).cast("date"))
    return style_frames(frame, ["pollutant", "Date"])


def day_stations(intervals: DataFrame) -> DataFrame:
    """Every station that has an interval (the same as ``master_stations`` of the table they come from)."""
    return intervals.select(*PLACE).distinct()


def hour_frame(meta: DataFrame, intervals: DataFrame, hour: str | _dt.datetime) -> DataFrame:
    """The hour view from ``hour_intervals``: the station's mean of that hour, else its window mean; styled."""
    now = _holding(intervals, ntz_lit(hour)).withColumnRenamed("Value", "_v")
    frame = (meta.join(now, [*GROUP, "station_id"], "left").withColumn("is_fallback", F.col("_v").isNull())
             .withColumn("Value", F.coalesce("_v", "Value")).drop("_v"))
    return _styled(frame)


__all__ = ["day_frame", "day_intervals", "day_stations", "hour_frame", "hour_intervals", "islands", "master_stations"]
