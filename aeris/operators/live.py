"""Live view: station table, named series, hourly means, hour frames.

The reference fetches one (country, pollutant) at a time; here every
operator carries ``country`` and ``pollutant`` as grouping columns and
computes all groups in one job.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeris.functions.eaqi import with_aqi_style
from aeris.functions.keys import normalize_key, short_id
from aeris.functions.text import fixed_decimals
from aeris.functions.timefmt import floor_hour, ntz_lit
from aeris.operators.clean import clean_readings, last_days, parse_readings

GROUP = ["country", "pollutant"]
UNKNOWN_AREA = "unknown"
# --- Fixed values: area symbols of the reference (default ●) ----------------
AREA_SYMBOLS = [("urban", "●"), ("suburban", "◆"), ("rural", "▲"),
                ("rural-nearcity", "▲"), ("rural_nearcity", "▲")]
DEFAULT_SYMBOL = "●"
# ---------------------------------------------------------------------------


def area_symbol(area: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in AREA_SYMBOLS for x in kv])
    return F.coalesce(F.element_at(m, F.lower(area)), F.lit(DEFAULT_SYMBOL))


def recent_readings(raw: DataFrame, as_of: Column | str | _dt.datetime | None = None) -> DataFrame:
    """Clean readings of the trailing 7-day window (as_of defaults to the latest time)."""
    return last_days(clean_readings(raw), as_of=as_of, reference=parse_readings(raw))


def point_column(readings: DataFrame) -> Column:
    """The Samplingpoint, or null where the files carry none."""
    return F.col("Samplingpoint") if "Samplingpoint" in readings.columns else F.lit(None).cast("string")


def with_station(pre: DataFrame, coords: DataFrame | None = None) -> DataFrame:
    """Station id of pre-aggregated rows (``GROUP, url, _sp, _t`` and measures): the file's first
    Samplingpoint (by first time ``_t``), else the url tail; with ``coords`` also place, name and area.

    The readings are reduced before they meet here, so each reading is scanned and shuffled once and the
    window per file sees its Samplingpoints x hours (or labels), never its readings.
    """
    first = F.min_by("_sp", F.struct(F.col("_t"), F.col("_sp").isNull(), F.col("_sp"))).over(
        Window.partitionBy(*GROUP, "url"))
    out = pre.withColumn("station_id", short_id(F.coalesce(first, F.col("url")))).drop("_sp", "_t")
    return out if coords is None else _located(out, coords)


def _located(rows: DataFrame, coords: DataFrame) -> DataFrame:
    """Place, name and area of each station. The coordinate dimension grows with the metadata; no broadcast
    hint: adaptive execution broadcasts it after measuring it, else it stays a shuffle join."""
    c = coords.select("key", "lat", "lon", F.col("station_name").alias("_name"), F.col("area_type").alias("_area"))
    return (rows.withColumn("key", normalize_key(F.col("station_id"))).join(c, "key", "left")
            .withColumns({"station_name": F.coalesce("_name", "station_id"),
                          "area_type": F.coalesce("_area", F.lit(UNKNOWN_AREA))})
            .drop("key", "_name", "_area"))


def station_hours(recent: DataFrame) -> DataFrame:
    """Sum and count per (file, Samplingpoint, hour) with the file's station id: the one table that the
    station table, the hourly means and the hour view derive from. A hash aggregate with a partial step."""
    return with_station(recent.groupBy(
        *GROUP, "url", point_column(recent).alias("_sp"), floor_hour(F.col("Start")).alias("hour")).agg(
        F.sum("Value").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min("Start").alias("_t")))


def hourly_means(hours: DataFrame) -> DataFrame:
    """Mean per station and hour from ``station_hours``."""
    return hours.groupBy(*GROUP, "station_id", "hour").agg(
        (F.sum("_sum") / F.sum("_n")).alias("Value"), F.sum("_n").alias("n"))


def live_view(recent: DataFrame, coords: DataFrame, hour: str | _dt.datetime | None = None) -> DataFrame:
    """The hour view in one pass over the readings: per file, the station's mean of one hour (default: the
    group's latest hour), else the file's mean over the window; styled for the map.

    Each station's own last hour is a window over its hours. It counts if it is the group's last hour, which
    comes from a narrow aggregate of the times alone (one row per group).
    """
    station = Window.partitionBy(*GROUP, "station_id")
    at = F.max("hour").over(station) if hour is None else ntz_lit(hour)
    hours = station_hours(recent).withColumn("_h", at)
    here = F.col("hour") == F.col("_h")
    files = (hours.groupBy(*GROUP, "url", "station_id", "_h")
             .agg((F.sum("_sum") / F.sum("_n")).alias("Value"),
                  F.sum(F.when(here, F.col("_sum"))).alias("_hs"), F.sum(F.when(here, F.col("_n"))).alias("_hn"))
             .withColumn("_v", F.sum("_hs").over(station) / F.sum("_hn").over(station)))
    if hour is None:
        last = recent.groupBy(*GROUP).agg(floor_hour(F.max("Start")).alias("_last"))
        files = (files.join(last, GROUP).withColumn("_v", F.when(F.col("_h") == F.col("_last"), F.col("_v")))
                 .drop("_last"))
    frame = (files.withColumn("is_fallback", F.col("_v").isNull())
             .withColumn("Value", F.coalesce("_v", "Value")).drop("_v", "_h", "_hs", "_hn"))
    return _styled(_located(frame, coords))


def station_files(recent: DataFrame) -> DataFrame:
    """One row per source file: its station id (first Samplingpoint, else the url
    tail) and its mean value over the window.

    Two steps so the heavy one is a hash aggregate: sums, counts and first time
    per (file, Samplingpoint) over all readings; then, over that tiny result, the
    file's mean and its earliest Samplingpoint (a string-valued ``min_by`` would
    force a sort-based aggregate over every reading).
    """
    per_sp = recent.groupBy(*GROUP, "url", point_column(recent).alias("_sp")).agg(
        F.sum("Value").alias("_sum"), F.count("Value").alias("_n"), F.min("Start").alias("_t"))
    per_file = per_sp.groupBy(*GROUP, "url").agg(
        F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"),
        F.min_by("_sp", F.struct(F.col("_t"), F.col("_sp").isNull(), F.col("_sp"))).alias("_sp"))
    return (per_file.withColumn("Value", F.col("_sum") / F.col("_n"))
            .withColumn("station_id", short_id(F.coalesce(F.col("_sp"), F.col("url")))).drop("_sp"))


def station_meta(recent: DataFrame, coords: DataFrame, per_file: bool = True) -> DataFrame:
    """Station table: id, url, window mean, coordinates, name and area with fallbacks.

    ``per_file`` (the reference's shape) gives one row per source file, so a
    station delivered in two files appears twice; ``per_file=False`` gives one
    row per station: the readings-weighted mean over its files and its first url.
    """
    files = station_files(recent)
    if not per_file:
        files = files.groupBy(*GROUP, "station_id").agg(
            (F.sum("_sum") / F.sum("_n")).alias("Value"), F.min("url").alias("url"))
    return _located(files, coords).select(
        *GROUP, "station_id", "url", "Value", "lat", "lon", "station_name", "area_type")


def station_meta_of(hours: DataFrame, coords: DataFrame) -> DataFrame:
    """The station table (one row per file) from ``station_hours``."""
    files = hours.groupBy(*GROUP, "url", "station_id").agg((F.sum("_sum") / F.sum("_n")).alias("Value"))
    return _located(files, coords).select(
        *GROUP, "station_id", "url", "Value", "lat", "lon", "station_name", "area_type")


def readings_named(recent: DataFrame, meta: DataFrame) -> DataFrame:
    """Window readings with the station id and name of their file."""
    names = meta.select(*GROUP, "url", "station_id", "station_name")
    return recent.join(names, [*GROUP, "url"], "left").select(
        *GROUP, "station_id", "station_name", "Start", "Value")


def observed_hours(named: DataFrame) -> DataFrame:
    """Distinct hours per group. At most 7 × 24 + 1 per group: the window bounds it."""
    return named.select(*GROUP, floor_hour(F.col("Start")).alias("hour")).distinct()


def _styled(frame: DataFrame) -> DataFrame:
    return (with_aqi_style(frame.dropna(subset=["lat", "lon"]))
            .withColumn("symbol", area_symbol(F.col("area_type")))
            .withColumn("value_str", fixed_decimals(F.col("Value"), 2)))


def hour_bounds(named: DataFrame) -> DataFrame:
    return named.groupBy(*GROUP).agg(floor_hour(F.min("Start")).alias("first_hour"),
                                     floor_hour(F.max("Start")).alias("last_hour"))


def hour_spine(named: DataFrame) -> DataFrame:
    """Every hour from each group's first to last reading."""
    return hour_bounds(named).select(*GROUP, F.explode(F.sequence(
        "first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))).alias("hour"))


def hour_frames_all(meta: DataFrame, hourly: DataFrame) -> DataFrame:
    """The hour view for every observed hour of each group, in one job.

    The observed hours and each group's first/last hour come from the hourly
    means themselves (the hours that have means are the observed hours), so
    the readings are aggregated once. Grid per station by
    ``explode(sequence(first, last hour))`` (≤ 169 hours in a 7-day window, no
    cross join), kept where the hour was observed (semi join on groups × ≤ 169
    hours), then left-joined to the hourly means on
    a key unique on both sides.
    """
    hours = hourly.select(*GROUP, "hour").distinct()
    bounds = hourly.groupBy(*GROUP).agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    grid = (meta.join(bounds, GROUP, "inner")
            .withColumn("hour", F.explode(F.sequence("first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))))
            .drop("first_hour", "last_hour"))
    grid = grid.join(hours, [*GROUP, "hour"], "left_semi")
    h = hourly.select(*GROUP, "station_id", "hour", F.col("Value").alias("_v"))
    frame = (grid.join(h, [*GROUP, "station_id", "hour"], "left")
             .withColumn("is_fallback", F.col("_v").isNull())
             .withColumn("Value", F.coalesce("_v", "Value")).drop("_v"))
    return _styled(frame)


def frame_index(named: DataFrame) -> DataFrame:
    """Animation frames: position, count and next hour over each group's hours.

    The window runs per group over distinct hours (≤ 169 rows per group).
    """
    w = Window.partitionBy(*GROUP).orderBy("hour")
    return (observed_hours(named)
            .withColumn("frame", F.row_number().over(w))
            .withColumn("n_frames", F.count(F.lit(1)).over(Window.partitionBy(*GROUP)))
            .withColumn("next_hour", F.lead("hour").over(w)))
