"""Historic view: daily means, master stations, per-day map frames.

Every operator works on all pollutants at once (``pollutant`` is a grouping
column); ``route_pollutant`` narrows to one, which prunes partitions when the
table is partitioned by pollutant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeris.functions.colour import clip_value, ramp_columns
from aeris.functions.deciles import decile_edges, decile_of
from aeris.operators.clean import between_days, on_day, with_coords

# --- Fixed values: map sizing and default date of the reference -------------
SIZE_BASE = 3000
SIZE_STEP = 2000
DEFAULT_DAY = "2013-01-01"
# ---------------------------------------------------------------------------

KEYS = ["pollutant"]


def route_pollutant(hist: DataFrame, pollutant: str) -> DataFrame:
    return hist.where(F.col("pollutant") == pollutant)


def daily_average(hist: DataFrame, start: str | None = None, end: str | None = None,
                  drop_negative: bool = False) -> DataFrame:
    """Mean of non-null values per pollutant and calendar day in [start, end] (default: every day).

    Like the reference, negative values count unless ``drop_negative``.
    """
    keep = F.col("Value").isNotNull()
    if drop_negative:
        keep &= F.col("Value") >= 0
    return (between_days(hist.where(keep), start, end)
            .groupBy("pollutant", F.to_date("Date").alias("Date"))
            .agg(F.avg("Value").alias("AvgValue")))


def master_stations(hist: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct (lat, lon) per pollutant seen in [start, end] (default: ever)."""
    return (with_coords(between_days(hist, start, end))
            .select("pollutant", F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
            .distinct())


def dedup_latlon(hist: DataFrame) -> DataFrame:
    """One value per (pollutant, day, lat, lon): the first by (Date, Value, nulls last).

    Two hash aggregates, both with a map-side partial step (a hot station-day
    never gathers its rows in one task): the smallest non-null value per exact
    time, then the value of the earliest time. Ordering on a plain timestamp
    keeps the second step a HashAggregate (a struct ordering would force a
    sort-based aggregate).
    """
    keys = ["pollutant", F.to_date("Date").alias("Date"), F.col("Latitude").alias("lat"),
            F.col("Longitude").alias("lon")]
    per_time = (with_coords(hist)
                .groupBy(*keys, F.col("Date").alias("_t"))
                .agg(F.min("Value").alias("Value")))
    return (per_time.groupBy("pollutant", "Date", "lat", "lon")
            .agg(F.min_by("Value", "_t").alias("Value")))


def style_frames(frames: DataFrame, keys: list[str], edge_values: DataFrame | None = None) -> DataFrame:
    """Map styling per frame (``keys`` identify a frame, e.g. pollutant + Date).

    Value: null → 0, clipped to [0, 240]; 0 counts as missing. Size: 0 when
    missing, else 3000 + 2000 × decile of the frame's non-missing values.
    ``edge_values`` may supply those values directly (same rows as the frame's
    non-missing ones) so edges need not be derived from the dense frame.

    The edge table has one row per frame; adaptive execution broadcasts it where it measures it small.
    """
    clipped = frames.withColumn("Value", clip_value(F.col("Value")))
    missing = F.col("Value") == 0
    src = clipped if edge_values is None else edge_values.withColumn("Value", clip_value(F.col("Value")))
    edges = decile_edges(src.where(F.col("Value") != 0), keys, "Value")
    out = clipped.join(edges, keys, "left")
    decile = decile_of(F.col("Value"), F.col("edges"))
    return (out.withColumns({"decile": F.when(~missing, decile)})
               .withColumn("size", F.when(missing, F.lit(0))
                           .otherwise(F.lit(SIZE_BASE) + F.col("decile") * F.lit(SIZE_STEP)))
               .withColumns(ramp_columns(F.col("Value"), missing))
               .drop("edges"))


def day_values_styled(hist: DataFrame, materialize: bool = True) -> DataFrame:
    """Every station-day value of the table, styled per day (no densifying).

    The de-duplicated day table feeds both the rows and the decile edges; it is
    written once to the shared checkpoint folder so the table is scanned once.
    """
    days = dedup_latlon(hist)
    if materialize:
        from aeris.session import materialize as write_once
        days = write_once(days, "day-values")
    return style_frames(days, ["pollutant", "Date"])


def map_frame(hist: DataFrame, day: str, start: str | None = None, end: str | None = None,
              densify: bool = True) -> DataFrame:
    """One day's map: every master station of [start, end] (default: all), the day's first value or missing.

    ``densify=False`` is the reference's path without a station list: the day's
    rows as they are (not de-duplicated, no missing stations added).
    """
    if not densify:
        rows = with_coords(on_day(hist, day)).select(
            "pollutant", F.to_date("Date").alias("Date"), F.col("Latitude").alias("lat"),
            F.col("Longitude").alias("lon"), "Value")
        return style_frames(rows, ["pollutant", "Date"])
    master = master_stations(hist, start, end)
    day_rows = dedup_latlon(on_day(hist, day)).drop("Date")
    frame = master.join(day_rows, ["pollutant", "lat", "lon"], "left") \
                  .withColumn("Date", F.lit(day).cast("date"))
    return style_frames(frame, ["pollutant", "Date"])


def map_frames_all(hist: DataFrame, start: str | None = None, end: str | None = None,
                   materialize: bool = True) -> DataFrame:
    """All days of [start, end] × master stations in one job (the reference loops per day).

    Without bounds, each pollutant's days run from its first to its last day with a located value.

    Everything derives from one de-duplicated day table (one row per pollutant,
    day and station — far smaller than the raw table): the master stations are
    its distinct coordinates (the same set as a distinct over the raw range),
    the dense grid is generated per station with ``explode(sequence(...))`` —
    no cross join — and left-joined back on a key unique on both sides, and
    the decile edges come from it too. The day table is written once to the
    shared checkpoint folder (``materialize``), so the historic table is
    scanned once instead of three times and the lineage is cut there.
    """
    days = dedup_latlon(between_days(hist, start, end))
    if materialize:
        from aeris.session import materialize as write_once
        days = write_once(days, "day-values")
        master = days.select("pollutant", "lat", "lon").distinct()
    else:
        master = master_stations(hist, start, end)
    first = F.lit(start).cast("date") if start is not None else F.col("min_date")
    last = F.lit(end).cast("date") if end is not None else F.col("max_date")
    if start is None or end is None:
        master = master.join(time_bounds(days), "pollutant")      # one row per pollutant
    grid = master.select("pollutant", "lat", "lon",
                         F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))).alias("Date"))
    # Style the day values (each lands on exactly one grid cell, and they are all
    # of a frame's non-missing values), then fill the cells without one with the
    # missing style: deciles and colours are computed per value, not per cell.
    styled = style_frames(days, ["pollutant", "Date"]).withColumn("_day", F.lit(True))
    frame = grid.join(styled, ["pollutant", "Date", "lat", "lon"], "left")
    missing = {"Value": F.lit(0.0), "size": F.lit(0), "color_r": F.lit(0), "color_g": F.lit(0),
               "color_b": F.lit(0), "color_a": F.lit(0)}
    no_day = F.col("_day").isNull()
    return frame.withColumns({c: F.when(no_day, v).otherwise(F.col(c)) for c, v in missing.items()}).drop("_day")


def time_bounds(hist: DataFrame) -> DataFrame:
    """First and last day per pollutant."""
    return hist.groupBy("pollutant").agg(F.to_date(F.min("Date")).alias("min_date"),
                                         F.to_date(F.max("Date")).alias("max_date"))


def day_spine(hist: DataFrame) -> DataFrame:
    """Every day between each pollutant's first and last day."""
    return time_bounds(hist).select("pollutant", F.explode(F.sequence(
        "min_date", "max_date", F.expr("INTERVAL 1 DAY"))).alias("Date"))


def default_date(bounds: DataFrame) -> DataFrame:
    """Initial date of the scrubber: 2013-01-01 when inside [start, end], else start."""
    d = F.lit(DEFAULT_DAY).cast("date")
    s, e = F.col("start_date"), F.col("end_date")
    return (bounds.select("pollutant", F.col("min_date").alias("start_date"), F.col("max_date").alias("end_date"))
            .withColumn("valid", s <= e)
            .withColumn("default_date", F.when(~F.col("valid"), F.lit(None).cast("date"))
                        .when((d >= s) & (d <= e), d).otherwise(s)))


def daily_point(daily: DataFrame, day: str) -> DataFrame:
    return daily.where(F.col("Date") == F.lit(day).cast("date"))
