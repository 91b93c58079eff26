"""Station comparison: labelled series, tier shares, summaries, chart bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeris.functions.eaqi import (UNKNOWN_LABEL, aqi_label, effective_pollutant,
                                  label_colour, label_order)
from aeris.functions.text import NO_LABEL_TEXT, fixed_decimals
from aeris.functions.timefmt import FMT_CARD
from aeris.operators.live import point_column, with_station

GROUP = ["country", "pollutant"]
STATION = [*GROUP, "station_name"]
# --- Fixed values: chart head-room of the reference --------------------------
Y_HEADROOM = 1.15
# ---------------------------------------------------------------------------


def compare_series(named: DataFrame) -> DataFrame:
    """Readings with their tier label ("Unknown" when none)."""
    return named.withColumn("aqi_label", F.coalesce(aqi_label(F.col("Value"), F.col("pollutant")),
                                                    F.lit(UNKNOWN_LABEL)))


def station_labels(recent: DataFrame, coords: DataFrame) -> DataFrame:
    """Per (file, label): rows and extremes with the file's station, from one pass over the readings.

    ``station_summary`` takes it in place of the labelled readings; ``tier_breakdown`` needs ``label_counts`` only."""
    keys = [*GROUP, "url", "_sp"]
    pre = _extremes(compare_series(recent.withColumn("_sp", point_column(recent))), keys)
    return with_station(pre, coords)


def label_counts(recent: DataFrame, coords: DataFrame) -> DataFrame:
    """Per (file, label): rows (``hours``) with the file's station. The readings are counted before any shuffle."""
    pre = compare_series(recent.withColumn("_sp", point_column(recent))).groupBy(*GROUP, "url", "_sp", "aqi_label").agg(
        F.count(F.lit(1)).alias("hours"), F.min("Start").alias("_t"))
    return with_station(pre, coords)


def station_sizes(recent: DataFrame, coords: DataFrame) -> DataFrame:
    """Files with their station and number of readings (``hours``)."""
    pre = recent.groupBy(*GROUP, "url", point_column(recent).alias("_sp")).agg(
        F.count(F.lit(1)).alias("hours"), F.min("Start").alias("_t"))
    return with_station(pre, coords).groupBy(*GROUP, "url", "station_id", "station_name").agg(
        F.sum("hours").alias("hours"))


def top_stations(named: DataFrame, k: int = 2) -> DataFrame:
    """A selection table: the ``k`` station names with most readings per group (of readings, or of
    rows that carry their number in ``hours``)."""
    n = F.sum("hours") if "hours" in named.columns else F.count(F.lit(1))
    counts = named.where(F.col("station_name").isNotNull()).groupBy(*STATION).agg(n.alias("n"))
    w = Window.partitionBy(*GROUP).orderBy(F.desc("n"), "station_name")
    return counts.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).select(*STATION)


def compare_semi(named: DataFrame, selection: DataFrame) -> DataFrame:
    """Readings of the selected stations (semi join: the selection is a table, of any size;
    adaptive execution broadcasts it where it measures it small)."""
    return compare_series(named.join(selection, STATION, "left_semi"))


def tier_breakdown(series: DataFrame) -> DataFrame:
    """Rows per (station, label) named ``hours`` (it counts rows), with share and order.

    ``series`` holds labelled readings, or ``label_counts``. The share window runs over a station's at
    most 7 label rows.
    """
    n = F.sum("hours") if "hours" in series.columns else F.count(F.lit(1))
    counts = series.groupBy(*STATION, "aqi_label").agg(n.alias("hours"))
    total = F.sum("hours").over(Window.partitionBy(*STATION))
    return (counts.withColumn("share", F.col("hours") / total)
            .withColumn("order_idx", label_order(F.col("aqi_label"))))


def _extremes(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, label): ``hours`` (rows), first time ``_t``, highest and lowest value with their earliest time.

    Hash aggregates only. Rows are first reduced to one per distinct value with its earliest time; a value is
    then unique within its key, so ``max_by`` of a time by a value has no ties and needs no struct ordering.
    """
    per_value = series.groupBy(*keys, "aqi_label", "Value").agg(
        F.count(F.lit(1)).alias("_n"), F.min("Start").alias("_first"))
    return per_value.groupBy(*keys, "aqi_label").agg(
        F.sum("_n").alias("hours"), F.min("_first").alias("_t"),
        F.max("Value").alias("_hi"), F.max_by("_first", "Value").alias("_hi_at"),
        F.min("Value").alias("_lo"), F.min_by("_first", "Value").alias("_lo_at"))


def station_summary(series: DataFrame) -> DataFrame:
    """Per station: dominant label and colour, worst and best reading with labels and text.

    Dominant = most rows, ties → lower tier. Worst/best = highest/lowest value, ties → earliest time.
    ``series`` holds labelled readings, or ``station_labels``. Every reading passes hash aggregates only
    (``_extremes``); the arg-min aggregates below see a few rows per file or station and label.
    """
    ext = series if "hours" in series.columns else _extremes(series, STATION)
    hi = F.struct(F.col("_hi_at").alias("Start"), F.col("_hi").alias("Value"))
    lo = F.struct(F.col("_lo_at").alias("Start"), F.col("_lo").alias("Value"))
    per_label = ext.groupBy(*STATION, "aqi_label").agg(
        F.sum("hours").alias("hours"),
        F.min_by(hi, F.struct(-F.col("_hi"), F.col("_hi_at"))).alias("w"),
        F.min_by(lo, F.struct(F.col("_lo"), F.col("_lo_at"))).alias("b"))
    out = per_label.groupBy(*STATION).agg(
        F.min_by("aqi_label", F.struct(-F.col("hours"), label_order(F.col("aqi_label")))).alias("dominant"),
        F.min_by("w", F.struct(-F.col("w.Value"), F.col("w.Start"))).alias("w"),
        F.min_by("b", F.struct(F.col("b.Value"), F.col("b.Start"))).alias("b"),
        F.sum("hours").alias("n_readings"))
    pol = F.col("pollutant")
    # labels first (one tier chain each), then colours and text from those columns
    labels = {f"{tag}_label": F.coalesce(aqi_label(F.col(f"{s}.Value"), pol), F.lit(NO_LABEL_TEXT))
              for tag, s in (("worst", "w"), ("best", "b"))}
    cols = {"colour": label_colour(F.col("dominant"))}
    for tag, s in (("worst", "w"), ("best", "b")):
        cols[f"{tag}_start"] = F.col(f"{s}.Start")
        cols[f"{tag}_value"] = F.col(f"{s}.Value")
        cols[f"{tag}_colour"] = label_colour(F.col(f"{tag}_label"))
        cols[f"{tag}_time_text"] = F.date_format(F.col(f"{s}.Start"), FMT_CARD)
        cols[f"{tag}_value_text"] = fixed_decimals(F.col(f"{s}.Value"), 1)
    return out.withColumns(labels).withColumns(cols).drop("w", "b")


def chart_bands(named: DataFrame, dim: DataFrame) -> DataFrame:
    """Index bands behind the comparison chart, clipped to the y-axis limit.

    y_max = max(max value × 1.15, second upper bound + 1) per group; a band
    is kept when its lower bound is below y_max and its top is min(upper, y_max).
    The dimension has 24 rows by definition (broadcast).
    """
    second = dim.where(F.col("tier") == 2).select(F.col("pollutant").alias("_ep"), F.col("upper").alias("_u2"))
    ymax = (named.groupBy(*GROUP).agg(F.max("Value").alias("_mx"))
            .withColumn("_ep", effective_pollutant(F.col("pollutant")))
            .join(F.broadcast(second), "_ep")
            .withColumn("y_max", F.greatest(F.col("_mx") * F.lit(Y_HEADROOM), F.col("_u2") + F.lit(1.0)))
            .select(*GROUP, "_ep", "y_max"))
    bands = F.broadcast(dim.select(F.col("pollutant").alias("_ep"), "tier", "lower", "upper", "label", "colour"))
    return (ymax.join(bands, "_ep")
            .where(F.col("lower") < F.col("y_max"))
            .select(*GROUP, "tier", F.col("lower").alias("y1"),
                    F.least(F.col("upper"), F.col("y_max")).alias("y2"), "label", "colour", "y_max"))
