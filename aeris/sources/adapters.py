"""Adapters: the reference's three inputs, derived from the driver tables.

The derivations (documented in FIXTURES.md §3, and repeated as CTEs in the
oracle SQL) give the shapes the reference reads — raw station readings, the
historic per-pollutant table, and raw station metadata — including the dirty
parts (sentinels, nulls, NaN, padded ids, duplicates).

Scale notes: each adapter is a projection of one fact table joined to
dimensions. ``nation`` has 25 rows by the TPC-H definition, so it is
broadcast explicitly; ``customer`` grows with the data, so its join with
``events`` is left to AQE, which broadcasts it only after measuring it and
otherwise runs a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.sources.tables import HISTORIC, column_bounds, session_view, table

# --- Fixed values: adapter rules (FIXTURES.md §3) ---------------------------
EVENT_POLLUTANT = [("error", "PM10"), ("signup", "PM2.5"), ("click", "NO2"),
                   ("view", "O3"), ("purchase", "SO2")]
SEGMENT_AREA = [("BUILDING", "urban"), ("HOUSEHOLD", "suburban"), ("FURNITURE", "rural"),
                ("MACHINERY", "rural-nearcity")]
METADATA_COPIES = ["PM10", "PM2.5", "NO2"]
SENTINEL = -999.0
SOURCE_PREFIX = "http://aq/"
ACTIVITY_BEGIN = "2010-01-01"
ACTIVITY_END = "2030-12-31"
# ---------------------------------------------------------------------------


def _case(c: Column, pairs: list[tuple[str, str]], default: Column | None = None) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def station_name(key: Column) -> Column:
    """``SPO-`` and the key zero-padded to at least five digits (never truncated)."""
    return F.format_string("SPO-%05d", key)


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station readings (country, pollutant, url, Samplingpoint, Start, Value); a per-session view."""
    return session_view(spark, sf_dir, "raw_readings", lambda: _raw_readings(spark, sf_dir))


def _raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station readings: country, pollutant, url, Samplingpoint, Start, Value.

    One "file" (url) per (country, pollutant, station) series, as the
    download service would deliver them.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    eid = F.col("event_id")
    value = (F.when(eid % 50 == 7, F.lit(SENTINEL))
             .when(eid % 53 == 7, F.lit(None).cast("double"))
             .when(eid % 59 == 7, F.lit(float("nan")))
             .when(eid % 61 == 7, F.lit(0.0))
             .otherwise(F.col("value")))
    pollutant = _case(F.col("event_type"), EVENT_POLLUTANT, F.col("event_type"))
    station = station_name(F.col("user_id"))
    return (ev.join(cu, ev.user_id == cu.c_custkey)
            .join(F.broadcast(na), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("n_name").alias("country"),
                pollutant.alias("pollutant"),
                F.concat(F.lit(SOURCE_PREFIX), F.col("n_name"), F.lit("/"), pollutant, F.lit("/"),
                         station, F.lit(".parquet")).alias("url"),
                F.concat(F.lit(SOURCE_PREFIX), F.col("n_name"), F.lit("/"), station).alias("Samplingpoint"),
                F.col("ts").alias("Start"),
                value.alias("Value")))


def readings_clock(spark: SparkSession, sf_dir: str):
    """"Now" of the live view: the latest time in the readings feed.

    Taken from the bounds kept per file (only files that are new are scanned, one column of them) and used as a
    literal, so the 7-day predicate is pushed into the Parquet scan and skips
    row groups; a scalar subquery would not be pushed down and every run would
    read the whole history.
    """
    return column_bounds(spark, sf_dir, "events", "ts")[1]


def _coord(key: Column, mult: int, modulus: int, base: float) -> Column:
    return F.lit(base) + (key * mult % modulus).cast("double") / F.lit(100.0)


def historic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historic table (pollutant, Date, Value, Latitude, Longitude); a per-session view."""
    return session_view(spark, sf_dir, "historic", lambda: _historic(spark, sf_dir), HISTORIC)


def _historic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historic table: pollutant, Date, Value, Latitude, Longitude (from lineitem)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    no_coord = F.col("l_suppkey") % 17 == 4
    return li.select(
        F.when(F.col("l_returnflag") == "R", F.lit("PM2.5")).otherwise(F.lit("PM10")).alias("pollutant"),
        F.col("l_shipdate").alias("Date"),
        F.when(F.col("l_orderkey") % 97 == 5, F.lit(None).cast("double"))
         .otherwise((F.col("l_quantity") - F.lit(3)) * F.lit(6)).alias("Value"),
        F.when(no_coord, F.lit(None).cast("double"))
         .otherwise(_coord(F.col("l_suppkey"), 37, 2400, 36.0)).alias("Latitude"),
        F.when(no_coord, F.lit(None).cast("double"))
         .otherwise(_coord(F.col("l_suppkey"), 53, 3300, -9.0)).alias("Longitude"))


def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw station metadata, one row per (station, pollutant); a per-session view."""
    return session_view(spark, sf_dir, "raw_metadata", lambda: _raw_metadata(spark, sf_dir))


def _raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw station metadata, one row per (station, pollutant) like a metadata export.

    ``source_row`` is the row number in the export (the order "keep first"
    refers to).
    """
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    base = station_name(k)
    no_coord = k % 17 == 0
    return (cu.where(k % 13 != 5)
            .join(F.broadcast(na), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("*", F.posexplode(F.array(*[F.lit(p) for p in METADATA_COPIES])).alias("copy", "pollutant"))
            .select(
                F.col("n_name").alias("Country"),
                F.when(k % 19 == 3, F.lit(None).cast("string")).otherwise(F.col("c_name"))
                 .alias("Air Quality Station Name"),
                F.when(k % 5 == 0, F.concat(F.lit("  "), F.lower(base), F.lit(" "))).otherwise(base)
                 .alias("Sampling Point Id"),
                F.when(no_coord, F.lit(None).cast("double")).otherwise(_coord(k, 41, 2400, 36.0)).alias("Latitude"),
                F.when(no_coord, F.lit(None).cast("double")).otherwise(_coord(k, 59, 3300, -9.0)).alias("Longitude"),
                _case(F.col("c_mktsegment"), SEGMENT_AREA).alias("Air Quality Station Area"),
                F.lit(ACTIVITY_BEGIN).cast("date").alias("Operational Activity Begin"),
                F.when((k + F.col("copy")) % 2 == 0, F.lit(None).cast("date"))
                 .otherwise(F.lit(ACTIVITY_END).cast("date")).alias("Operational Activity End"),
                F.col("pollutant").alias("Air Pollutant"),
                (k * 3 + F.col("copy")).alias("source_row")))
