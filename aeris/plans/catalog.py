"""The query catalogue: every operator of the inventory as a (Spark, oracle SQL) pair.

Each Spark query takes ``(spark, sf_dir)`` and reads the driver's tables
through the adapters; each oracle is DuckDB SQL over the same tables. Column
names match on both sides; averages and shares are rounded to 6 digits on
both sides so the comparison does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.functions import eaqi
from aeris.functions.keys import normalize_key, short_id
from aeris.functions.text import fixed_decimals
from aeris.functions.timefmt import FMT_AXIS, FMT_CARD, FMT_HEADER, FMT_SLIDER
from aeris.operators import clean as C
from aeris.operators import compare as CMP
from aeris.operators import historic as H
from aeris.operators import live as L
from aeris.operators import metadata as M
from aeris.operators import publish as P
from aeris.plans import sqlparts as S
from aeris.sources import adapters as A
from aeris.sources.tables import HISTORIC

# --- Parameters of the registered queries -----------------------------------
RANGE_START, RANGE_END = "1997-01-01", "1997-12-31"    # a one-year window
DAY = "1997-06-15"                                     # the scrubber's day
PEAK_K = 5
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(c, 6)


# ----- shared Spark building blocks -------------------------------------------------

def _coords(spark, sf):
    from aeris.sources.tables import session_view
    return session_view(spark, sf, "station_coords",
                        lambda: M.station_coords(M.metadata_dedup(A.raw_metadata(spark, sf))))


def _recent(spark, sf):
    from aeris.sources.tables import session_view
    return session_view(spark, sf, "recent", lambda: L.recent_readings(
        A.raw_readings(spark, sf), as_of=A.readings_clock(spark, sf)))


def _station_meta(spark, sf):
    from aeris.sources.tables import session_view
    return session_view(spark, sf, "station_meta", lambda: L.station_meta(_recent(spark, sf), _coords(spark, sf)))


def _named(spark, sf):
    """Every reading with its station: the names come from an aggregate of the same readings, so this one
    view scans them twice. Queries that count or average readings derive from pre-aggregated rows instead."""
    from aeris.sources.tables import session_view
    return session_view(spark, sf, "named", lambda: L.readings_named(_recent(spark, sf), _station_meta(spark, sf)))


def _hist(spark, sf):
    return A.historic(spark, sf)


# ===================================== historic ======================================

@register("scan_historic", S.with_ctes([S.HISTORIC], "SELECT * FROM historic"))
def q_scan_historic(spark, sf):
    return _hist(spark, sf)


@register("route_pollutant", S.with_ctes([S.HISTORIC], "SELECT * FROM historic WHERE pollutant = 'PM2.5'"))
def q_route_pollutant(spark, sf):
    return H.route_pollutant(_hist(spark, sf), "PM2.5")


@register("route_partitioned", S.with_ctes([S.HISTORIC], f"""SELECT pollutant, CAST("Date" AS DATE) AS "Date",
  round(avg("Value"), 6) AS AvgValue FROM historic
  WHERE pollutant = 'PM2.5' AND "Value" IS NOT NULL
    AND CAST("Date" AS DATE) BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'
  GROUP BY pollutant, CAST("Date" AS DATE)"""))
def q_route_partitioned(spark, sf):
    """Routing on the stored table: the pollutant prunes partitions, the range is pushed."""
    from aeris.session import scratch_path
    from aeris.sources import files as FS
    from aeris.sources.tables import session_folder
    root = session_folder(spark, sf, "historic", lambda: FS.write_historic(
        _hist(spark, sf), scratch_path(spark, "historic")), HISTORIC)
    routed = H.route_pollutant(FS.scan_historic(spark, root), "PM2.5")
    d = H.daily_average(routed, RANGE_START, RANGE_END)
    return d.select("pollutant", "Date", r6("AvgValue").alias("AvgValue"))


@register("filter_date_range", S.with_ctes([S.HISTORIC], f"""SELECT * FROM historic
  WHERE CAST("Date" AS DATE) BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'"""))
def q_filter_date_range(spark, sf):
    return C.between_days(_hist(spark, sf), RANGE_START, RANGE_END)


@register("filter_date", S.with_ctes([S.HISTORIC], f"""SELECT * FROM historic
  WHERE CAST("Date" AS DATE) = DATE '{DAY}'"""))
def q_filter_date(spark, sf):
    return C.on_day(_hist(spark, sf), DAY)


@register("filter_coords", S.with_ctes([S.HISTORIC], """SELECT * FROM historic
  WHERE "Latitude" IS NOT NULL AND NOT isnan("Latitude") AND "Longitude" IS NOT NULL AND NOT isnan("Longitude")"""))
def q_filter_coords(spark, sf):
    return C.with_coords(_hist(spark, sf))


_DAILY_SQL = f"""daily AS (
  SELECT pollutant, CAST("Date" AS DATE) AS "Date", avg("Value") AS AvgValue FROM historic
  WHERE "Value" IS NOT NULL
  GROUP BY pollutant, CAST("Date" AS DATE))"""


@register("daily_average", S.with_ctes([S.HISTORIC, _DAILY_SQL],
          'SELECT pollutant, "Date", round(AvgValue, 6) AS AvgValue FROM daily ORDER BY pollutant, "Date"'))
def q_daily_average(spark, sf):
    d = H.daily_average(_hist(spark, sf))
    return d.select("pollutant", "Date", r6("AvgValue").alias("AvgValue")).orderBy("pollutant", "Date")


@register("daily_point", S.with_ctes([S.HISTORIC, _DAILY_SQL],
          f"""SELECT pollutant, "Date", round(AvgValue, 6) AS AvgValue FROM daily WHERE "Date" = DATE '{DAY}'"""))
def q_daily_point(spark, sf):
    d = H.daily_point(H.daily_average(_hist(spark, sf)), DAY)
    return d.select("pollutant", "Date", r6("AvgValue").alias("AvgValue"))


@register("daily_average_nonneg", S.with_ctes([S.HISTORIC], f"""SELECT pollutant, CAST("Date" AS DATE) AS "Date",
  round(avg("Value"), 6) AS AvgValue FROM historic
  WHERE "Value" IS NOT NULL AND "Value" >= 0
  GROUP BY pollutant, CAST("Date" AS DATE)"""))
def q_daily_average_nonneg(spark, sf):
    d = H.daily_average(_hist(spark, sf), drop_negative=True)
    return d.select("pollutant", "Date", r6("AvgValue").alias("AvgValue"))


@register("peak_days", S.with_ctes([S.HISTORIC, _DAILY_SQL], f"""SELECT pollutant, "Date", round(AvgValue, 6) AS AvgValue, rank
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pollutant ORDER BY AvgValue DESC, "Date") AS INTEGER) AS rank FROM daily)
  WHERE rank <= {PEAK_K}"""))
def q_peak_days(spark, sf):
    d = P.peak_days(H.daily_average(_hist(spark, sf)), PEAK_K)
    return d.select("pollutant", "Date", r6("AvgValue").alias("AvgValue"), "rank")


@register("peak_prompts", S.with_ctes([S.HISTORIC, _DAILY_SQL], f"""SELECT pollutant, "Date", rank,
  'Explain briefly in only 1-2 sentences what event could cause there to be an air quality (' || pollutant
  || ') peak on ' || strftime("Date", '%Y-%m-%d') || ' in Europe. Keep your response short and concise.' AS prompt
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pollutant ORDER BY AvgValue DESC, "Date") AS INTEGER) AS rank FROM daily)
  WHERE rank <= {PEAK_K}"""))
def q_peak_prompts(spark, sf):
    return P.peak_prompts(P.peak_days(H.daily_average(_hist(spark, sf)), PEAK_K))


_MASTER_SQL = f"""master AS (
  SELECT DISTINCT pollutant, "Latitude" AS lat, "Longitude" AS lon FROM historic
  WHERE "Latitude" IS NOT NULL AND NOT isnan("Latitude") AND "Longitude" IS NOT NULL AND NOT isnan("Longitude"))"""


@register("master_stations", S.with_ctes([S.HISTORIC, _MASTER_SQL], "SELECT * FROM master ORDER BY pollutant, lat, lon"))
def q_master_stations(spark, sf):
    return H.master_stations(_hist(spark, sf)).orderBy("pollutant", "lat", "lon")


def _dedup_sql(where: str = "TRUE") -> str:
    return f"""dedup AS (
  SELECT pollutant, "Date", lat, lon, "Value" FROM (
    SELECT pollutant, CAST("Date" AS DATE) AS "Date", "Latitude" AS lat, "Longitude" AS lon, "Value",
           row_number() OVER (PARTITION BY pollutant, CAST("Date" AS DATE), "Latitude", "Longitude"
                              ORDER BY "Date", "Value" IS NULL, "Value") AS rn
    FROM historic
    WHERE "Latitude" IS NOT NULL AND NOT isnan("Latitude") AND "Longitude" IS NOT NULL
      AND NOT isnan("Longitude") AND {where})
  WHERE rn = 1)"""


@register("dedup_latlon", S.with_ctes([S.HISTORIC, _dedup_sql()], "SELECT * FROM dedup"))
def q_dedup_latlon(spark, sf):
    return H.dedup_latlon(_hist(spark, sf))


def _ramp_sql(v: str) -> list[str]:
    """Palette colour of ``v``, in whole numbers from the published stops (four segments of 63.75 entries)."""
    stops = {"color_r": (228, 255, 255, 255, 252), "color_g": (255, 232, 189, 160, 127),
             "color_b": (122, 26, 0, 0, 0)}
    i = f"least(CAST(floor({v} / 240.0::DOUBLE * 256) AS BIGINT), 255)"
    out = []
    for name, c in stops.items():
        segs = " ".join(f"WHEN {i} * 4 <= {255 * (k + 1)} THEN ({c[k]} * 255 + ({i} * 4 - {255 * k}) * ({c[k + 1] - c[k]})) // 255"
                        for k in range(4))
        out.append(f"CASE WHEN missing THEN 0 ELSE CAST(CASE {segs} END AS INTEGER) END AS {name}")
    out.append("CASE WHEN missing THEN 0 ELSE 180 END AS color_a")
    return out


def _styled_sql(frame: str) -> str:
    """Styling of a frame CTE with columns pollutant, "Date", lat, lon, Value."""
    return f"""clipped AS (
  SELECT pollutant, "Date", lat, lon, least(greatest(coalesce("Value", 0.0), 0.0), 240.0) AS "Value" FROM {frame}),
flagged AS (SELECT *, "Value" = 0 AS missing FROM clipped),
sorted_vals AS (
  SELECT pollutant, "Date", list_sort(list("Value")) AS xs FROM flagged WHERE NOT missing GROUP BY pollutant, "Date"),
edges AS (
  SELECT pollutant, "Date", list_sort(list_distinct(list_transform(
    [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]::DOUBLE[], lambda q:
      CASE WHEN floor((len(xs)-1)*q) = ceil((len(xs)-1)*q)
             OR xs[CAST(floor((len(xs)-1)*q) AS BIGINT)+1] = xs[CAST(ceil((len(xs)-1)*q) AS BIGINT)+1]
           THEN xs[CAST(floor((len(xs)-1)*q) AS BIGINT)+1]
           ELSE (ceil((len(xs)-1)*q) - (len(xs)-1)*q) * xs[CAST(floor((len(xs)-1)*q) AS BIGINT)+1]
              + ((len(xs)-1)*q - floor((len(xs)-1)*q)) * xs[CAST(ceil((len(xs)-1)*q) AS BIGINT)+1] END))) AS e
  FROM sorted_vals),
binned AS (
  SELECT f.*, CASE WHEN NOT f.missing AND len(x.e) >= 2
                   THEN CAST(greatest(0, len(list_filter(x.e, lambda q: q < f."Value")) - 1) AS INTEGER) END AS decile
  FROM flagged f LEFT JOIN edges x ON f.pollutant = x.pollutant AND f."Date" = x."Date")
SELECT pollutant, "Date", lat, lon, "Value", decile,
       CAST(CASE WHEN missing THEN 0 ELSE 3000 + decile * 2000 END AS INTEGER) AS size,
       {", ".join(_ramp_sql('"Value"'))}
FROM binned"""


def _frame_out(df: DataFrame) -> DataFrame:
    return df.select("pollutant", "Date", "lat", "lon", "Value", "decile", "size",
                     "color_r", "color_g", "color_b", "color_a")


@register("decile_size", S.with_ctes([S.HISTORIC, _dedup_sql()], _styled_sql("dedup")))
def q_decile_size(spark, sf):
    return _frame_out(H.day_values_styled(_hist(spark, sf)))


@register("colour_ramp", S.with_ctes([S.HISTORIC, _dedup_sql()], """flagged AS (
  SELECT pollutant, "Date", lat, lon, least(greatest(coalesce("Value", 0.0), 0.0), 240.0) AS "Value" FROM dedup),
f2 AS (SELECT *, "Value" = 0 AS missing FROM flagged)
SELECT pollutant, "Date", lat, lon, "Value", """ + ", ".join(_ramp_sql('"Value"')) + " FROM f2"))
def q_colour_ramp(spark, sf):
    from aeris.functions.colour import clip_value, ramp_columns
    d = H.dedup_latlon(_hist(spark, sf)).withColumn("Value", clip_value(F.col("Value")))
    return d.withColumns(ramp_columns(F.col("Value"), F.col("Value") == 0)).select(
        "pollutant", "Date", "lat", "lon", "Value", "color_r", "color_g", "color_b", "color_a")


@register("map_frame", S.with_ctes([S.HISTORIC, _MASTER_SQL, _dedup_sql(f"""CAST("Date" AS DATE) = DATE '{DAY}'""")],
          f"""frame AS (
  SELECT m.pollutant, DATE '{DAY}' AS "Date", m.lat, m.lon, d."Value"
  FROM master m LEFT JOIN dedup d ON m.pollutant = d.pollutant AND m.lat = d.lat AND m.lon = d.lon),
""" + _styled_sql("frame")))
def q_map_frame(spark, sf):
    return _frame_out(H.map_frame(_hist(spark, sf), DAY))


@register("map_frame_sparse", S.with_ctes([S.HISTORIC], f"""frame AS (
  SELECT pollutant, CAST("Date" AS DATE) AS "Date", "Latitude" AS lat, "Longitude" AS lon, "Value" FROM historic
  WHERE CAST("Date" AS DATE) = DATE '{DAY}' AND "Latitude" IS NOT NULL AND NOT isnan("Latitude")
    AND "Longitude" IS NOT NULL AND NOT isnan("Longitude")),
""" + _styled_sql("frame")))
def q_map_frame_sparse(spark, sf):
    return _frame_out(H.map_frame(_hist(spark, sf), DAY, densify=False))


@register("map_frames_all", S.with_ctes(
    [S.HISTORIC, _MASTER_SQL,
     _dedup_sql()],
    """span AS (SELECT pollutant, min("Date") AS a, max("Date") AS b FROM dedup GROUP BY pollutant),
days AS (SELECT pollutant, CAST(d AS DATE) AS "Date"
  FROM span, LATERAL (SELECT unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d)),
frame AS (
  SELECT m.pollutant, days."Date", m.lat, m.lon, d."Value"
  FROM master m JOIN days ON days.pollutant = m.pollutant
  LEFT JOIN dedup d ON m.pollutant = d.pollutant AND days."Date" = d."Date" AND m.lat = d.lat AND m.lon = d.lon),
""" + _styled_sql("frame")))
def q_map_frames_all(spark, sf):
    return _frame_out(H.map_frames_all(_hist(spark, sf)))


_BOUNDS_SQL = """bounds AS (SELECT pollutant, CAST(min("Date") AS DATE) AS min_date, CAST(max("Date") AS DATE) AS max_date
  FROM historic GROUP BY pollutant)"""


@register("time_bounds", S.with_ctes([S.HISTORIC, _BOUNDS_SQL], "SELECT * FROM bounds"))
def q_time_bounds(spark, sf):
    return H.time_bounds(_hist(spark, sf))


@register("day_spine", S.with_ctes([S.HISTORIC, _BOUNDS_SQL], """SELECT pollutant, CAST(d AS DATE) AS "Date"
  FROM bounds, LATERAL (SELECT unnest(range(min_date, max_date + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d)"""))
def q_day_spine(spark, sf):
    return H.day_spine(_hist(spark, sf))


@register("default_date", S.with_ctes([S.HISTORIC, _BOUNDS_SQL], f"""SELECT pollutant, min_date AS start_date,
  max_date AS end_date, min_date <= max_date AS valid,
  CASE WHEN NOT (min_date <= max_date) THEN NULL
       WHEN DATE '{H.DEFAULT_DAY}' BETWEEN min_date AND max_date THEN DATE '{H.DEFAULT_DAY}' ELSE min_date END AS default_date
  FROM bounds"""))
def q_default_date(spark, sf):
    return H.default_date(H.time_bounds(_hist(spark, sf)))


# ----- frames as intervals ------------------------------------------------------------

_INTERVAL_SQL = """SELECT {station}, any_value("Value") AS "Value", min(t) AS "from", max(t) AS "to" FROM (
  SELECT *, {number} - row_number() OVER (PARTITION BY {station}, "Value" ORDER BY t) AS island FROM {rows})
GROUP BY {station}, "Value", island"""


@register("frame_intervals", S.with_ctes([S.HISTORIC, _dedup_sql(), 'd AS (SELECT *, "Date" AS t FROM dedup)'], _INTERVAL_SQL.format(
    station="pollutant, lat, lon", number="date_diff('day', DATE '1970-01-01', t)", rows="d")))
def q_frame_intervals(spark, sf):
    """All day frames as one row per station, value and stretch of days."""
    from aeris.operators import intervals as I
    return I.day_intervals(_hist(spark, sf))


@register("frame_lookup", S.with_ctes([S.HISTORIC, _MASTER_SQL, _dedup_sql(f"""CAST("Date" AS DATE) = DATE '{DAY}'""")],
          f"""frame AS (
  SELECT m.pollutant, DATE '{DAY}' AS "Date", m.lat, m.lon, d."Value"
  FROM master m LEFT JOIN dedup d ON m.pollutant = d.pollutant AND m.lat = d.lat AND m.lon = d.lon),
""" + _styled_sql("frame")))
def q_frame_lookup(spark, sf):
    """One day's map from the stored intervals: the same as ``map_frame``."""
    from aeris.operators import intervals as I
    from aeris.session import scratch_path
    from aeris.sources.tables import session_folder

    def write():
        path = scratch_path(spark, "day-intervals")
        I.day_intervals(_hist(spark, sf)).write.parquet(path)
        return path
    stored = spark.read.parquet(session_folder(spark, sf, "day-intervals", write, HISTORIC))
    return _frame_out(I.day_frame(stored, I.day_stations(stored), DAY))


# ======================================= live =========================================

_LIVE = S.LIVE


@register("parse_time", """WITH src AS (
  SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS start_ns,
         CASE WHEN event_id % 67 = 7 THEN 'nonsense'
              WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+02:00'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS start_text
  FROM events)
SELECT event_id, make_timestamp(start_ns // 1000) AS start_from_ns,
       TRY_CAST(regexp_replace(start_text, '[+-][0-9][0-9]:[0-9][0-9]$', '') AS TIMESTAMP) AS start_from_text
FROM src""")
def q_parse_time(spark, sf):
    from aeris.functions.timefmt import parse_time
    from aeris.sources.tables import table
    ev = table(spark, sf, "events").select("event_id", "ts")
    eid = F.col("event_id")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    src = ev.select(eid, (micros * 1000 + eid % 1000).alias("start_from_ns"),
                    F.when(eid % 67 == 7, F.lit("nonsense"))
                     .when(eid % 2 == 0, F.concat(text, F.lit("+02:00"))).otherwise(text).alias("start_from_text"))
    return parse_time(parse_time(src, "start_from_ns"), "start_from_text")


_RAW_COLS = "country, pollutant, url, Samplingpoint, Start, Value"


@register("clean_readings", S.with_ctes([S.RAW_READINGS, S.CLEAN], "SELECT * FROM clean"))
def q_clean_readings(spark, sf):
    return C.clean_readings(A.raw_readings(spark, sf))


@register("filter_last_7d", S.with_ctes([S.RAW_READINGS, S.CLEAN, S.RECENT], "SELECT * FROM recent"))
def q_filter_last_7d(spark, sf):
    return L.recent_readings(A.raw_readings(spark, sf), as_of=A.readings_clock(spark, sf))


@register("filter_year", S.with_ctes([S.RAW_READINGS], """SELECT * FROM raw_readings
  WHERE Start >= TIMESTAMP '2024-01-01 00:00:00' AND Start <= TIMESTAMP '2024-01-15 00:00:00'"""))
def q_filter_year(spark, sf):
    return C.time_range(C.parse_readings(A.raw_readings(spark, sf)), "2024-01-01", "2024-01-15", end_mode="midnight")


@register("year_extract", S.with_ctes([S.RAW_READINGS], f"""SELECT {_RAW_COLS},
  strftime(Start, '%Y-%m-%d %H:%M') AS Datum_Plot FROM raw_readings
  WHERE Start >= TIMESTAMP '2024-01-01 00:00:00' AND Start < TIMESTAMP '2025-01-01 00:00:00'
    AND Value IS NOT NULL AND NOT isnan(Value) AND Value >= 0"""))
def q_year_extract(spark, sf):
    r = C.time_range(C.parse_readings(A.raw_readings(spark, sf)), "2024-01-01", "2024-12-31", end_mode="day")
    return (r.withColumn("Datum_Plot", F.date_format("Start", FMT_AXIS))
             .where(C.valid_value(F.col("Value"))))


@register("station_key", S.with_ctes([S.RAW_READINGS], f"""SELECT DISTINCT Samplingpoint,
  {S.short_id('Samplingpoint')} AS station_id, {S.norm_key(S.short_id('Samplingpoint'))} AS key FROM raw_readings"""))
def q_station_key(spark, sf):
    sp = A.raw_readings(spark, sf).select("Samplingpoint").distinct()
    return sp.select("Samplingpoint", short_id(F.col("Samplingpoint")).alias("station_id"),
                     normalize_key(short_id(F.col("Samplingpoint"))).alias("key"))


_META_COLS = "country, pollutant, station_id, url, round(Value, 6) AS Value, lat, lon, station_name, area_type"


@register("station_meta", S.with_ctes(_LIVE, f"SELECT {_META_COLS} FROM meta"))
def q_station_meta(spark, sf):
    return _station_meta(spark, sf).withColumn("Value", r6("Value"))


@register("station_table", S.with_ctes(_LIVE, f"""st AS (
  SELECT country, pollutant, station_id, sum(Value * n) / sum(n) AS Value, min(url) AS url FROM (
    SELECT f.*, (SELECT count(*) FROM recent r WHERE r.country = f.country AND r.pollutant = f.pollutant
                 AND r.url = f.url) AS n FROM files f) GROUP BY country, pollutant, station_id)
SELECT st.country, st.pollutant, st.station_id, st.url, round(st.Value, 6) AS Value, c.lat, c.lon,
  coalesce(c.station_name, st.station_id) AS station_name, coalesce(c.area_type, 'unknown') AS area_type
FROM st LEFT JOIN coords c ON {S.norm_key('st.station_id')} = c.key"""))
def q_station_table(spark, sf):
    """One row per station (not per file): the survey's fix of duplicate ids."""
    return L.station_meta(_recent(spark, sf), _coords(spark, sf), per_file=False).withColumn("Value", r6("Value"))


@register("readings_named", S.with_ctes(_LIVE, "SELECT * FROM named"))
def q_readings_named(spark, sf):
    return _named(spark, sf)


@register("hourly_mean", S.with_ctes(_LIVE + [S.HOURLY],
          "SELECT country, pollutant, station_id, hour, round(Value, 6) AS Value, n FROM hourly"))
def q_hourly_mean(spark, sf):
    return L.hourly_means(L.station_hours(_recent(spark, sf))).withColumn("Value", r6("Value"))


_VIEW_COLS = ("country, pollutant, station_id, url, station_name, lat, lon, area_type, is_fallback, "
              "round(Value, 6) AS Value, {style}, {symbol} AS symbol, {vstr} AS value_str").format(
    style=S.style("Value", "pollutant"), symbol=S.symbol("area_type"), vstr=S.decimals("Value", 2))


def _view_out(df: DataFrame) -> DataFrame:
    cols = ["country", "pollutant", "station_id", "url", "station_name", "lat", "lon", "area_type",
            "is_fallback", "Value", "aqi_label", "color_r", "color_g", "color_b", "color_a", "symbol", "value_str"]
    if "hour" in df.columns:
        cols.insert(3, "hour")
    return df.withColumn("Value", r6("Value")).select(*cols)


_HOUR_VIEW_SQL = S.with_ctes(_LIVE + [S.HOURLY, """last AS (SELECT country, pollutant, max(hour) AS hour FROM hourly GROUP BY country, pollutant)""",
    """hv AS (SELECT h.country, h.pollutant, h.station_id, h.Value AS v FROM hourly h
       SEMI JOIN last USING (country, pollutant, hour))""",
    """frame AS (SELECT m.country, m.pollutant, m.station_id, m.url, m.station_name, m.lat, m.lon, m.area_type,
         hv.v IS NULL AS is_fallback, coalesce(hv.v, m.Value) AS Value
       FROM meta m LEFT JOIN hv ON m.country = hv.country AND m.pollutant = hv.pollutant AND m.station_id = hv.station_id
       WHERE m.lat IS NOT NULL AND NOT isnan(m.lat) AND m.lon IS NOT NULL AND NOT isnan(m.lon))"""],
    f"SELECT {_VIEW_COLS} FROM frame")


def _hour_view(spark, sf, hour=None):
    return L.live_view(_recent(spark, sf), _coords(spark, sf), hour)


@register("hour_view", _HOUR_VIEW_SQL)
def q_hour_view(spark, sf):
    return _view_out(_hour_view(spark, sf))


VIEW_HOUR = "2024-01-27 12:00:00"   # an explicitly chosen hour (the slider position)


@register("hour_view_at", S.with_ctes(_LIVE + [S.HOURLY,
    f"""hv AS (SELECT country, pollutant, station_id, Value AS v FROM hourly WHERE hour = TIMESTAMP '{VIEW_HOUR}')""",
    """frame AS (SELECT m.country, m.pollutant, m.station_id, m.url, m.station_name, m.lat, m.lon, m.area_type,
         hv.v IS NULL AS is_fallback, coalesce(hv.v, m.Value) AS Value
       FROM meta m LEFT JOIN hv ON m.country = hv.country AND m.pollutant = hv.pollutant AND m.station_id = hv.station_id
       WHERE m.lat IS NOT NULL AND NOT isnan(m.lat) AND m.lon IS NOT NULL AND NOT isnan(m.lon))"""],
    f"SELECT {_VIEW_COLS} FROM frame"))
def q_hour_view_at(spark, sf):
    """The hour view at a chosen hour."""
    return _view_out(_hour_view(spark, sf, VIEW_HOUR))


_HOURS_SQL = "hours AS (SELECT DISTINCT country, pollutant, date_trunc('hour', Start) AS hour FROM named)"


@register("all_hours", S.with_ctes(_LIVE + [_HOURS_SQL], "SELECT * FROM hours ORDER BY country, pollutant, hour"))
def q_all_hours(spark, sf):
    return L.observed_hours(_recent(spark, sf)).orderBy("country", "pollutant", "hour")


@register("frame_index", S.with_ctes(_LIVE + [_HOURS_SQL], """SELECT country, pollutant, hour,
  CAST(row_number() OVER (PARTITION BY country, pollutant ORDER BY hour) AS INTEGER) AS frame,
  count(*) OVER (PARTITION BY country, pollutant) AS n_frames,
  lead(hour) OVER (PARTITION BY country, pollutant ORDER BY hour) AS next_hour FROM hours"""))
def q_frame_index(spark, sf):
    return L.frame_index(_recent(spark, sf))


@register("hour_bounds", S.with_ctes(_LIVE, """SELECT country, pollutant,
  date_trunc('hour', min(Start)) AS first_hour, date_trunc('hour', max(Start)) AS last_hour
  FROM named GROUP BY country, pollutant"""))
def q_hour_bounds(spark, sf):
    """Slider bounds of the live view: first and last hour per group."""
    return L.hour_bounds(_recent(spark, sf))


@register("hour_spine", S.with_ctes(_LIVE, """SELECT country, pollutant, h AS hour FROM (
  SELECT country, pollutant, date_trunc('hour', min(Start)) AS a, date_trunc('hour', max(Start)) AS b
  FROM named GROUP BY country, pollutant), LATERAL (SELECT unnest(range(a, b + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h)"""))
def q_hour_spine(spark, sf):
    return L.hour_spine(_recent(spark, sf))


@register("hour_frames_all", S.with_ctes(_LIVE + [S.HOURLY, _HOURS_SQL,
    """frame AS (SELECT m.country, m.pollutant, m.station_id, hs.hour, m.url, m.station_name, m.lat, m.lon, m.area_type,
         h.Value IS NULL AS is_fallback, coalesce(h.Value, m.Value) AS Value
       FROM meta m JOIN hours hs ON m.country = hs.country AND m.pollutant = hs.pollutant
       LEFT JOIN hourly h ON h.country = m.country AND h.pollutant = m.pollutant
            AND h.station_id = m.station_id AND h.hour = hs.hour
       WHERE m.lat IS NOT NULL AND NOT isnan(m.lat) AND m.lon IS NOT NULL AND NOT isnan(m.lon))"""],
    f"SELECT hour, {_VIEW_COLS} FROM frame"))
def q_hour_frames_all(spark, sf):
    """Dense by definition (stations x observed hours). ``hourly_mean`` and ``hour_view_at`` are the sparse
    table and the single frame; here the pre-aggregated hours are written once and used twice."""
    from aeris.session import materialize
    hours = materialize(L.station_hours(_recent(spark, sf)), "station-hours")
    return _view_out(L.hour_frames_all(L.station_meta_of(hours, _coords(spark, sf)), L.hourly_means(hours)))


@register("hour_intervals", S.with_ctes(_LIVE + [S.HOURLY, 'd AS (SELECT country, pollutant, station_id, Value AS "Value", hour AS t FROM hourly)',
    "i AS (" + _INTERVAL_SQL.format(station="country, pollutant, station_id", number="date_diff('hour', TIMESTAMP '1970-01-01', t)", rows="d") + ")"],
    'SELECT country, pollutant, station_id, round("Value", 6) AS "Value", "from", "to" FROM i'))
def q_hour_intervals(spark, sf):
    """All hour frames as one row per station, mean and stretch of hours."""
    from aeris.operators import intervals as I
    hourly = L.hourly_means(L.station_hours(_recent(spark, sf)))
    return I.hour_intervals(hourly).withColumn("Value", r6("Value"))


@register("hour_lookup", REGISTRY["hour_view_at"].sql)
def q_hour_lookup(spark, sf):
    """The hour view at a chosen hour from the intervals: the same as ``hour_view_at``."""
    from aeris.operators import intervals as I
    from aeris.session import materialize
    hours = materialize(L.station_hours(_recent(spark, sf)), "station-hours")
    intervals = I.hour_intervals(L.hourly_means(hours))
    return _view_out(I.hour_frame(L.station_meta_of(hours, _coords(spark, sf)), intervals, VIEW_HOUR))


@register("area_symbol", S.with_ctes(_LIVE, f"SELECT country, pollutant, station_id, url, area_type, {S.symbol('area_type')} AS symbol FROM meta"))
def q_area_symbol(spark, sf):
    meta = _station_meta(spark, sf)
    return meta.select("country", "pollutant", "station_id", "url", "area_type",
                       L.area_symbol(F.col("area_type")).alias("symbol"))


def _payload_sql() -> str:
    fields = ", ".join(f"'{c}': {c}" for c in P.PAYLOAD_COLUMNS)
    norm = "coalesce(lower(area_type), 'unknown')"
    bucket = "CASE " + " ".join(
        f"WHEN {norm} IN ({', '.join(repr(m) for m in members)}) THEN '{name}'" for name, members in P.BUCKETS) + " END"
    hv = _HOUR_VIEW_SQL.replace(f"\nSELECT {_VIEW_COLS} FROM frame", f",\nview AS (SELECT {_VIEW_COLS} FROM frame)")
    return hv + f"""
SELECT country, pollutant, bucket, station_id, CAST(to_json({{{fields}}}) AS VARCHAR) AS record
FROM (SELECT *, {bucket} AS bucket FROM view) WHERE bucket IS NOT NULL"""


@register("map_payload", _payload_sql())
def q_map_payload(spark, sf):
    return P.map_payload(_hour_view(spark, sf))


PAGE_ROWS = 40


def _pages_sql() -> str:
    payload = _payload_sql()
    head, tail = payload.rsplit("\nSELECT country, pollutant, bucket, station_id,", 1)
    order = "CASE bucket " + " ".join(f"WHEN '{n}' THEN {k}" for k, (n, _) in enumerate(P.BUCKETS)) + " END"
    arrays = " || ',' || ".join(f"""'"{n}":[' || coalesce(string_agg(record, ',' ORDER BY place) FILTER (WHERE bucket = '{n}'), '') || ']'"""
                                for n, _ in P.BUCKETS)
    return head + f""",
records AS (SELECT country, pollutant, bucket, station_id,{tail}),
placed AS (SELECT *, row_number() OVER (PARTITION BY country, pollutant ORDER BY {order}, station_id, record) - 1 AS place FROM records),
paged AS (SELECT *, CAST(place // {PAGE_ROWS} AS INTEGER) AS page,
  CAST(max(place) OVER (PARTITION BY country, pollutant) // {PAGE_ROWS} + 1 AS INTEGER) AS n_pages FROM placed)
SELECT country, pollutant, page, n_pages, '{{' || {arrays} || '}}' AS payload FROM paged GROUP BY country, pollutant, page, n_pages"""


@register("payload_pages", _pages_sql())
def q_payload_pages(spark, sf):
    return P.payload_pages(_hour_view(spark, sf), PAGE_ROWS)


@register("empty_schema", S.with_ctes(_LIVE, f"SELECT {_META_COLS} FROM meta WHERE pollutant = 'CO'"))
def q_empty_schema(spark, sf):
    """A request that finds nothing (no CO series) still yields the station table's typed schema."""
    return _station_meta(spark, sf).where(F.col("pollutant") == "CO").withColumn("Value", r6("Value"))


@register("coords_status", S.with_ctes(_LIVE, """SELECT country, pollutant, count(*) AS n_stations,
  count(lat) AS n_with_coords, count(lat) = 0 AS unresolved FROM meta GROUP BY country, pollutant"""))
def q_coords_status(spark, sf):
    return M.coords_status(_station_meta(spark, sf))


@register("station_count", S.with_ctes(_LIVE, """SELECT coalesce(s.country, r.country) AS country,
  coalesce(s.pollutant, r.pollutant) AS pollutant, s.stations, r.rows_loaded
  FROM (SELECT country, pollutant, count(*) AS stations FROM meta GROUP BY ALL) s
  FULL JOIN (SELECT country, pollutant, count(*) AS rows_loaded FROM named GROUP BY ALL) r
  ON s.country = r.country AND s.pollutant = r.pollutant"""))
def q_station_count(spark, sf):
    return P.station_count(L.station_files(_recent(spark, sf)))


@register("station_names", S.with_ctes(_LIVE, """SELECT country, pollutant, station_name FROM meta
  WHERE station_name IS NOT NULL ORDER BY country, pollutant, station_name"""))
def q_station_names(spark, sf):
    return P.station_names(_station_meta(spark, sf)).orderBy("country", "pollutant", "station_name")


# ======================================= index ========================================

_PARSED_SQL = "parsed AS (SELECT * FROM raw_readings)"


@register("eaqi_case", S.with_ctes([S.RAW_READINGS], f"""SELECT {_RAW_COLS},
  {S.label('Value', 'pollutant')} AS aqi_label FROM raw_readings"""))
def q_eaqi_case(spark, sf):
    r = C.parse_readings(A.raw_readings(spark, sf))
    return r.withColumn("aqi_label", eaqi.aqi_label(F.col("Value"), F.col("pollutant")))


@register("eaqi_range_join", S.with_ctes([S.RAW_READINGS], f"""SELECT {_RAW_COLS},
  {S.label('Value', 'pollutant')} AS aqi_label FROM raw_readings"""))
def q_eaqi_range_join(spark, sf):
    r = C.parse_readings(A.raw_readings(spark, sf))
    return eaqi.classify_range_join(r, eaqi.eaqi_dim(spark))


@register("eaqi_style", S.with_ctes([S.RAW_READINGS], f"""SELECT {_RAW_COLS}, {S.style('Value', 'pollutant')}
  FROM raw_readings"""))
def q_eaqi_style(spark, sf):
    return eaqi.with_aqi_style(C.parse_readings(A.raw_readings(spark, sf)))


@register("eaqi_dim", S.with_ctes([S.RAW_READINGS, S.CLEAN, S.dim_values()], f"""SELECT d.pollutant, d.tier, d.lower,
  d.upper, d.label, d.colour, coalesce(c.n, 0) AS n_readings
  FROM eaqi d LEFT JOIN (
    SELECT {S.effective('pollutant')} AS ep, {S.label('Value', 'pollutant')} AS aqi_label, count(*) AS n
    FROM clean GROUP BY ALL) c ON d.pollutant = c.ep AND d.label = c.aqi_label"""))
def q_eaqi_dim(spark, sf):
    clean = C.clean_readings(A.raw_readings(spark, sf))
    labelled = clean.select(eaqi.effective_pollutant(F.col("pollutant")).alias("pollutant"),
                            eaqi.aqi_label(F.col("Value"), F.col("pollutant")).alias("label"))
    counts = labelled.groupBy("pollutant", "label").agg(F.count(F.lit(1)).alias("n_readings"))
    dim = eaqi.eaqi_dim(spark)
    # the dimension is the preserved side; counts are one row per (pollutant, tier)
    return (dim.join(counts, ["pollutant", "label"], "left")
            .select("pollutant", "tier", "lower", "upper", "label", "colour",
                    F.coalesce("n_readings", F.lit(0)).alias("n_readings")))


@register("legend", S.with_ctes([S.RAW_READINGS, S.dim_values()], """SELECT p.pollutant, d.tier, d.label, d.colour,
  CASE WHEN d.upper = 'inf'::DOUBLE THEN CAST(CAST(d.lower AS BIGINT) AS VARCHAR) || '+'
       ELSE CAST(CAST(d.lower AS BIGINT) AS VARCHAR) || '–' || CAST(CAST(d.upper AS BIGINT) AS VARCHAR) END AS range_text
  FROM (SELECT DISTINCT pollutant FROM raw_readings) p
  JOIN eaqi d ON d.pollutant = """ + S.effective("p.pollutant")))
def q_legend(spark, sf):
    return P.legend(A.raw_readings(spark, sf), eaqi.eaqi_dim(spark))


@register("value_text", S.with_ctes([S.RAW_READINGS], f"""SELECT {_RAW_COLS},
  {S.decimals('Value', 2)} AS value_str, {S.decimals('Value', 1)} AS value_str1 FROM raw_readings"""))
def q_value_text(spark, sf):
    r = C.parse_readings(A.raw_readings(spark, sf))
    return r.withColumns({"value_str": fixed_decimals(F.col("Value"), 2),
                          "value_str1": fixed_decimals(F.col("Value"), 1)})


@register("format_time", S.with_ctes([S.RAW_READINGS, S.CLEAN], """SELECT country, pollutant, url, Start,
  strftime(Start, '%Y-%m-%d %H:%M') AS axis_text, strftime(Start, '%d %b %Y, %H:%M') AS header_text,
  strftime(Start, '%a %d %b, %H:%M') AS card_text, strftime(Start, '%d %b, %H:%M') AS slider_text FROM clean"""))
def q_format_time(spark, sf):
    c = C.clean_readings(A.raw_readings(spark, sf))
    return c.select("country", "pollutant", "url", "Start",
                    F.date_format("Start", FMT_AXIS).alias("axis_text"),
                    F.date_format("Start", FMT_HEADER).alias("header_text"),
                    F.date_format("Start", FMT_CARD).alias("card_text"),
                    F.date_format("Start", FMT_SLIDER).alias("slider_text"))


_BANDS_SQL = S.dim_values() + """,
bands AS (SELECT printf('SPO-%05d', c.c_custkey) AS station_id, d.pollutant, d.tier, d.lower * (1 + c.c_custkey % 7 / 10.0::DOUBLE) AS lower,
    d.upper * (1 + c.c_custkey % 7 / 10.0::DOUBLE) AS upper FROM customer c, eaqi d)"""


@register("band_lookup", S.with_ctes([S.RAW_READINGS, S.CLEAN, _BANDS_SQL], f"""SELECT r.country, r.pollutant, r.Start, r.Value, r.station_id,
  b.tier, round(b.lower, 6) AS lower, round(b.upper, 6) AS upper
FROM (SELECT *, {S.short_id('Samplingpoint')} AS station_id FROM clean) r LEFT JOIN bands b
  ON b.station_id = r.station_id AND b.pollutant = r.pollutant AND (r.Value > b.lower OR (b.tier = 1 AND r.Value = b.lower)) AND r.Value <= b.upper"""))
def q_band_lookup(spark, sf):
    """Every reading with the band of its own station's limits: a band table that grows with the stations."""
    from aeris.functions.keys import short_id
    from aeris.operators.bands import band_join
    from aeris.sources.tables import table
    k = F.col("c_custkey")
    factor = 1 + (k % 7) / F.lit(10.0)
    rows = F.array(*[F.struct(F.lit(p).alias("pollutant"), F.lit(t).alias("tier"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"))
                     for p, t, lo, hi, _, _ in eaqi.dim_rows()])
    bands = table(spark, sf, "customer").select(A.station_name(k).alias("station_id"), factor.alias("_f"), F.explode(rows).alias("d")) \
        .select("station_id", "d.pollutant", "d.tier", (F.col("d.lower") * F.col("_f")).alias("lower"),
                (F.col("d.upper") * F.col("_f")).alias("upper"), (F.col("d.tier") == 1).alias("_closed"))
    clean = C.clean_readings(A.raw_readings(spark, sf)).withColumn("station_id", short_id(F.col("Samplingpoint")))
    out = band_join(clean, bands, ["station_id", "pollutant"], "Value", lower_closed="_closed")
    return out.select("country", "pollutant", "Start", "Value", "station_id", "tier", r6("lower").alias("lower"), r6("upper").alias("upper"))


# ===================================== compare ========================================

_SERIES_SQL = f"""series AS (SELECT *, coalesce({S.label('Value', 'pollutant')}, 'Unknown') AS aqi_label FROM named)"""


@register("compare_series", S.with_ctes(_LIVE + [_SERIES_SQL], "SELECT * FROM series"))
def q_compare_series(spark, sf):
    return CMP.compare_series(_named(spark, sf))


@register("compare_semi", S.with_ctes(_LIVE + [_SERIES_SQL, """sel AS (
  SELECT country, pollutant, station_name FROM (
    SELECT country, pollutant, station_name,
           row_number() OVER (PARTITION BY country, pollutant ORDER BY count(*) DESC, station_name) AS rk
    FROM named WHERE station_name IS NOT NULL GROUP BY country, pollutant, station_name) WHERE rk <= 2)"""],
    "SELECT s.* FROM series s SEMI JOIN sel USING (country, pollutant, station_name)"))
def q_compare_semi(spark, sf):
    recent = _recent(spark, sf)
    files = CMP.station_sizes(recent, _coords(spark, sf))
    chosen = files.join(CMP.top_stations(files, 2), CMP.STATION, "left_semi")
    return CMP.compare_series(recent.join(chosen.drop("hours"), [*L.GROUP, "url"]).select(
        *L.GROUP, "station_id", "station_name", "Start", "Value"))


_COUNTS_SQL = """counts AS (SELECT country, pollutant, station_name, aqi_label, count(*) AS hours
  FROM series GROUP BY country, pollutant, station_name, aqi_label)"""


@register("tier_breakdown", S.with_ctes(_LIVE + [_SERIES_SQL, _COUNTS_SQL], f"""SELECT *,
  round(hours / sum(hours) OVER (PARTITION BY country, pollutant, station_name), 6) AS share,
  {S.order_of('aqi_label')} AS order_idx FROM counts"""))
def q_tier_breakdown(spark, sf):
    t = CMP.tier_breakdown(CMP.label_counts(_recent(spark, sf), _coords(spark, sf)))
    return t.withColumn("share", r6("share"))


def _summary_sql() -> str:
    parts = []
    for tag, s in (("worst", "w"), ("best", "b")):
        lab = f"coalesce({S.label(f'{s}_value', 'pollutant')}, '—')"
        parts.append(f"""{s}_start AS {tag}_start, {s}_value AS {tag}_value, {lab} AS {tag}_label,
  {S.colour_of(lab)} AS {tag}_colour, strftime({s}_start, '%a %d %b, %H:%M') AS {tag}_time_text,
  {S.decimals(f'{s}_value', 1)} AS {tag}_value_text""")
    return f"""ext AS (
  SELECT country, pollutant, station_name,
         arg_min(Start, (-Value, Start)) AS w_start, arg_min(Value, (-Value, Start)) AS w_value,
         arg_min(Start, (Value, Start)) AS b_start, arg_min(Value, (Value, Start)) AS b_value,
         count(*) AS n_readings
  FROM series GROUP BY country, pollutant, station_name),
dom AS (SELECT country, pollutant, station_name,
         arg_min(aqi_label, (-hours, {S.order_of('aqi_label')})) AS dominant
  FROM counts GROUP BY country, pollutant, station_name),
j AS (SELECT e.country, e.pollutant, e.station_name, e.n_readings, d.dominant,
    {S.colour_of('d.dominant')} AS colour, e.w_start, e.w_value, e.b_start, e.b_value
  FROM ext e JOIN dom d ON e.country = d.country AND e.pollutant = d.pollutant AND e.station_name = d.station_name)
SELECT country, pollutant, station_name, n_readings, dominant, colour, {", ".join(parts)} FROM j"""


@register("station_summary", S.with_ctes(_LIVE + [_SERIES_SQL, _COUNTS_SQL], _summary_sql()))
def q_station_summary(spark, sf):
    return CMP.station_summary(CMP.station_labels(_recent(spark, sf), _coords(spark, sf))).select(
        "country", "pollutant", "station_name", "n_readings", "dominant", "colour",
        *[f"{t}_{x}" for t in ("worst", "best")
          for x in ("start", "value", "label", "colour", "time_text", "value_text")])


@register("chart_bands", S.with_ctes(_LIVE + [S.dim_values()], f"""ym AS (
  SELECT n.country, n.pollutant, {S.effective('n.pollutant')} AS ep,
         greatest(max(n.Value) * 1.15, any_value(d.upper) + 1.0) AS y_max
  FROM named n JOIN eaqi d ON d.pollutant = {S.effective('n.pollutant')} AND d.tier = 2
  GROUP BY n.country, n.pollutant)
SELECT ym.country, ym.pollutant, d.tier, d.lower AS y1, least(d.upper, ym.y_max) AS y2, d.label, d.colour, ym.y_max
FROM ym JOIN eaqi d ON d.pollutant = ym.ep WHERE d.lower < ym.y_max"""))
def q_chart_bands(spark, sf):
    return CMP.chart_bands(_recent(spark, sf), eaqi.eaqi_dim(spark))


# ===================================== metadata =======================================

_META_BASE = [S.RAW_METADATA, S.META_SELECT, S.META_CLEAN]
_CLEAN_COLS = ("country, air_quality_station_name, sampling_point_id, latitude, longitude, "
               "air_quality_station_area, operational_activity_begin, operational_activity_end")


@register("metadata_select", S.with_ctes([S.RAW_METADATA, S.META_SELECT], f"SELECT {_CLEAN_COLS} FROM meta_sel"))
def q_metadata_select(spark, sf):
    return M.metadata_select(A.raw_metadata(spark, sf), keep_order=False)


@register("metadata_dedup", S.with_ctes(_META_BASE, f"SELECT {_CLEAN_COLS} FROM meta_clean"))
def q_metadata_dedup(spark, sf):
    return M.metadata_dedup(A.raw_metadata(spark, sf)).drop(M.ORDER_COL)


@register("metadata_profile", S.with_ctes(_META_BASE, """SELECT (SELECT count(*) FROM raw_metadata) AS rows_before,
  9 AS cols_before, (SELECT count(*) FROM meta_clean) AS rows_after, 8 AS cols_after,
  (SELECT count(*) FROM raw_metadata) - (SELECT count(*) FROM meta_clean) AS rows_removed"""))
def q_metadata_profile(spark, sf):
    return M.metadata_profile(A.raw_metadata(spark, sf))


@register("metadata_preview", S.with_ctes(_META_BASE, f"SELECT {_CLEAN_COLS} FROM meta_clean ORDER BY source_row LIMIT 3"))
def q_metadata_preview(spark, sf):
    return M.metadata_preview(M.metadata_dedup(A.raw_metadata(spark, sf))).drop(M.ORDER_COL)


@register("metadata_coords", S.with_ctes(_META_BASE + [S.COORDS], "SELECT * FROM coords"))
def q_metadata_coords(spark, sf):
    return _coords(spark, sf)


@register("union_metadata", S.with_ctes([S.RAW_METADATA], """SELECT "Country", "Air Quality Station Name",
  "Sampling Point Id", "Latitude", "Longitude", "Air Quality Station Area", "Operational Activity Begin",
  "Operational Activity End", "Air Pollutant", source_row, CAST(NULL AS VARCHAR) AS "Namespace"
  FROM raw_metadata WHERE "Air Pollutant" = 'PM10'
UNION ALL
SELECT "Country", "Air Quality Station Name", "Sampling Point Id", "Latitude", "Longitude",
  CAST(NULL AS VARCHAR), "Operational Activity Begin", "Operational Activity End", "Air Pollutant", source_row,
  'source-b' FROM raw_metadata WHERE "Air Pollutant" <> 'PM10'"""))
def q_union_metadata(spark, sf):
    raw = A.raw_metadata(spark, sf)
    a = raw.where(F.col("`Air Pollutant`") == "PM10")
    b = (raw.where(F.col("`Air Pollutant`") != "PM10").drop("Air Quality Station Area")
         .withColumn("Namespace", F.lit("source-b")))
    return M.union_metadata(a, b)


# ====================================== sources =======================================

_SERIES_SQL_ALL = f"""SELECT country, pollutant, {S.short_id('Samplingpoint')} AS series, Samplingpoint, Start, Value
  FROM raw_readings"""


def _series_root(spark, sf):
    """The readings stored as Parquet (country/pollutant partitions), written once per session."""
    from aeris.session import scratch_path
    from aeris.sources.files import write_series
    from aeris.sources.tables import session_folder
    return session_folder(spark, sf, "series", lambda: write_series(
        A.raw_readings(spark, sf).drop("url"), scratch_path(spark, "series")))


def _scan_out(df: DataFrame) -> DataFrame:
    from aeris.sources.files import with_series
    return with_series(df).select("country", "pollutant", "series", "Samplingpoint", "Start", "Value")


@register("scan_readings", S.with_ctes([S.RAW_READINGS], _SERIES_SQL_ALL))
def q_scan_readings(spark, sf):
    from aeris.sources.files import scan_readings
    root = _series_root(spark, sf)
    return _scan_out(scan_readings(spark, root))


def _damaged_root(spark, sf):
    """Stored readings plus a folder whose file is not Parquet (a failed download), written once per session
    with Spark's own writer, so it works on any shared file system."""
    from aeris.session import scratch_path
    from aeris.sources.files import write_series
    from aeris.sources.tables import session_folder

    def write():
        root = write_series(A.raw_readings(spark, sf).drop("url"), scratch_path(spark, "series-tolerant"))
        spark.createDataFrame([("PAR1 not a parquet file",)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{root}/country=_broken/pollutant=PM10")
        return root
    return session_folder(spark, sf, "series-tolerant", write)


@register("scan_tolerant", S.with_ctes([S.RAW_READINGS], _SERIES_SQL_ALL))
def q_scan_tolerant(spark, sf):
    from aeris.sources.files import scan_readings
    return _scan_out(scan_readings(spark, _damaged_root(spark, sf), tolerant=True))


@register("scan_skipped", S.with_ctes([S.RAW_READINGS], """SELECT country, pollutant,
  CAST(count(*) AS BIGINT) AS rows_read, CAST(0 AS BIGINT) AS files_skipped FROM raw_readings GROUP BY country, pollutant
UNION ALL SELECT '_broken', 'PM10', CAST(0 AS BIGINT), CAST(1 AS BIGINT)"""))
def q_scan_skipped(spark, sf):
    """What a tolerant scan read and left out, per requested group."""
    from aeris.sources.files import scan_readings, skipped_files
    root = _damaged_root(spark, sf)
    read = scan_readings(spark, root, tolerant=True).groupBy("country", "pollutant").agg(
        F.count(F.lit(1)).alias("rows_read"))
    left = _path_parts(skipped_files(spark, root)).groupBy("country", "pollutant").agg(
        F.count(F.lit(1)).alias("files_skipped"))
    return read.join(left, ["country", "pollutant"], "full").select(
        "country", "pollutant", F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
        F.coalesce("files_skipped", F.lit(0)).alias("files_skipped"))


_SEL_COUNTRIES = ["NATION_3", "NATION_7", "NATION_12"]
_SEL_POLLUTANTS = ["NO2", "PM10"]
_SEL_START, _SEL_END = "2024-01-08 00:00:00", "2024-01-21 23:59:59"


@register("select_partition", S.with_ctes([S.RAW_READINGS], f"""SELECT * FROM ({_SERIES_SQL_ALL})
  WHERE country IN ('NATION_3', 'NATION_7', 'NATION_12') AND pollutant IN ('NO2', 'PM10')
    AND Start >= TIMESTAMP '{_SEL_START}' AND Start <= TIMESTAMP '{_SEL_END}'"""))
def q_select_partition(spark, sf):
    from aeris.sources.files import scan_readings, select_partition
    root = _series_root(spark, sf)
    return _scan_out(select_partition(scan_readings(spark, root), _SEL_COUNTRIES, _SEL_POLLUTANTS,
                                      _SEL_START, _SEL_END))


def _releases_root(spark, sf) -> str:
    """Readings of two releases, stored by release: all but every third minute up to date, and verified ones (corrected by
    0.5) of every other minute."""
    from aeris.operators import releases as RL
    from aeris.session import scratch_path
    from aeris.sources.files import write_series
    from aeris.sources.tables import session_folder
    raw = A.raw_readings(spark, sf).drop("url")
    minute = F.minute("Start")
    both = raw.where(minute % 3 != 0).withColumn("dataset", F.lit(RL.UP_TO_DATE)).unionByName(
        raw.where(minute % 2 == 0).withColumn("Value", F.col("Value") + 0.5).withColumn("dataset", F.lit(RL.VERIFIED)))
    return session_folder(spark, sf, "releases", lambda: write_series(both, scratch_path(spark, "releases"), releases=True))


_RELEASE_SQL = """up AS (SELECT country, pollutant, Samplingpoint, Start, Value FROM raw_readings WHERE extract('minute' FROM Start) % 3 <> 0),
ver AS (SELECT country, pollutant, Samplingpoint, Start, Value + 0.5 AS Value FROM raw_readings WHERE extract('minute' FROM Start) % 2 = 0),
best AS (SELECT *, 2 AS dataset FROM ver UNION ALL SELECT *, 1 FROM up ANTI JOIN ver USING (country, pollutant, Samplingpoint, Start))"""


@register("release_precedence", S.with_ctes([S.RAW_READINGS, _RELEASE_SQL], f"""SELECT country, pollutant, Samplingpoint, Start,
  Value, dataset FROM best WHERE country IN ('NATION_3', 'NATION_7', 'NATION_12') AND pollutant IN ('NO2', 'PM10')
    AND Start >= TIMESTAMP '{_SEL_START}' AND Start <= TIMESTAMP '{_SEL_END}'"""))
def q_release_precedence(spark, sf):
    """A request over two releases: the verified reading where there is one, else the one that is up to date."""
    from aeris.operators.releases import best_release
    from aeris.sources.files import scan_readings, select_partition
    series = scan_readings(spark, _releases_root(spark, sf), releases=True)
    return best_release(select_partition(series, _SEL_COUNTRIES, _SEL_POLLUTANTS, _SEL_START, _SEL_END))


@register("select_dataset", S.with_ctes([S.RAW_READINGS, _RELEASE_SQL], """SELECT country, pollutant, count(*) AS n,
  round(sum(CASE WHEN NOT isnan(Value) THEN Value END), 6) AS total FROM ver GROUP BY ALL"""))
def q_select_dataset(spark, sf):
    """One release of the request, chosen by pruning folders."""
    from aeris.operators.releases import VERIFIED
    from aeris.sources.files import scan_readings, select_partition
    rows = select_partition(scan_readings(spark, _releases_root(spark, sf), releases=True), datasets=[VERIFIED])
    value = F.when(~F.isnan("Value"), F.col("Value"))
    return rows.groupBy("country", "pollutant").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(value)).alias("total"))


def _manifest(spark, sf):
    from aeris.session import scratch_path
    from aeris.sources.files import manifest_entries, write_manifest
    root = _series_root(spark, sf)
    return manifest_entries(spark, write_manifest(spark, root, scratch_path(spark, "manifest")))


def _path_parts(df: DataFrame) -> DataFrame:
    p = F.col("path")
    return df.select(*[F.regexp_extract(p, rf"{k}=([^/]+)", 1).alias(k) for k in ("country", "pollutant")])


_DISTINCT_GROUPS = "SELECT DISTINCT country, pollutant FROM raw_readings"


@register("manifest_paths", S.with_ctes([S.RAW_READINGS], _DISTINCT_GROUPS))
def q_manifest_paths(spark, sf):
    return _path_parts(_manifest(spark, sf)).distinct()


@register("manifest_first", S.with_ctes([S.RAW_READINGS],
          f"SELECT * FROM ({_DISTINCT_GROUPS}) ORDER BY country, pollutant LIMIT 1"))
def q_manifest_first(spark, sf):
    from aeris.sources.files import manifest_first
    return _path_parts(manifest_first(_manifest(spark, sf)))


@register("manifest_scan", S.with_ctes([S.RAW_READINGS], _SERIES_SQL_ALL))
def q_manifest_scan(spark, sf):
    """Manifest → folders → one multi-file scan of the listed files (the reference's fetch loop)."""
    from aeris.session import scratch_path
    from aeris.sources.files import manifest_entries, read_manifest, write_manifest
    root = _series_root(spark, sf)
    entries = manifest_entries(spark, write_manifest(spark, root, scratch_path(spark, "manifest")))
    return _scan_out(read_manifest(spark, entries, base_path=root))


@register("metadata_sink", S.with_ctes(_META_BASE, f"SELECT {_CLEAN_COLS} FROM meta_clean"))
def q_metadata_sink(spark, sf):
    from aeris.session import scratch_path
    from aeris.sources.csvio import read_csv_metadata, write_csv
    clean = M.metadata_dedup(A.raw_metadata(spark, sf)).drop(M.ORDER_COL)
    path = write_csv(clean, scratch_path(spark, "metadata-csv"))
    return _typed_metadata(read_csv_metadata(spark, path), clean)


def _typed_metadata(text: DataFrame, like: DataFrame) -> DataFrame:
    """Text columns back to the clean metadata's types (bad text → null)."""
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in like.schema.fields])


@register("csv_dialect", S.with_ctes(_META_BASE, f"SELECT {_CLEAN_COLS} FROM meta_clean"))
def q_csv_dialect(spark, sf):
    from aeris.session import scratch_path
    from aeris.sources.csvio import read_csv_discovered, write_csv
    clean = M.metadata_dedup(A.raw_metadata(spark, sf)).drop(M.ORDER_COL)
    path = write_csv(clean, scratch_path(spark, "metadata-semicolon"), sep=";", encoding="latin-1")
    found = read_csv_discovered(spark, path)
    assert found is not None, "no CSV dialect matched"
    return _typed_metadata(found, clean)


_CSV_NAMES = ["Country", "Air Quality Station Name", "Sampling Point Id", "Latitude", "Longitude", "Air Quality Station Area",
              "Operational Activity Begin", "Operational Activity End"]


def _csv_lines(spark, sf, extra: str = ",") -> DataFrame:
    """The raw metadata as hand-written CSV lines (quoted names with separators and doubled quotes), some of them with
    more or fewer fields than the header: by row number, 3 of 7 get two more fields (the first one empty), 4 of 7 an empty
    one more, and of the others 5 of 11 lack the last two."""
    raw = A.raw_metadata(spark, sf)
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in _CSV_NAMES]
    text[1] = F.concat(F.lit('"'), text[1], F.lit(', ""A"""'))
    n = F.col("source_row")
    full, short = F.concat_ws(",", *text), F.concat_ws(",", *text[:6])
    line = F.when(n % 7 == 3, F.concat(full, F.lit(",,x"))).when(n % 7 == 4, F.concat(full, F.lit(","))) \
        .when(n % 11 == 5, short).otherwise(full)
    return raw.select("source_row", line.alias("value"))


_CSV_KEPT = """csv_rows AS (SELECT * REPLACE ("Air Quality Station Name" || ', "A"' AS "Air Quality Station Name",
    CASE WHEN source_row % 11 = 5 THEN NULL ELSE "Operational Activity Begin" END AS "Operational Activity Begin",
    CASE WHEN source_row % 11 = 5 THEN NULL ELSE "Operational Activity End" END AS "Operational Activity End")
  FROM (SELECT * REPLACE (coalesce("Air Quality Station Name", '') AS "Air Quality Station Name") FROM raw_metadata)
  WHERE source_row % 7 NOT IN (3, 4))"""


@register("csv_row_rule", S.with_ctes([S.RAW_METADATA, _CSV_KEPT], "SELECT " + ", ".join(
    f'"{c}"' for c in _CSV_NAMES) + " FROM csv_rows"))
def q_csv_row_rule(spark, sf):
    """Lines with more fields than the header are skipped, empty ones counted; shorter ones are padded."""
    from aeris.session import scratch_path
    from aeris.sources.csvio import read_csv_discovered
    path = scratch_path(spark, "metadata-lines")
    parts = 4       # files, each with its header first
    lines = _csv_lines(spark, sf).withColumn("part", F.pmod("source_row", F.lit(parts)).cast("int"))
    heads = spark.range(parts).select(F.lit(-1).cast("long").alias("source_row"), F.lit(",".join(_CSV_NAMES)).alias("value"),
                                      F.col("id").cast("int").alias("part"))
    lines.unionByName(heads).repartition(parts, "part").sortWithinPartitions("part", "source_row") \
        .drop("source_row").write.partitionBy("part").text(path)
    like = A.raw_metadata(spark, sf).select(*[f"`{c}`" for c in _CSV_NAMES])
    return _typed_metadata(read_csv_discovered(spark, path), like)


@register("metadata_from_csv", S.with_ctes([S.RAW_METADATA, """m AS (SELECT *, row_number() OVER (
    PARTITION BY "Sampling Point Id" ORDER BY source_row) AS rn FROM raw_metadata)"""], """SELECT "Country" AS country,
  "Air Quality Station Name" AS air_quality_station_name, "Sampling Point Id" AS sampling_point_id, "Latitude" AS latitude,
  "Longitude" AS longitude, "Air Quality Station Area" AS air_quality_station_area,
  "Operational Activity Begin" AS operational_activity_begin, "Operational Activity End" AS operational_activity_end
FROM m WHERE rn = 1"""))
def q_metadata_from_csv(spark, sf):
    """A folder of CSV files of growing size, read and de-duplicated: the first row in the order of files and lines stays
    (Spark itself takes large files first)."""
    from aeris.session import scratch_path
    from aeris.sources.csvio import read_csv_discovered, write_csv
    raw = A.raw_metadata(spark, sf)
    top = raw.agg(F.max("source_row")).first()[0] or 0
    root = scratch_path(spark, "metadata-files")
    part = F.floor(F.sqrt(F.col("source_row") * F.lit(9.0) / F.lit(top + 1)) * 2).cast("int")   # 0 to 5, each larger than the one before
    parts = raw.withColumn("part", part).repartitionByRange(6, "part").sortWithinPartitions("part", "source_row")
    write_csv(parts.drop("part", "source_row"), root)
    clean = M.metadata_dedup(read_csv_discovered(spark, root, row_col=M.ORDER_COL)).drop(M.ORDER_COL)
    return _typed_metadata(clean, M.metadata_select(raw, keep_order=False))


@register("metadata_fallback", S.with_ctes(_META_BASE + [S.COORDS], "SELECT * FROM coords"))
def q_metadata_fallback(spark, sf):
    """All four links of the chain: a local file that is absent, a download that fails, a third source of frames per
    country, one of which fails and one of which is empty, and the typed empty result if nothing resolves."""
    import os
    from aeris.session import scratch_path
    from aeris.sources.csvio import first_non_empty, read_csv_metadata, union_available
    missing = os.path.join(scratch_path(spark, "absent"), "station_metadata_clean.csv")
    raw = A.raw_metadata(spark, sf)

    def local():
        return M.station_coords(read_csv_metadata(spark, missing))

    def downloaded():
        raise ConnectionError("no answer from the metadata service")

    def broken():
        raise ConnectionError("no answer for this country")

    def third():
        odd = F.pmod(F.xxhash64("Country"), F.lit(2)) == 1
        frames = union_available(lambda: raw.where(odd), broken, lambda: raw.limit(0), lambda: raw.where(~odd))
        return M.station_coords(M.metadata_dedup(frames))

    return first_non_empty(local, downloaded, third, lambda: M.empty_coords(spark), default=M.empty_coords(spark))


@register("empty_coords", S.with_ctes(_META_BASE + [S.COORDS], "SELECT * FROM coords WHERE false"))
def q_empty_coords(spark, sf):
    """Metadata without columns for coordinates gives the typed empty dimension; so does a chain of which no link yields."""
    from aeris.sources.csvio import first_non_empty
    no_place = A.raw_metadata(spark, sf).drop("Latitude", "Longitude")
    return first_non_empty(lambda: M.station_coords(no_place), default=M.empty_coords(spark))


# ===================================== streaming ======================================

def _arrivals(spark, sf) -> tuple[str, object]:
    """The landing folder of arriving reading files, written once per session."""
    from aeris.sources.tables import session_folder
    return session_folder(spark, sf, "arrivals", lambda: _write_arrivals(spark, sf))


def _write_arrivals(spark, sf) -> tuple[str, object]:
    """Write the raw readings as successive arrivals (time slices, oldest first).

    Slices span at most the 7-day watermark delay: a micro-batch's watermark is
    at most (end of its slice − 7 days) ≤ start of that slice, so no row of the
    same or a later arrival is ever behind it (it would be dropped as late data,
    correctly, and the result would differ from batch). One write makes all slices; a file stream takes
    files by their time of change, which is then set slice by slice.
    """
    import datetime as dt
    import math
    from aeris.functions.timefmt import ntz_lit
    from aeris.session import scratch_path
    from aeris.sources.daystore import age_files
    raw = A.raw_readings(spark, sf)
    lo, hi = raw.agg(F.min("Start"), F.max("Start")).first()
    parts = max(2, math.ceil((hi - lo) / dt.timedelta(days=7)))
    src = scratch_path(spark, "arrivals")
    step = math.ceil((hi - lo).total_seconds() / parts) or 1
    cut = F.floor(F.timestamp_diff("SECOND", ntz_lit(lo), F.col("Start")) / step).cast("int")
    sliced = raw.withColumn("slice", F.coalesce(cut, F.lit(0)))
    sliced.write.partitionBy("slice").parquet(src)
    age_files(spark, src, "slice")
    return src, sliced.schema


@register("stream_hourly_mean", S.with_ctes([S.RAW_READINGS, S.CLEAN], f"""SELECT country, pollutant,
  {S.short_id('Samplingpoint')} AS station_id, date_trunc('hour', Start) AS hour, round(avg(Value), 6) AS Value,
  count(*) AS n FROM clean GROUP BY ALL"""))
def q_stream_hourly_mean(spark, sf):
    from aeris.session import scratch_path
    from aeris.streaming import hourly as ST
    src, schema = _arrivals(spark, sf)
    sink, ckpt = scratch_path(spark, "hourly-sink"), scratch_path(spark, "hourly-ckpt")
    ST.run_hourly_mean(spark, src, schema, sink, ckpt)
    return ST.latest_per_key(spark, sink).withColumn("Value", r6("Value"))


@register("stream_hourly_final", S.with_ctes([S.RAW_READINGS, S.CLEAN], f"""SELECT * FROM (
  SELECT country, pollutant, {S.short_id('Samplingpoint')} AS station_id, date_trunc('hour', Start) AS hour,
         round(avg(Value), 6) AS Value, count(*) AS n
  FROM clean GROUP BY country, pollutant, {S.short_id('Samplingpoint')}, date_trunc('hour', Start)) h
WHERE h.hour + INTERVAL 1 HOUR <= (SELECT max(Start) FROM clean) - INTERVAL 7 DAY"""))
def q_stream_hourly_final(spark, sf):
    """Append-mode history: only windows closed by the 7-day watermark are written."""
    from aeris.session import scratch_path
    from aeris.streaming import hourly as ST
    src, schema = _arrivals(spark, sf)
    sink, ckpt = scratch_path(spark, "hourly-final"), scratch_path(spark, "hourly-final-ckpt")
    ST.run_hourly_final(spark, src, schema, sink, ckpt)
    return spark.read.parquet(sink).withColumn("Value", r6("Value"))


@register("stream_classify", S.with_ctes(_META_BASE + [S.COORDS, S.RAW_READINGS, S.CLEAN], f"""SELECT r.*,
  {S.short_id('r.Samplingpoint')} AS station_id, {S.label('r.Value', 'r.pollutant')} AS aqi_label,
  c.lat, c.lon, c.station_name
  FROM clean r LEFT JOIN coords c ON c.key = {S.norm_key(S.short_id('r.Samplingpoint'))}"""))
def q_stream_classify(spark, sf):
    from aeris.session import scratch_path
    from aeris.streaming import hourly as ST
    src, schema = _arrivals(spark, sf)
    sink, ckpt = scratch_path(spark, "classify-sink"), scratch_path(spark, "classify-ckpt")
    from aeris.session import materialize
    coords = materialize(_coords(spark, sf), "stream-coords")    # stations as a stored table
    ST.run_classify(spark, src, schema, lambda: coords, sink, ckpt)
    return spark.read.parquet(sink).drop("batch", "slice")


def _redelivered(spark, sf, late: bool) -> list[DataFrame]:
    """Arrivals as a service sends them that is asked again and again: two deliveries of which the second holds
    readings that the first had (every tenth minute) and, with ``late``, readings more than seven days old that
    the first lacked."""
    raw = A.raw_readings(spark, sf).withColumn("_old", F.col("Start") < F.lit(str(A.readings_clock(spark, sf))).cast(
        "timestamp_ntz") - F.expr("INTERVAL 8 DAYS"))
    minute = F.minute("Start") % 10
    held = F.col("_old") & (minute == 3) if late else F.lit(False)
    return [raw.where(~held).drop("_old"), raw.where(held | (minute == 4)).drop("_old")]


def _deliver(delivery: DataFrame, landing: str) -> None:
    delivery.write.mode("append").parquet(landing)


@register("stream_redelivered", S.with_ctes([S.RAW_READINGS, S.CLEAN], f"""SELECT country, pollutant,
  {S.short_id('Samplingpoint')} AS station_id, date_trunc('hour', Start) AS hour, round(avg(Value), 6) AS Value,
  count(*) AS n FROM clean GROUP BY ALL"""))
def q_stream_redelivered(spark, sf):
    """The stream of fresh means, restarted after files that hold readings it has seen: each counts once."""
    from aeris.session import scratch_path
    from aeris.streaming import hourly as ST
    src, sink, ckpt = (scratch_path(spark, f"redelivered-{n}") for n in ("landing", "sink", "ckpt"))
    for delivery in _redelivered(spark, sf, late=False):
        _deliver(delivery, src)
        ST.run_hourly_mean(spark, src, delivery.schema, sink, ckpt, batch_bytes=1 << 62)    # a delivery is one micro-batch
    return ST.latest_per_key(spark, sink).withColumn("Value", r6("Value"))


def _late_history(spark, sf) -> str:
    from aeris.session import scratch_path
    from aeris.sources.tables import session_folder
    from aeris.streaming import history as HI

    def build():
        src, root, ckpt = (scratch_path(spark, f"history-{n}") for n in ("landing", "root", "ckpt"))
        for delivery in _redelivered(spark, sf, late=True):
            _deliver(delivery, src)
            HI.run_history(spark, src, delivery.schema, root, ckpt, batch_bytes=1 << 62)    # a delivery is one micro-batch
        return root
    return session_folder(spark, sf, "late-history", build)


@register("stream_late_history", S.with_ctes([S.RAW_READINGS, S.CLEAN], f"""SELECT country, pollutant,
  {S.short_id('Samplingpoint')} AS station_id, date_trunc('hour', Start) AS hour, round(avg(Value), 6) AS Value,
  count(*) AS n FROM clean GROUP BY ALL"""))
def q_stream_late_history(spark, sf):
    """History after late and repeated readings: the same as one batch over all of them."""
    from aeris.streaming import history as HI
    return HI.history(spark, _late_history(spark, sf)).select(
        "country", "pollutant", "station_id", "hour", r6("Value").alias("Value"), "n")


@register("stream_corrections", S.with_ctes([S.RAW_READINGS, S.CLEAN], f"""SELECT country, pollutant,
  {S.short_id('Samplingpoint')} AS station_id, date_trunc('hour', Start) AS hour, round(sum(Value), 6) AS sum_value,
  count(*) AS n FROM clean
WHERE Start < (SELECT max(ts) FROM events) - INTERVAL 8 DAY AND extract('minute' FROM Start) % 10 = 3 GROUP BY ALL"""))
def q_stream_corrections(spark, sf):
    """What the late readings added to hours that were final."""
    from aeris.streaming import history as HI
    return HI.corrections(spark, _late_history(spark, sf)).withColumn("sum_value", r6("sum_value"))


# ===================================== incremental rollups ============================

def _thirds(df: DataFrame, *by: str) -> list[DataFrame]:
    """Three arrivals that all touch every day."""
    part = F.pmod(F.xxhash64(*by), F.lit(3))
    return [df.where(part == k) for k in range(3)]


@register("rollup_hourly", S.with_ctes([S.RAW_READINGS, S.CLEAN], f"""SELECT country, pollutant,
  {S.short_id('Samplingpoint')} AS station_id, date_trunc('hour', Start) AS hour, round(avg(Value), 6) AS Value,
  count(*) AS n, min(Value) AS min_value, max(Value) AS max_value FROM clean GROUP BY ALL"""))
def q_rollup_hourly(spark, sf):
    """Means per station and hour, merged from three arrivals."""
    from aeris.operators import rollup as R
    from aeris.session import scratch_path
    root = scratch_path(spark, "rollup-hourly")
    for version, arrival in enumerate(_thirds(A.raw_readings(spark, sf), "Samplingpoint", "Start")):
        R.add_readings(arrival, root, version)
    return R.hourly(spark, root).withColumn("Value", r6("Value"))


@register("rollup_daily", S.with_ctes([S.HISTORIC], """SELECT pollutant, CAST("Date" AS DATE) AS "Date",
  round(avg("Value"), 6) AS AvgValue, count("Value") AS n FROM historic WHERE "Value" IS NOT NULL GROUP BY ALL"""))
def q_rollup_daily(spark, sf):
    """Daily means over all stations, merged from three arrivals."""
    from aeris.operators import rollup as R
    from aeris.session import scratch_path
    root = scratch_path(spark, "rollup-daily")
    for version, arrival in enumerate(_thirds(_hist(spark, sf), "Latitude", "Date")):
        R.add_days(arrival, root, version)
    return R.daily(spark, root).withColumn("AvgValue", r6("AvgValue"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}
