"""DuckDB SQL fragments for the oracle: adapters as CTEs and scalar rules.

The fragments restate the adapter rules (FIXTURES.md §3) and the index
rules independently of the Spark code, from the same fixed values.
"""

from __future__ import annotations

from aeris.functions.eaqi import COLOURS, DEFAULT_POLLUTANT, LABELS, THRESHOLDS
from aeris.operators.live import AREA_SYMBOLS, DEFAULT_SYMBOL

TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def trim_all(x: str) -> str:
    return TRIM.format(x=x)


def short_id(x: str) -> str:
    return f"string_split({trim_all(x)}, '/')[-1]"


def norm_key(x: str) -> str:
    return f"lower({trim_all(x)})"


def valid(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT isnan({v}) AND {v} >= 0)"


def tier(v: str, p: str) -> str:
    def chain(uppers):
        parts = " ".join(f"WHEN {v} <= {u} THEN {i}" for i, u in enumerate(uppers[:-1], start=1))
        return f"CASE {parts} ELSE {len(uppers)} END"
    whens = " ".join(f"WHEN {p} = '{name}' THEN {chain(u)}" for name, u in THRESHOLDS.items())
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) OR {v} < 0 THEN NULL "
            f"{whens} ELSE {chain(THRESHOLDS[DEFAULT_POLLUTANT])} END)")


def label(v: str, p: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate(LABELS, start=1))
    return f"(CASE {tier(v, p)} {whens} END)"


def colour_of(lab: str) -> str:
    whens = " ".join(f"WHEN {lab} = '{l}' THEN '{c}'" for l, c in zip(LABELS, COLOURS))
    return f"(CASE {whens} ELSE '#888' END)"


def order_of(lab: str) -> str:
    whens = " ".join(f"WHEN {lab} = '{l}' THEN {i}" for i, l in enumerate(LABELS + ['Unknown']))
    return f"(CASE {whens} ELSE 99 END)"


def style(v: str, p: str) -> str:
    """aqi_label, color_r/g/b/a of the map style rule."""
    has = f"({v} IS NOT NULL AND NOT isnan({v}) AND {v} > 0)"
    lab = label(v, p)
    rgb = {l: tuple(int(c[i:i + 2], 16) for i in (1, 3, 5)) for l, c in zip(LABELS, COLOURS)}
    cols = [f"CASE WHEN {has} THEN {lab} ELSE 'No data' END AS aqi_label"]
    for ch, name in enumerate(("color_r", "color_g", "color_b")):
        whens = " ".join(f"WHEN '{l}' THEN {rgb[l][ch]}" for l in LABELS)
        cols.append(f"CASE WHEN {has} THEN (CASE {lab} {whens} END) ELSE 128 END AS {name}")
    cols.append(f"CASE WHEN {has} THEN 220 ELSE 0 END AS color_a")
    return ", ".join(cols)


def symbol(area: str) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in AREA_SYMBOLS)
    return f"coalesce(CASE lower({area}) {whens} END, '{DEFAULT_SYMBOL}')"


def decimals(v: str, d: int, missing: str | None = "N/A") -> str:
    txt = f"CAST(CAST(CAST({v} AS DECIMAL(18,6)) AS DECIMAL(18,{d})) AS VARCHAR)"
    miss = f"'{missing}'" if missing is not None else "NULL"
    return f"(CASE WHEN {v} IS NULL OR isnan({v}) THEN {miss} ELSE {txt} END)"


def effective(p: str) -> str:
    names = ", ".join(f"'{n}'" for n in THRESHOLDS)
    return f"(CASE WHEN {p} IN ({names}) THEN {p} ELSE '{DEFAULT_POLLUTANT}' END)"


def dim_values() -> str:
    rows = []
    for pollutant, uppers in THRESHOLDS.items():
        lower = 0.0
        for t, (u, l, c) in enumerate(zip(uppers, LABELS, COLOURS), start=1):
            up = "'inf'::DOUBLE" if u == float("inf") else f"{float(u)}::DOUBLE"
            rows.append(f"('{pollutant}', {t}, {float(lower)}::DOUBLE, {up}, '{l}', '{c}')")
            lower = float(u)
    return ("eaqi AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") v(pollutant, tier, lower, upper, label, colour))")


RAW_READINGS = """raw_readings AS (
  SELECT country, pollutant,
         'http://aq/' || country || '/' || pollutant || '/' || sp || '.parquet' AS url,
         'http://aq/' || country || '/' || sp AS Samplingpoint, Start, Value
  FROM (SELECT n.n_name AS country,
               CASE e.event_type WHEN 'error' THEN 'PM10' WHEN 'signup' THEN 'PM2.5'
                    WHEN 'click' THEN 'NO2' WHEN 'view' THEN 'O3' WHEN 'purchase' THEN 'SO2'
                    ELSE e.event_type END AS pollutant,
               printf('SPO-%05d', e.user_id) AS sp,
               e.ts AS Start,
               CASE WHEN e.event_id % 50 = 7 THEN CAST(-999 AS DOUBLE)
                    WHEN e.event_id % 53 = 7 THEN CAST(NULL AS DOUBLE)
                    WHEN e.event_id % 59 = 7 THEN CAST('NaN' AS DOUBLE)
                    WHEN e.event_id % 61 = 7 THEN CAST(0 AS DOUBLE)
                    ELSE e.value END AS Value
        FROM events e JOIN customer c ON e.user_id = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey) t)"""

CLEAN = """clean AS (SELECT * FROM raw_readings WHERE Start IS NOT NULL AND """ + valid("Value") + ")"

RECENT = """recent AS (SELECT * FROM clean
  WHERE Start >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)"""

HISTORIC = """historic AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'PM2.5' ELSE 'PM10' END AS pollutant,
         l_shipdate AS "Date",
         CASE WHEN l_orderkey % 97 = 5 THEN CAST(NULL AS DOUBLE) ELSE (l_quantity - 3) * 6 END AS "Value",
         CASE WHEN l_suppkey % 17 = 4 THEN CAST(NULL AS DOUBLE)
              ELSE 36.0::DOUBLE + CAST(l_suppkey * 37 % 2400 AS DOUBLE) / 100.0::DOUBLE END AS "Latitude",
         CASE WHEN l_suppkey % 17 = 4 THEN CAST(NULL AS DOUBLE)
              ELSE -9.0::DOUBLE + CAST(l_suppkey * 53 % 3300 AS DOUBLE) / 100.0::DOUBLE END AS "Longitude"
  FROM lineitem)"""

RAW_METADATA = """raw_metadata AS (
  SELECT n.n_name AS "Country",
         CASE WHEN c.c_custkey % 19 = 3 THEN CAST(NULL AS VARCHAR) ELSE c.c_name END AS "Air Quality Station Name",
         CASE WHEN c.c_custkey % 5 = 0 THEN '  ' || lower(printf('SPO-%05d', c.c_custkey)) || ' '
              ELSE printf('SPO-%05d', c.c_custkey) END AS "Sampling Point Id",
         CASE WHEN c.c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE)
              ELSE 36.0::DOUBLE + CAST(c.c_custkey * 41 % 2400 AS DOUBLE) / 100.0::DOUBLE END AS "Latitude",
         CASE WHEN c.c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE)
              ELSE -9.0::DOUBLE + CAST(c.c_custkey * 59 % 3300 AS DOUBLE) / 100.0::DOUBLE END AS "Longitude",
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'urban' WHEN 'HOUSEHOLD' THEN 'suburban'
              WHEN 'FURNITURE' THEN 'rural' WHEN 'MACHINERY' THEN 'rural-nearcity' END AS "Air Quality Station Area",
         DATE '2010-01-01' AS "Operational Activity Begin",
         CASE WHEN (c.c_custkey + p.copy) % 2 = 0 THEN CAST(NULL AS DATE) ELSE DATE '2030-12-31' END
              AS "Operational Activity End",
         p.pol AS "Air Pollutant",
         c.c_custkey * 3 + p.copy AS source_row
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  CROSS JOIN (VALUES (0, 'PM10'), (1, 'PM2.5'), (2, 'NO2')) p(copy, pol)
  WHERE c.c_custkey % 13 <> 5)"""

META_SELECT = """meta_sel AS (
  SELECT "Country" AS country, "Air Quality Station Name" AS air_quality_station_name,
         "Sampling Point Id" AS sampling_point_id, "Latitude" AS latitude, "Longitude" AS longitude,
         "Air Quality Station Area" AS air_quality_station_area,
         "Operational Activity Begin" AS operational_activity_begin,
         "Operational Activity End" AS operational_activity_end, source_row
  FROM raw_metadata)"""

META_CLEAN = """meta_clean AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY sampling_point_id ORDER BY source_row) AS rn FROM meta_sel)
  WHERE rn = 1)"""

COORDS = ("""coords0 AS (
  SELECT """ + norm_key(short_id(trim_all("sampling_point_id"))) + """ AS key,
         TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon,
         """ + trim_all("air_quality_station_name") + """ AS station_name,
         lower(""" + trim_all("air_quality_station_area") + """) AS area_type, source_row
  FROM meta_clean),
coords AS (
  SELECT key, lat, lon, station_name, area_type FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_row) AS rn FROM coords0
    WHERE lat IS NOT NULL AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon))
  WHERE rn = 1)""")

FILES = """files AS (
  SELECT country, pollutant, url, Value, """ + short_id("coalesce(sp, url)") + """ AS station_id FROM (
    SELECT country, pollutant, url, avg(Value) AS Value, arg_min(Samplingpoint, Start) AS sp
    FROM recent GROUP BY country, pollutant, url))"""

META = """meta AS (
  SELECT f.country, f.pollutant, f.station_id, f.url, f.Value, c.lat, c.lon,
         coalesce(c.station_name, f.station_id) AS station_name,
         coalesce(c.area_type, 'unknown') AS area_type
  FROM files f LEFT JOIN coords c ON """ + norm_key("f.station_id") + """ = c.key)"""

NAMED = """named AS (
  SELECT r.country, r.pollutant, m.station_id, m.station_name, r.Start, r.Value
  FROM recent r LEFT JOIN meta m ON r.country = m.country AND r.pollutant = m.pollutant AND r.url = m.url)"""

HOURLY = """hourly AS (
  SELECT country, pollutant, station_id, date_trunc('hour', Start) AS hour, avg(Value) AS Value, count(*) AS n
  FROM named GROUP BY country, pollutant, station_id, date_trunc('hour', Start))"""

LIVE = [RAW_READINGS, CLEAN, RECENT, RAW_METADATA, META_SELECT, META_CLEAN, COORDS, FILES, META, NAMED]


def with_ctes(ctes: list[str], body: str) -> str:
    """``WITH`` the given CTEs, then ``body`` — which may itself start with more CTEs."""
    sep = "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(ctes) + sep + body
