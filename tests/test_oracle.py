"""Every registered query against its DuckDB oracle, on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from aeris.plans import catalog
from aeris.sources.tables import TABLES

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    rows, cols = df.collect(), df.columns
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    duck_types = {d[0]: str(d[1]) for d in res.description}
    assert {c: _TYPES.get(t, t) for c, t in df.dtypes} == duck_types
    assert _canon(cols, rows) == _canon(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "aqi_label" in df.columns


ZONE_SENSITIVE = ["parse_time", "filter_last_7d", "hourly_mean", "hour_view", "hour_frames_all",
                  "frame_index", "format_time", "station_summary", "map_frames_all", "stream_hourly_mean",
                  "hour_view_at", "hour_bounds", "stream_hourly_final", "filter_year", "hour_spine"]


@pytest.mark.parametrize("name", ZONE_SENSITIVE)
def test_results_do_not_depend_on_session_zone(spark, duck, sf_small, name):
    """Wall-clock semantics: a session in a daylight-saving zone gives the same rows."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = QUERIES[name](spark, sf_small)
        rows, cols = df.collect(), df.columns
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    res = duck.execute(ORACLE[name])
    assert _canon(cols, rows) == _canon([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_results_without_size_based_broadcasts(spark, duck, sf_small, name):
    """The large-input plan shape (shuffle joins wherever a side is not provably
    small) gives the same rows as the oracle."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        df = QUERIES[name](spark, sf_small)
        rows, cols = df.collect(), df.columns
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    res = duck.execute(ORACLE[name])
    assert _canon(cols, rows) == _canon([d[0] for d in res.description], res.fetchall())
