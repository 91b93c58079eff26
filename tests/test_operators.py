"""Operator behaviour on literal frames: ties, duplicates, CSV rows, manifests, coords."""

import datetime as dt
import os

from pyspark.sql import functions as F

from aeris.operators import compare as CMP
from aeris.operators import metadata as M
from aeris.session import scratch_path
from aeris.sources import csvio
from aeris.sources import files as FS


def test_summary_ties(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("C", "PM10", "s1", t(3), 50.0), ("C", "PM10", "s1", t(1), 50.0), ("C", "PM10", "s1", t(2), 5.0),
            ("C", "PM10", "s1", t(4), 5.0)]
    df = spark.createDataFrame(rows, "country string, pollutant string, station_name string, Start timestamp_ntz, Value double")
    s = CMP.station_summary(CMP.compare_series(df)).first()
    assert s.worst_start == t(1) and s.worst_value == 50.0      # equal maxima → earlier time
    assert s.best_start == t(2) and s.best_value == 5.0
    assert s.dominant == "Good"                                  # 2 Good vs 2 Moderate → lower tier
    assert s.worst_label == "Moderate" and s.worst_value_text == "50.0"


def test_keep_first_is_order_independent(spark):
    rows = [(k % 7 if k % 11 else None, k, f"v{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "key int, source_row int, v string")
    a = sorted(M.keep_first(df, ["key"]).collect(), key=repr)
    b = sorted(M.keep_first(df.repartition(13).orderBy(F.rand(3)), ["key"]).collect(), key=repr)
    assert a == b
    assert len(a) == 8                                            # 7 keys + one null key
    assert {r.key: r.source_row for r in a}[3] == 3


def test_csv_row_rule_and_dialect(spark):
    d = scratch_path(spark, "csvtest")
    os.makedirs(d)
    with open(os.path.join(d, "m.csv"), "w", encoding="latin-1") as fh:
        fh.write("a;b;c;d\n1;2;3;4\n5;6\n7;8;9;10;11\n12;13;14;15\n")
    enc, sep = csvio.discover_dialect(spark, d)
    assert sep == ";"
    got = [tuple(r) for r in csvio.read_csv_metadata(spark, d, sep=sep, encoding=enc).collect()]
    assert got == [("1", "2", "3", "4"), ("5", "6", None, None), ("12", "13", "14", "15")]


def test_manifest_parsing(spark):
    d = scratch_path(spark, "manifest")
    os.makedirs(d)
    with open(os.path.join(d, "urls.txt"), "w") as fh:
        fh.write("ParquetFileUrl\n\n   /data/b.parquet  \n\n/data/a.parquet\n")
    e = FS.manifest_entries(spark, d)
    assert [r.path for r in e.orderBy("pos").collect()] == ["/data/b.parquet", "/data/a.parquet"]
    assert FS.manifest_first(e).first().path == "/data/b.parquet"


def test_coords_resolution_and_typed_empty(spark):
    df = spark.createDataFrame(
        [("SPO-1", "47.1", "8.5", " Zurich ", "Urban"), ("spo-1", "1", "1", "dup", "rural"),
         ("SPO-2", None, "1", "x", "rural"), ("SPO-3", "46", "7", None, None)],
        "`﻿SamplingPoint-LocalId` string, `Site Latitude` string, `Site Longitude` string, "
        "`Station Name` string, `Area` string")
    got = sorted(tuple(r) for r in M.station_coords(df).collect())
    assert [g[0] for g in got] == ["spo-1", "spo-3"]
    assert got[0][1:] in [(47.1, 8.5, "Zurich", "urban"), (1.0, 1.0, "dup", "rural")]
    assert got[1][3] is None and got[1][4] is None                 # missing name/area stay null
    no_lat = spark.createDataFrame([("SPO-1", "8.5")], "samplingpoint string, lon string")
    empty = M.station_coords(no_lat)
    assert empty.count() == 0 and empty.columns == ["key", "lat", "lon", "station_name", "area_type"]


def test_first_non_empty(spark):
    empty = spark.createDataFrame([], "a int")
    full = spark.createDataFrame([(1,)], "a int")
    def broken():
        raise IOError("source down")
    assert csvio.first_non_empty(broken, empty, lambda: full).first().a == 1
    assert csvio.first_non_empty(empty) is None


def test_map_payload_sink_roundtrip(spark, sf_small):
    import json
    import __spark_entry__ as entry
    from aeris.operators import publish as P
    payload = entry.queries()["map_payload"](spark, sf_small)
    path = P.write_map_payload(payload, scratch_path(spark, "payload"))
    lines = spark.read.text(path)
    assert lines.count() == payload.count()
    first = json.loads(lines.first().value)
    assert list(first) == P.PAYLOAD_COLUMNS                      # fixed field order, nulls kept
    assert set(r.bucket for r in spark.read.text(path).select("bucket").distinct().collect()) <= {"urban", "suburban", "rural"}


def test_gzip_csv_discovery(spark):
    d = scratch_path(spark, "gzcsv")
    df = spark.createDataFrame([("a", "1", "2", "3"), ("b", "4", "5", "6")], "w string, x string, y string, z string")
    df.write.option("header", "true").option("sep", "|").option("compression", "gzip").csv(d)
    found = csvio.read_csv_discovered(spark, d)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "1", "2", "3"), ("b", "4", "5", "6")]


def test_legend_and_bands(spark):
    from aeris.functions import eaqi
    from aeris.operators import publish as P
    pols = spark.createDataFrame([("PM2.5",), ("SO2",)], "pollutant string")
    got = {(r.pollutant, r.tier): (r.label, r.range_text) for r in P.legend(pols, eaqi.eaqi_dim(spark)).collect()}
    assert got[("PM2.5", 1)] == ("Good", "0–5")
    assert got[("PM2.5", 6)] == ("Extremely poor", "140+")
    assert got[("SO2", 2)] == ("Fair", "15–45")                 # unknown pollutant → PM10 table
    named = spark.createDataFrame([("C", "PM2.5", 20.0)], "country string, pollutant string, Value double")
    bands = sorted((r.tier, r.y1, r.y2) for r in CMP.chart_bands(named, eaqi.eaqi_dim(spark)).collect())
    # y_max = max(20 × 1.15, 15 + 1) = 23: bands 0–5, 5–15, 15–23; the rest start above y_max
    assert [b[0] for b in bands] == [1, 2, 3] and bands[-1][2] == 20.0 * 1.15


def test_scan_nanosecond_parquet(spark):
    """Files as pandas writes them: Start as Parquet TIMESTAMP(NANOS), Value as text."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    d = scratch_path(spark, "nanos")
    part = os.path.join(d, "country=CH", "pollutant=NO2")
    os.makedirs(part)
    pdf = pd.DataFrame({"Samplingpoint": ["CH/SPO-1", "CH/SPO-1"],
                        "Start": pd.to_datetime([1546300800123456789, 1546304400000000000], unit="ns"),
                        "Value": [12.5, -999.0]})
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    assert str(table.schema.field("Start").type) == "timestamp[ns]"
    pq.write_table(table, os.path.join(part, "a.parquet"), version="2.6")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        rows = FS.scan_readings(spark, d, start_type="nanos").orderBy("Start").collect()
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert [r.Start for r in rows] == [dt.datetime(2019, 1, 1, 0, 0, 0, 123456), dt.datetime(2019, 1, 1, 1, 0)]
    assert rows[0].country == "CH" and rows[0].Value == 12.5


def test_hour_view_fallback_and_styling(spark):
    from aeris.operators import live as L
    t = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    rows = [  # country, pollutant, url, Samplingpoint, Start, Value
        ("C", "PM10", "u1", "x/SPO-1", t(5, 10), 10.0), ("C", "PM10", "u1", "x/SPO-1", t(5, 12, 5), 40.0),
        ("C", "PM10", "u1", "x/SPO-1", t(5, 12, 45), 60.0),
        ("C", "PM10", "u2", "x/SPO-2", t(5, 9), 0.0),          # no reading in the last hour → 7-day mean 0
        ("C", "PM10", "u3", "x/SPO-3", t(5, 12), 30.0),        # no coordinates → dropped from the map
        ("C", "PM10", "u4", "x/SPO-4", t(1, 0), 99.0),         # older than 7 days → outside the window
        ("C", "PM10", "u4", "x/SPO-4", t(5, 11), -999.0),      # sentinel → removed
    ]
    raw = spark.createDataFrame(rows, "country string, pollutant string, url string, Samplingpoint string, "
                                      "Start timestamp_ntz, Value double")
    coords = spark.createDataFrame([("spo-1", 47.0, 8.0, "One", "urban"), ("spo-2", 46.0, 7.0, None, None)],
                                   "key string, lat double, lon double, station_name string, area_type string")
    recent = L.recent_readings(raw, as_of="2024-01-05 13:00:00")
    view = {r.station_id: r for r in L.live_view(recent, coords).collect()}
    assert set(view) == {"SPO-1", "SPO-2"}
    one, two = view["SPO-1"], view["SPO-2"]
    assert (one.Value, one.is_fallback, one.aqi_label, one.color_a, one.value_str) == (50.0, False, "Moderate", 220, "50.00")
    assert (two.Value, two.is_fallback, two.aqi_label, two.color_a) == (0.0, True, "No data", 0)
    assert (two.station_name, two.area_type, two.symbol) == ("SPO-2", "unknown", "●")   # fallbacks


def test_manifest_to_nanosecond_files(spark):
    """Manifest of pandas-written files → one scan, times parsed to wall clock."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    root = scratch_path(spark, "landing")
    paths = []
    for country, sp, ns in (("CH", "SPO-1", 1546300800000000000), ("DE", "SPO-2", 1546304400000000000)):
        part = os.path.join(root, f"country={country}", "pollutant=NO2")
        os.makedirs(part)
        pdf = pd.DataFrame({"Samplingpoint": [f"{country}/{sp}"], "Start": pd.to_datetime([ns], unit="ns"),
                            "Value": ["17.5"]})
        path = os.path.join(part, f"{sp}.parquet")
        pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), path, version="2.6")
        paths.append(path)
    man = scratch_path(spark, "manifest")
    os.makedirs(man)
    with open(os.path.join(man, "urls.txt"), "w") as fh:
        fh.write("ParquetFileUrl\n" + "\n".join(f"  {p} " for p in paths) + "\n\n")
    entries = FS.manifest_entries(spark, man)
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        rows = FS.read_manifest(spark, entries, base_path=root, start_type="nanos", value_type="text") \
            .orderBy("Start").collect()
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert [(r.country, r.Start, r.Value) for r in rows] == [
        ("CH", dt.datetime(2019, 1, 1, 0, 0), 17.5), ("DE", dt.datetime(2019, 1, 1, 1, 0), 17.5)]


def test_utf16_and_latin1_csv_discovery(spark):
    for enc, expect in (("utf-16", "utf-16"), ("latin-1", "latin-1")):
        d = scratch_path(spark, f"csv-{enc}")
        os.makedirs(d)
        with open(os.path.join(d, "m.csv"), "w", encoding=enc) as fh:
            fh.write("Sampling Point Id;Latitude;Longitude;Air Quality Station Name\n"
                     "SPO-1;47.1;8.5;Zürich\nSPO-2;46.0;7.0;Genève\n")
        assert csvio.discover_dialect(spark, d) == (expect, ";")
        rows = sorted(tuple(r) for r in csvio.read_csv_discovered(spark, d).collect())
        assert rows == [("SPO-1", "47.1", "8.5", "Zürich"), ("SPO-2", "46.0", "7.0", "Genève")]


def test_stored_historic_prunes_and_pushes(spark, sf_small):
    from aeris.operators import historic as H
    from aeris.sources import adapters as A
    hist = A.historic(spark, sf_small)
    root = FS.write_historic(hist, scratch_path(spark, "historic-test"))
    routed = H.daily_average(H.route_pollutant(FS.scan_historic(spark, root), "PM2.5"), "1997-01-01", "1997-12-31")
    qe = routed._jdf.queryExecution()
    qe.toRdd().count()
    plan = qe.executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pollutant" in plan and "(pollutant" in plan
    assert "GreaterThanOrEqual(Date,1997-01-01" in plan
    expected = H.daily_average(H.route_pollutant(hist, "PM2.5"), "1997-01-01", "1997-12-31")
    assert sorted(routed.collect(), key=repr) == sorted(expected.collect(), key=repr)
