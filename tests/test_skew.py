"""A station holding a third of all rows: results equal a brute-force pandas computation."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from aeris.operators import compare as CMP
from aeris.operators import live as L
from aeris.operators import metadata as M


def _readings(n=3000, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0                                   # a third of all rows
        station = "hot" if hot else f"s{rnd.randint(0, 40)}"
        start = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 7 * 24 * 60))
        rows.append(("C", "PM10", station, f"u-{station}", start, float(rnd.randint(0, 300))))
    return rows


def test_hot_station_summary_matches_pandas(spark):
    rows = _readings()
    cols = ["country", "pollutant", "station_name", "url", "Start", "Value"]
    df = spark.createDataFrame(rows, "country string, pollutant string, station_name string, url string, "
                                     "Start timestamp_ntz, Value double").repartition(7)
    got = {r.station_name: r for r in CMP.station_summary(CMP.compare_series(df)).collect()}
    pdf = pd.DataFrame(rows, columns=cols)
    for name, g in pdf.groupby("station_name"):
        worst = g.sort_values(["Value", "Start"], ascending=[False, True]).iloc[0]
        best = g.sort_values(["Value", "Start"], ascending=[True, True]).iloc[0]
        r = got[name]
        assert (r.worst_value, r.worst_start) == (worst.Value, worst.Start.to_pydatetime())
        assert (r.best_value, r.best_start) == (best.Value, best.Start.to_pydatetime())
        assert r.n_readings == len(g)


def test_hot_key_keep_first_and_hourly_mean(spark):
    rows = _readings(seed=5)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "source_row long, country string, pollutant string, station_name string, url string, "
                               "Start timestamp_ntz, Value double").repartition(9)
    first = {r.station_name: r.source_row for r in M.keep_first(df, ["station_name"]).collect()}
    pdf = pd.DataFrame([(i, *r) for i, r in enumerate(rows)],
                       columns=["source_row", "country", "pollutant", "station_name", "url", "Start", "Value"])
    assert first == pdf.groupby("station_name")["source_row"].min().to_dict()
    points = df.withColumn("Samplingpoint", F.col("station_name")).withColumn("url", F.col("station_name"))
    hourly = {(r.station_id, r.hour): (round(r.Value, 9), r.n) for r in L.hourly_means(L.station_hours(points)).collect()}
    pdf["hour"] = pdf["Start"].dt.floor("h")
    ref = pdf.groupby(["station_name", "hour"])["Value"].agg(["mean", "count"])
    assert hourly == {(s, h.to_pydatetime()): (round(m, 9), c) for (s, h), (m, c) in ref.iterrows()}
    assert df.where(F.col("station_name") == "hot").count() == len(rows) // 3


def test_hot_file_join_is_split_by_aqe(spark):
    """readings ⋈ station table on the file key, one file holding a third of the rows:
    with broadcasts off, AQE splits the hot partition (skew join) and the result is exact."""
    rows = _readings(n=6000, seed=3)
    df = spark.createDataFrame(rows, "country string, pollutant string, station_name string, url string, "
                                     "Start timestamp_ntz, Value double") \
        .withColumn("Samplingpoint", F.concat(F.lit("x/"), F.col("station_name"))).drop("station_name")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        coords = spark.createDataFrame([(f"s{i}", 46.0 + i / 10, 7.0, f"Station {i}", "urban") for i in range(41)]
                                       + [("hot", 47.5, 8.5, "Hot station", "urban")],
                                       "key string, lat double, lon double, station_name string, area_type string")
        meta = L.station_meta(df, coords)
        named = L.readings_named(df, meta)
        got = named.groupBy("station_id").count().collect()
        qe = named._jdf.queryExecution()
        qe.toRdd().count()                       # run this very plan, so AQE finalises it
        plan = qe.executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    counts = {r.station_id: r["count"] for r in got}
    assert counts["hot"] == 2000 and sum(counts.values()) == 6000
    assert "skew=true" in plan
