"""Stream = batch, including a restart from the checkpoint between arrivals."""

import pytest
from pyspark.sql import functions as F

from aeris.functions.keys import short_id
from aeris.functions.timefmt import floor_hour, ntz_lit
from aeris.operators.clean import clean_readings
from aeris.session import scratch_path
from aeris.sources import adapters as A
from aeris.sources import daystore as DS
from aeris.streaming import hourly as ST


def test_hourly_stream_resumes_and_equals_batch(spark, sf_small):
    raw = A.raw_readings(spark, sf_small)
    src = scratch_path(spark, "arrivals")
    sink, ckpt = scratch_path(spark, "sink"), scratch_path(spark, "ckpt")
    mid = raw.agg(F.min("Start") + (F.max("Start") - F.min("Start")) / 2).first()[0]
    raw.where(F.col("Start") < ntz_lit(mid)).write.parquet(src)
    ST.run_hourly_mean(spark, src, raw.schema, sink, ckpt)          # first arrival
    raw.where(F.col("Start") >= ntz_lit(mid)).write.mode("append").parquet(src)
    ST.run_hourly_mean(spark, src, raw.schema, sink, ckpt)          # restart: resumes from checkpoint
    got = ST.latest_per_key(spark, sink)
    batch = (clean_readings(raw).groupBy("country", "pollutant",
                                         short_id(F.col("Samplingpoint")).alias("station_id"),
                                         floor_hour(F.col("Start")).alias("hour"))
             .agg(F.avg("Value").alias("Value"), F.count(F.lit(1)).alias("n")))
    g = {tuple(r[:4]): (round(r.Value, 9), r.n) for r in got.collect()}
    b = {tuple(r[:4]): (round(r.Value, 9), r.n) for r in batch.collect()}
    assert g == b
    assert {len(v) for v in DS.versions(spark, sink).values()} <= {1, 2}      # no version per batch


def test_late_rows_are_counted(spark):
    import datetime as dt
    from aeris.session import scratch_path
    from aeris.streaming import hourly as ST
    schema = "country string, pollutant string, Samplingpoint string, Start timestamp_ntz, Value double"
    src, sink, ckpt = (scratch_path(spark, n) for n in ("late-src", "late-sink", "late-ckpt"))

    def arrive(day):
        spark.createDataFrame([("AT", "NO2", "x/A", dt.datetime(2024, 1, day), 1.0)], schema).write.mode("append").parquet(src)
        return ST.run_hourly_mean(spark, src, schema, sink, ckpt)

    assert arrive(20) == 0 and arrive(15) == 0          # five days late: kept
    with pytest.warns(UserWarning, match="1 rows arrived"):
        assert arrive(2) == 1                            # beyond the watermark: dropped and reported
    assert ST.latest_per_key(spark, sink).count() == 2
