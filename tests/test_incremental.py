"""Days that are merged into: rollups, streams with repeated and late readings, file bounds."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from aeris.operators import rollup as R
from aeris.operators.clean import clean_readings
from aeris.session import scratch_path
from aeris.sources import bounds as B
from aeris.sources import daystore as DS
from aeris.sources import tables as TB
from aeris.streaming import history as HI
from aeris.streaming import hourly as ST

SCHEMA = "country string, pollutant string, Samplingpoint string, Start timestamp_ntz, Value double"


def readings(n, seed, days=12, stations=5):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    out = {}
    for _ in range(n):
        key = ("AT", rng.choice(["NO2", "PM10"]), f"x/S{rng.randrange(stations)}", t0 + dt.timedelta(minutes=rng.randrange(days * 1440)))
        out[key] = (*key, rng.choice([None, float("nan"), -999.0] + [rng.random() * 90 for _ in range(12)]))
    return sorted(out.values(), key=lambda r: r[3])


def batch(rows):
    """Mean and count per station and hour by brute force; equal readings count once."""
    seen = {r[:4]: r[4] for r in rows if r[4] is not None and r[4] == r[4] and r[4] >= 0}
    sums = {}
    for (c, p, s, t), v in seen.items():
        k = (c, p, s.rsplit("/")[-1], t.replace(minute=0, second=0))
        a, n = sums.get(k, (0.0, 0))
        sums[k] = (a + v, n + 1)
    return {k: (round(a / n, 9), n) for k, (a, n) in sums.items()}


def means(df):
    return {tuple(r[:4]): (round(r.Value, 9), r.n) for r in df.select(*R.STATION_HOUR, "Value", "n").collect()}


def files_of(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root.replace("file:", ""))
            for f in names if f.endswith(".parquet") and "_staging" not in d]


def test_rollup_after_any_arrivals_equals_the_full_query(spark):
    rows = readings(400, 1)
    rng = random.Random(2)
    parts = [[] for _ in range(4)]
    for r in rows:
        rng.choice(parts).append(r)
    root = scratch_path(spark, "rollup")
    for k, part in enumerate(parts):
        days = R.add_readings(spark.createDataFrame(part, SCHEMA), root, k)
        assert days == sorted({r[3].date().isoformat() for r in part if r[4] is not None and r[4] == r[4] and r[4] >= 0})
    assert means(R.hourly(spark, root)) == batch(rows)
    one = R.hourly(spark, root, ["2024-01-03"])
    assert {r.hour.date() for r in one.collect()} == {dt.date(2024, 1, 3)}
    low = {tuple(r[:4]): (r.min_value, r.max_value) for r in R.hourly(spark, root).select(*R.STATION_HOUR, "min_value", "max_value").collect()}
    for k, (lo, hi) in low.items():
        mine = [r[4] for r in rows if r[4] is not None and r[4] >= 0 and (r[0], r[1], r[2][2:], r[3].replace(minute=0)) == k]
        assert (lo, hi) == (min(mine), max(mine))


def test_an_update_reads_the_days_it_touches_only(spark, tmp_path):
    root = str(tmp_path / "days")
    rows = readings(300, 3, days=10)
    R.add_readings(spark.createDataFrame(rows, SCHEMA), root, 0)
    before = {p: os.path.getmtime(p) for p in files_of(root)}
    extra = [("AT", "NO2", "x/S9", dt.datetime(2024, 1, 4, 5, 6), 1.0)]
    assert R.add_readings(spark.createDataFrame(extra, SCHEMA), root, 1) == ["2024-01-04"]
    old = DS.read_days(spark, root, R.HOURLY_SCHEMA, ["2024-01-04"], before=1)
    assert len(old.inputFiles()) and all("day=2024-01-04/version=0" in f for f in old.inputFiles())
    assert all(os.path.getmtime(p) == t for p, t in before.items())        # nothing else was written again
    assert means(R.hourly(spark, root)) == batch(rows + extra)


def test_a_repeated_merge_changes_nothing(spark):
    root = scratch_path(spark, "again")
    rows = readings(120, 4, days=3)
    df = spark.createDataFrame(rows, SCHEMA)
    for version in (0, 1, 1, 1):            # the last merge is repeated after a failure
        R.add_readings(df.where(F.minute("Start") % 2 == version), root, version)
    assert means(R.hourly(spark, root)) == batch(rows)


def test_days_hold_at_most_two_versions(spark, tmp_path):
    root = str(tmp_path / "days")
    rows = readings(60, 5, days=2)
    sizes = []
    for k in range(6):
        R.add_readings(spark.createDataFrame([(*r[:3], r[3], r[4]) for r in rows], SCHEMA), root, k)
        sizes.append((sum(len(v) for v in DS.versions(spark, root).values()), len(files_of(root))))
    assert {n for n, _ in sizes[1:]} == {4}
    assert sizes[-1][1] <= sizes[1][1]


def test_empty_arrivals(spark):
    root = scratch_path(spark, "none")
    assert R.add_readings(spark.createDataFrame([], SCHEMA), root, 0) == []
    assert R.hourly(spark, root).count() == 0 and R.hourly(spark, root).columns[:4] == R.STATION_HOUR


def deliver(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def test_a_reading_delivered_twice_counts_once(spark):
    src, sink, ckpt = (scratch_path(spark, f"twice-{n}") for n in ("src", "sink", "ckpt"))
    two = [("AT", "NO2", "x/A", dt.datetime(2024, 1, 1, 10, 5), 4.0), ("AT", "NO2", "x/A", dt.datetime(2024, 1, 1, 10, 25), 8.0)]
    deliver(spark, src, two)
    ST.run_hourly_mean(spark, src, SCHEMA, sink, ckpt)
    deliver(spark, src, two[1:])                     # fetched again, and again after a restart
    ST.run_hourly_mean(spark, src, SCHEMA, sink, ckpt)
    deliver(spark, src, two)
    ST.run_hourly_mean(spark, src, SCHEMA, sink, ckpt)
    assert means(ST.latest_per_key(spark, sink)) == {("AT", "NO2", "A", dt.datetime(2024, 1, 1, 10)): (6.0, 2)}


def test_overlapping_deliveries_equal_batch_and_the_sink_stays_small(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    rows = readings(300, 6, days=5)
    sizes = []
    for k in range(5):                                # each delivery holds the last two days again
        lo, hi = dt.datetime(2024, 1, 1) + dt.timedelta(days=k - 1), dt.datetime(2024, 1, 1) + dt.timedelta(days=k + 1)
        deliver(spark, src, [r for r in rows if lo <= r[3] < hi])
        ST.run_hourly_mean(spark, src, SCHEMA, sink, ckpt)
        sizes.append(max(len(v) for v in DS.versions(spark, sink).values()))
    assert means(ST.latest_per_key(spark, sink)) == batch(rows)
    assert max(sizes) <= 2


def test_final_history_counts_repeated_readings_once(spark):
    src, sink, ckpt = (scratch_path(spark, f"final-{n}") for n in ("src", "sink", "ckpt"))
    rows = readings(200, 7, days=12)
    for part in (rows, rows[100:], [("AT", "NO2", "x/Z", dt.datetime(2024, 2, 1), 1.0)]):
        deliver(spark, src, part)
        ST.run_hourly_final(spark, src, SCHEMA, sink, ckpt)
    got = {tuple(r[:4]): (round(r.Value, 9), r.n) for r in spark.read.parquet(sink).select(*ST.KEY, "Value", "n").collect()}
    assert got == batch(rows)


def test_history_with_late_and_repeated_readings_equals_batch(spark):
    src, root, ckpt = (scratch_path(spark, f"late-{n}") for n in ("src", "root", "ckpt"))
    rows = readings(400, 8, days=30)
    late = [r for r in rows if r[3] < dt.datetime(2024, 1, 15) and r[3].minute % 3 == 0]
    first = [r for r in rows if r not in late]
    for part in (first, late + first[::5], late[::2], rows):      # late, repeated late, all again
        deliver(spark, src, part)
        HI.run_history(spark, src, SCHEMA, root, ckpt)
    assert means(HI.history(spark, root)) == batch(rows)
    fixed = {tuple(r[:4]): (round(r.sum_value / r.n, 9), r.n) for r in HI.corrections(spark, root).collect()}
    assert fixed == batch(late)


def test_history_takes_a_repeated_micro_batch_as_one(spark):
    root = scratch_path(spark, "batches")
    rows = readings(150, 9, days=4)
    for batch_id, part in ((0, rows[:60]), (1, rows[40:120]), (1, rows[40:120]), (2, rows[100:])):
        HI.add_batch(spark.createDataFrame(part, SCHEMA), root, batch_id)
    assert means(HI.history(spark, root)) == batch(rows)
    assert HI.corrections(spark, root).count() == 0
    HI.add_batch(spark.createDataFrame([], SCHEMA), root, 3)
    assert means(HI.history(spark, root)) == batch(rows)


def test_history_writes_a_batch_once(spark):
    """Known readings are left out by the grouping that gives each reading once; what is stored is not staged again."""
    root = scratch_path(spark, "once")
    rows = readings(200, 10, days=9)
    rows += [(None, "NO2", "x/N", rows[0][3], 1.0), ("AT", None, "x/N", rows[0][3], 2.0)]       # null keys are keys
    for batch_id, part in enumerate((rows + rows[:50], rows[100:])):
        HI.add_batch(spark.createDataFrame(part, SCHEMA), root, batch_id)
    assert means(HI.history(spark, root)) == batch(rows)
    assert sum(n for _, n in means(HI.history(spark, root)).values()) == len({r[:4] for r in rows if r[4] is not None and r[4] >= 0})
    stored = {d for d, _, names in os.walk(root.removeprefix("file:")) if any(n.endswith(".parquet") for n in names)}
    assert not [d for d in stored if "_incoming" in d or ("_staging" in d and "/clock/" not in d)]


def test_a_merge_of_stations_shuffles_once(spark):
    clean = clean_readings(spark.createDataFrame(readings(50, 11), SCHEMA))
    out = R.merged(R.station_hour_states(clean), R.reading_states(clean)).withColumn("version", F.lit(1))
    plan = out.repartition(F.col(DS.DAY), F.col(R.STATION))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Union")[0]
    assert above.count("Exchange") == 1 and "HashAggregate" in above


def test_classify_finds_stations_added_meanwhile_and_repeats_nothing(spark):
    src, sink, ckpt, dim = (scratch_path(spark, f"classify-{n}") for n in ("src", "sink", "ckpt", "dim"))
    kind = "key string, lat double, lon double, station_name string"
    spark.createDataFrame([("a", 1.0, 2.0, "A")], kind).write.parquet(dim)
    coords = lambda: spark.read.schema(kind).parquet(dim)     # noqa: E731
    day = dt.datetime(2024, 1, 1, 10)
    deliver(spark, src, [("AT", "NO2", "x/A", day, 4.0), ("AT", "NO2", "x/B", day, 4.0)])
    ST.run_classify(spark, src, SCHEMA, coords, sink, ckpt)
    spark.createDataFrame([("b", 3.0, 4.0, "B")], kind).write.mode("append").parquet(dim)
    deliver(spark, src, [("AT", "NO2", "x/A", day, 4.0), ("AT", "NO2", "x/B", day + dt.timedelta(hours=1), 4.0)])
    ST.run_classify(spark, src, SCHEMA, coords, sink, ckpt)
    got = sorted((r.station_id, r.Start.hour, r.lat) for r in spark.read.parquet(sink).collect())
    assert got == [("A", 10, 1.0), ("B", 10, None), ("B", 11, 3.0)]


def test_bounds_scan_new_files_only(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    spark.range(0, 100).selectExpr("id").repartition(3).write.parquet(data)
    assert B.bounds(spark, data, "id", store) == (0, 99)
    known = {r.path: (r.lo, r.hi) for r in B.file_bounds(spark, data, "id", store).collect()}
    for f in files_of(data):                          # old files are not read again: they could not be
        size, stamp = os.path.getsize(f), os.stat(f).st_mtime_ns
        open(f, "wb").write(b"\0" * size)
        os.utime(f, ns=(stamp, stamp))
    extra = str(tmp_path / "extra")
    spark.range(500, 600).selectExpr("id").coalesce(1).write.parquet(extra)
    new = files_of(extra)[0]
    os.link(new, os.path.join(data, "part-new.parquet"))
    assert B.bounds(spark, data, "id", store) == (0, 599)
    assert len(B.file_bounds(spark, data, "id", store).collect()) == len(known) + 1
    for f in files_of(data):
        if not f.endswith("part-new.parquet"):
            os.remove(f)
    assert B.bounds(spark, data, "id", store) == (500, 599)       # deleted files don't count


def test_new_files_move_the_live_window_without_a_refresh(spark, tmp_path):
    from aeris.plans import catalog
    from aeris.sources import adapters as A
    small = "/root/testdata/sf0.001"
    for name in TB.READINGS:
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    run = catalog.queries()["filter_last_7d"]
    first = run(spark, sf)
    clock = A.readings_clock(spark, sf)
    rows = first.count()
    assert rows == run(spark, small).count()
    late = spark.read.parquet(f"{small}/events.parquet").limit(40).withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS")) \
        .withColumn("event_id", F.lit(1).cast("long"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert A.readings_clock(spark, sf) > clock + dt.timedelta(days=300)
    after = run(spark, sf)
    assert 0 < after.count() <= 40
    plan = after._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == first._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("rows", [0, 7])
def test_partials_of_small_inputs(spark, rows):
    df = clean_readings(spark.createDataFrame(readings(rows, 11) if rows else [], SCHEMA))
    assert R.station_hour_states(df).schema.fieldNames() == R.HOURLY_SCHEMA.fieldNames()
