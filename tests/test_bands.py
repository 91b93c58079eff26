"""Range join by bins, row numbers, intervals, releases, pages, CSV rows against brute force."""

import io
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from aeris.operators import intervals as I
from aeris.operators import metadata as M
from aeris.operators import publish as P
from aeris.operators.bands import band_join
from aeris.operators.numbering import number_lines, number_rows
from aeris.operators.releases import HISTORICAL, UP_TO_DATE, VERIFIED, best_release
from aeris.sources import csvio
from aeris.sources import files as FS

BANDS = "g string, lower double, upper double, name string, first boolean"


def brute_bands(values, bands):
    out = []
    for g, v in values:
        hit = [b for b in bands if g == b[0] and v is not None and not math.isnan(v) and
               (b[1] is None or v > b[1] or (v == b[1] and b[4])) and (b[2] is None or v <= b[2])]
        out += [(g, repr(v), b[3]) for b in hit] or [(g, repr(v), None)]
    return sorted(map(repr, out))


def test_band_join_matches_brute_force(spark):
    rng = random.Random(1)
    bands, values = [], []
    for g in "abcd":
        cuts = sorted({round(rng.choice([rng.random(), rng.random() * 100, rng.random() * 1e6]) - 50, 3) for _ in range(20)})
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if k % 7 != 5:                                      # gaps
                bands.append((g, lo, hi, f"{g}{k}", k == 0))
        bands += [(g, None, cuts[0] - 1, f"{g}low", False), (g, cuts[-1], math.inf, f"{g}top", False)]
        values += [(g, c) for c in cuts] + [(g, rng.choice([rng.random(), rng.random() * 100, rng.random() * 1e6]) - 50) for _ in range(60)]
    values += [("a", None), ("a", float("nan")), (None, 1.0), ("z", 1.0), ("a", -1e300), ("a", 1e300)]
    v, b = spark.createDataFrame(values, "g string, v double"), spark.createDataFrame(bands, BANDS)
    out = band_join(v, b, ["g"], "v", lower_closed="first")
    assert out.columns == ["g", "v", "lower", "upper", "name", "first"]
    assert sorted(repr((r.g, repr(r.v), r.name)) for r in out.collect()) == brute_bands(values, bands)


def test_band_join_without_bands_or_values(spark):
    v, b = spark.createDataFrame([("a", 1.0)], "g string, v double"), spark.createDataFrame([], BANDS)
    assert [tuple(r) for r in band_join(v, b, ["g"], "v").collect()] == [("a", 1.0, None, None, None, None)]
    assert band_join(v.limit(0), b, ["g"], "v").count() == 0


def test_band_join_of_many_bands_has_no_nested_loop(spark):
    n = 100_000
    b = spark.range(n).selectExpr("cast(id % 100 as string) g", "floor(id / 100) * 2.0 lower", "floor(id / 100) * 2.0 + 2.0 upper", "id name")
    v = spark.range(20_000).selectExpr("cast(id % 100 as string) g", "cast(id % 1900 as double) + 0.5 v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = band_join(v, b, ["g"], "v")
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
        assert out.where("v > lower and v <= upper").count() == 20_000 == out.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_without_a_window_over_the_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(50), k) for k in range(500)]       # one group holds most rows
    got = number_rows(spark.createDataFrame(rows, "g string, x int, k int").repartition(7), ["g"], ["x", "k"], "n").collect()
    for g in "ab":
        want = sorted((x, k) for a, x, k in rows if a == g)
        assert sorted((r.n, r.x, r.k) for r in got if r.g == g) == [(i, x, k) for i, (x, k) in enumerate(want)]
    assert number_rows(spark.createDataFrame([], "g string, x int"), ["g"], ["x"], "n").count() == 0
    nulls = number_rows(spark.createDataFrame([(None, 2), (None, 1), ("a", None)], "g string, x int"), ["g"], ["x"], "n").collect()
    assert sorted((r.g or "", r.n) for r in nulls) == [("", 0), ("", 1), ("a", 0)]


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    """Spark reads large files first and cuts them into splits; numbers go by path and line."""
    want = []
    for name, n in (("a", 3), ("b", 4000), ("c", 1), ("d", 900)):
        lines = [f"{name}-{k}-{'x' * (k % 50)}" for k in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = spark.read.text(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 4
        got = number_lines(scan, "n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(len(want)))


def test_first_row_of_several_files_stays(spark, tmp_path):
    head = ",".join(M.ESSENTIAL_COLUMNS)

    def line(country, point):
        return ",".join(country if c == "Country" else point if c == "Sampling Point Id" else "1" for c in M.ESSENTIAL_COLUMNS)
    (tmp_path / "a.csv").write_text(head + "\n" + line("first", "p") + "\n")
    (tmp_path / "b.csv").write_text(head + "\n" + "".join(line(f"later{k}", "p") + "\n" for k in range(2000)))
    for df in (csvio.read_csv_discovered(spark, str(tmp_path), row_col=M.ORDER_COL), csvio.read_csv_discovered(spark, str(tmp_path))):
        assert [r.country for r in M.metadata_dedup(df).collect()] == ["first"]
    assert [r.station_name for r in M.station_coords(csvio.read_csv_discovered(spark, str(tmp_path))).collect()] == ["1"]


CSV_CASES = [
    "a,b,c,d\n1,2,3,4\n5,6,7,8,,x\n9,10,11,12,\n13,14\n15,,,\n,,,\n\n17,18,19,20\n",
    'a,b,c,d\n"1,1","2""2",3,4\n"x,y",2,3,4,5\n5" pipe,6" pipe,7,8\n"q",r\n"a,b","c,d","e,f","g,h",\n',
    'a,b,c,d\n"two\nlines",2,3,4\n1,"x,\ny",3,4,5\n7,8,9,10\n',
]


@pytest.mark.parametrize("text", CSV_CASES)
def test_rows_as_the_reference_reads_them(spark, tmp_path, text):
    import pandas as pd
    f = tmp_path / "x.csv"
    f.write_text(text)
    want = pd.read_csv(io.StringIO(text), dtype=str, on_bad_lines="skip", index_col=False)
    want = sorted(repr(tuple(None if x != x else x for x in r)) for r in want.itertuples(index=False))
    assert sorted(repr(tuple(r)) for r in csvio.read_csv_metadata(spark, str(f)).collect()) == want
    assert sorted(repr(tuple(r)) for r in csvio.read_csv_discovered(spark, str(f)).collect()) == want


def test_plain_csv_files_are_split(spark, tmp_path):
    f = tmp_path / "big.csv"
    f.write_text("a,b,c,d\n" + "".join(f"{k},x,y,z\n" for k in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = csvio.read_csv_discovered(spark, str(f))
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chain_of_sources(spark):
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")

    def bad():
        raise OSError("down")
    with pytest.warns(UserWarning, match="source 1 skipped: OSError"):
        both = csvio.union_available(one, bad, one.limit(0), lambda: two)
    assert sorted(map(repr, map(tuple, both.collect()))) == ["(1, None)", "(2, 'x')"]
    with pytest.warns(UserWarning):
        assert csvio.first_non_empty(bad, lambda: csvio.union_available(bad), default=one).collect() == one.collect()
    assert csvio.union_available(one.limit(0)) is None


def test_islands(spark):
    rows = [("s", d, v) for d, v in ((1, 5.0), (2, 5.0), (3, 6.0), (5, 6.0), (6, None), (7, None), (8, 5.0))] + [("t", 1, 1.0)]
    df = spark.createDataFrame(rows, "s string, d int, Value double")
    got = sorted(map(repr, map(tuple, I.islands(df, ["s"], "d", F.col("d")).select("s", "Value", "from", "to").collect())))
    assert got == sorted(map(repr, [("s", 5.0, 1, 2), ("s", 6.0, 3, 3), ("s", 6.0, 5, 5), ("s", None, 6, 7), ("s", 5.0, 8, 8), ("t", 1.0, 1, 1)]))
    assert I.islands(df.limit(0), ["s"], "d", F.col("d")).count() == 0


def test_every_day_of_the_intervals_is_its_map_frame(spark, sf_small):
    from aeris.operators import historic as H
    from aeris.sources import adapters as A
    hist = A.historic(spark, sf_small).where(F.col("Date") < "1992-09-01").cache()
    intervals = I.day_intervals(hist).cache()
    assert intervals.count() <= H.dedup_latlon(hist).count()
    days = [r[0].isoformat() for r in H.day_spine(hist).select("Date").distinct().orderBy("Date").limit(2).collect()] + ["1992-08-31", "2050-01-01"]
    for day in days:
        a, b = I.day_frame(intervals, I.day_stations(intervals), day), H.map_frame(hist, day)
        assert sorted(map(repr, map(tuple, a.select(b.columns).collect()))) == sorted(map(repr, map(tuple, b.collect())))


def test_best_release(spark):
    import datetime as dt
    t = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    rows = [("AT", "NO2", "x", t[0], 1.0, UP_TO_DATE), ("AT", "NO2", "x", t[0], 2.0, VERIFIED), ("AT", "NO2", "x", t[1], 3.0, HISTORICAL),
            ("AT", "NO2", "x", t[2], None, VERIFIED), ("AT", "NO2", "x", t[2], 4.0, UP_TO_DATE), ("AT", "NO2", "y", t[0], 5.0, UP_TO_DATE),
            ("AT", "NO2", "y", t[0], 4.0, UP_TO_DATE)]
    df = spark.createDataFrame(rows, "country string, pollutant string, Samplingpoint string, Start timestamp_ntz, Value double, dataset int")
    got = {(r.Samplingpoint, r.Start.hour): (r.Value, r.dataset) for r in best_release(df).collect()}
    assert got == {("x", 0): (2.0, VERIFIED), ("x", 1): (3.0, HISTORICAL), ("x", 2): (None, VERIFIED), ("y", 0): (4.0, UP_TO_DATE)}
    only = {(r.Samplingpoint, r.Start.hour): r.Value for r in best_release(df, [UP_TO_DATE]).collect()}
    assert only == {("x", 0): 1.0, ("x", 2): 4.0, ("y", 0): 4.0}
    plan = best_release(df)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan


def test_a_request_for_one_release_prunes_folders(spark, sf_small):
    from aeris.plans import catalog
    scan = FS.scan_readings(spark, catalog._releases_root(spark, sf_small), releases=True)
    plan = FS.select_partition(scan, ["NATION_3"], datasets=[VERIFIED])._jdf.queryExecution().executedPlan().toString()
    assert "dataset" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_pages_hold_the_whole_payload(spark, sf_small):
    from aeris.plans import catalog
    view = catalog._hour_view(spark, sf_small)
    records = {}
    for r in P.map_payload(view).collect():
        records.setdefault((r.country, r.pollutant), {}).setdefault(r.bucket, []).append((r.station_id, r.record))
    for size in (1, 3, 10_000):
        pages = P.payload_pages(view, size).collect()
        for key, own in records.items():
            mine = sorted((r for r in pages if (r.country, r.pollutant) == key), key=lambda r: r.page)
            assert [r.page for r in mine] == list(range(mine[0].n_pages))
            whole = {n: [] for n, _ in P.BUCKETS}
            for r in mine:
                part = json.loads(r.payload)
                assert list(part) == list(whole) and sum(map(len, part.values())) <= size
                for n in whole:
                    whole[n] += part[n]
            assert whole == {n: [json.loads(x) for _, x in sorted(own.get(n, []))] for n in whole}


def test_many_bands_are_not_broadcast_on_a_wrong_estimate(spark):
    """Bands made by an ``explode`` look as small as the table they are made from."""
    few = spark.range(3000).select(F.col("id").cast("string").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    b = few.select("g", (F.col("k") * 2.0).alias("lower"), (F.col("k") * 2.0 + 2.0).alias("upper"), F.concat("g", "k").alias("name"))
    v = spark.range(500).selectExpr("cast(id * 6 as string) g", "cast(id % 20 as double) + 0.5 v")
    out = band_join(v, b, ["g"], "v")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {(r.g, r.name) for r in out.collect()} == {(str(i * 6), f"{i * 6}{i % 20 // 2}") for i in range(500)}
    small = band_join(v, b.where("g = '6'"), ["g"], "v")     # few bands may still go to every executor
    assert "SortMergeJoin" not in small._jdf.queryExecution().sparkPlan().toString()
