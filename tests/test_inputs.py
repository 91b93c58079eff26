"""Real-input cases: quoted CSV cells, missing order column, odd values, failing sources, shared folder."""

import re
import types

import pytest
from pyspark.sql import functions as F

from aeris import session
from aeris.functions.colour import clip_value, ramp_columns
from aeris.functions.text import fixed_decimals
from aeris.operators import metadata as M
from aeris.sources import csvio
from aeris.sources import files as FS
from aeris.sources.files import select_partition


def test_quoted_cells_survive_reading_and_writing(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text('a,b,c,d\n1,"He said ""hi"", ok",3,4\n2,"two\nlines",x,y\n3,p,q,r,extra\n4,s\n')
    got = csvio.read_csv_metadata(spark, str(f))
    expected = [("1", 'He said "hi", ok', "3", "4"), ("2", "two\nlines", "x", "y"), ("4", "s", None, None)]
    assert sorted(map(tuple, got.collect())) == expected
    out = csvio.write_csv(got, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"He said ""hi"", ok"' in text
    assert sorted(map(tuple, csvio.read_csv_metadata(spark, out).collect())) == expected


def test_metadata_dedup_of_a_plain_csv(spark, tmp_path):
    f = tmp_path / "meta.csv"
    f.write_text(",".join(M.ESSENTIAL_COLUMNS) + "\n" + "".join(
        ",".join(["p1" if "ampling" in c else f"{k}" for c in M.ESSENTIAL_COLUMNS]) + "\n" for k in range(3)))
    rows = M.metadata_dedup(csvio.read_csv_metadata(spark, str(f))).collect()
    assert len(rows) == 1 and rows[0].country == "0"


def test_odd_values(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1e13,), (float("inf"),), (-5.0,), (12.345,)], "v double")
    assert [r[0] for r in df.select(clip_value(F.col("v"))).collect()] == [0.0, 0.0, 240.0, 240.0, 0.0, 12.345]
    assert [r[0] for r in df.select(fixed_decimals(F.col("v"), 1)).collect()] == ["N/A", "N/A", "10000000000000.0", "inf", "-5.0", "12.3"]


def test_empty_selection_selects_nothing(spark):
    df = spark.createDataFrame([("AT", "PM10")], "country string, pollutant string")
    assert select_partition(df, countries=[]).count() == 0
    assert select_partition(df).count() == 1


def test_a_source_that_fails_on_read_is_skipped(spark, tmp_path):
    bad = tmp_path / "x.parquet"
    bad.write_text("not parquet")
    good = spark.createDataFrame([(1,)], "a int")
    with pytest.warns(UserWarning, match="source 0 skipped"):
        assert csvio.first_non_empty(lambda: spark.read.schema("a int").parquet(str(bad)), good).count() == 1


def test_a_cluster_needs_a_shared_folder():
    context = types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(
        sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False))))
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake)


@pytest.mark.parametrize("codec, bom, expected", [
    ("utf-8", b"\xef\xbb\xbf", "utf-8-sig"), ("latin-1", b"", "latin-1"), ("utf-16-le", b"\xff\xfe", "utf-16"),
    ("utf-16-be", b"\xfe\xff", "utf-16"), ("utf-16-le", b"", "utf-16le"), ("utf-16-be", b"", "utf-16be")])
def test_dialect_is_judged_on_all_lines(spark, tmp_path, codec, bom, expected):
    lines = ['"a|1"|b|c|d', *(f"{k}|x|y|z" for k in range(500)), "500|Zürich|y|z"]    # the one odd byte comes last
    (tmp_path / "m.csv").write_bytes(bom + "\n".join(lines).encode(codec))
    assert csvio.discover_dialect(spark, str(tmp_path)) == (expected, "|")
    got = csvio.read_csv_discovered(spark, str(tmp_path))
    assert got.columns == ["a|1", "b", "c", "d"] and got.count() == 501
    assert got.where(F.col("`a|1`") == "500").first()[1] == "Zürich"


def test_dialect_of_a_file_without_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b,c,d\n\n")
    assert csvio.discover_dialect(spark, str(tmp_path)) is None


def test_palette_stops_and_middle(spark):
    df = spark.createDataFrame([(0.0,), (60.0,), (120.0,), (240.0,)], "v double")
    got = [tuple(r) for r in df.select(*ramp_columns(F.col("v"), F.col("v") < 0).values()).collect()]
    assert got == [(228, 255, 122, 180), (255, 231, 25, 180), (255, 188, 0, 180), (252, 127, 0, 180)]


def _stored(spark, root, groups, n=20000):
    parts = [spark.range(n).selectExpr(f"'{c}' AS country", "'NO2' AS pollutant", f"'x/{c}-1' AS Samplingpoint",
                                       "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS Start",
                                       "rand(7) AS Value") for c in groups]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return FS.write_series(df, root, num_partitions=4)


def test_a_half_damaged_file_contributes_nothing_and_is_listed(spark, tmp_path):
    root = str(tmp_path / "series")
    _stored(spark, root, ["AT", "CH"])
    whole = FS.scan_readings(spark, root).groupBy("url").count().collect()
    victim = next(r for r in whole if "country=CH" in r.url)
    f = re.sub("^file:/*", "/", victim.url)
    data = bytearray(open(f, "rb").read())
    data[len(data) // 3: len(data) // 2] = b"\x7f" * (len(data) // 2 - len(data) // 3)     # footer stays intact
    open(f, "wb").write(bytes(data))
    crc = tmp_path.joinpath(f).parent / f".{f.rsplit('/', 1)[1]}.crc"
    if crc.exists():
        crc.write_bytes(b"")
    bad = FS.skipped_files(spark, root).collect()
    assert [r.path for r in bad] == [victim.url] and bad[0].rows_stored == victim["count"] > bad[0].rows_read
    assert FS.scan_readings(spark, root, tolerant=True).count() == sum(r["count"] for r in whole) - victim["count"]
    with pytest.raises(Exception):
        FS.scan_readings(spark, root).agg(F.sum("Value")).collect()


def test_one_hot_series_is_written_by_several_tasks(spark, tmp_path):
    root = str(tmp_path / "series")
    _stored(spark, root, ["AT"], n=30000)
    assert FS.list_files(spark, root).count() >= 3


def test_manifest_reads_the_listed_files_only(spark, tmp_path):
    root = str(tmp_path / "series")
    _stored(spark, root, ["AT", "CH"])
    files = sorted(r.path for r in FS.list_files(spark, root).collect())
    listed = [re.sub("^file:/*", "/", files[0]), files[-1]]              # with and without the scheme
    entries = spark.createDataFrame([(p,) for p in listed], "path string")
    got = {r.url for r in FS.read_manifest(spark, entries, root).select("url").distinct().collect()}
    assert got == {files[0], files[-1]}
    gone = entries.unionByName(spark.createDataFrame([(listed[0] + "x",)], "path string"))
    with pytest.raises(FileNotFoundError):
        FS.read_manifest(spark, gone, root)
    assert FS.read_manifest(spark, entries.limit(0), root).count() == 0


def test_nanosecond_times_need_the_session_setting(spark):
    with pytest.raises(ValueError, match="nanosAsLong"):
        FS.scan_readings(spark, "/nowhere", start_type="nanos")
