"""Edge cases of the scalar rules (FIXTURES.md §4)."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeris.functions import eaqi
from aeris.functions.deciles import decile_edges, decile_of
from aeris.functions.keys import norm_col_name, normalize_key, short_id
from aeris.functions.text import fixed_decimals
from aeris.functions.timefmt import parse_time
from aeris.operators.clean import time_range


def py_label(v, pollutant):
    """Brute-force restatement of the label rule."""
    if v is None or (isinstance(v, float) and math.isnan(v)) or v < 0:
        return None
    for upper, label in zip(eaqi.THRESHOLDS.get(pollutant, eaqi.THRESHOLDS["PM10"]), eaqi.LABELS):
        if v <= upper:
            return label
    return None


def edge_values(pollutant):
    uppers = eaqi.THRESHOLDS.get(pollutant, eaqi.THRESHOLDS["PM10"])[:-1]
    vals = [None, float("nan"), -1.0, 0.0, 10000.0]
    for u in uppers:
        vals += [float(u), float(u) + 0.01]
    return vals


@pytest.mark.parametrize("pollutant", ["PM2.5", "PM10", "NO2", "O3", "SO2"])
def test_tier_edges_case_and_range_join_agree(spark, pollutant):
    vals = edge_values(pollutant)
    df = spark.createDataFrame([(i, pollutant, v) for i, v in enumerate(vals)], "i int, pollutant string, Value double")
    case = {r.i: r.l for r in df.select("i", eaqi.aqi_label(F.col("Value"), F.col("pollutant")).alias("l")).collect()}
    joined = {r.i: r.aqi_label for r in eaqi.classify_range_join(df, eaqi.eaqi_dim(spark)).collect()}
    for i, v in enumerate(vals):
        assert case[i] == py_label(v, pollutant), (v, case[i])
        assert joined[i] == case[i], (v, joined[i])


def test_style_rule_zero_is_no_data(spark):
    df = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (-999.0,), (3.0,), (500.0,)], "Value double") \
        .withColumn("pollutant", F.lit("PM2.5"))
    rows = eaqi.with_aqi_style(df).collect()
    got = [(r.aqi_label, r.color_r, r.color_g, r.color_b, r.color_a) for r in rows]
    assert got[:4] == [("No data", 128, 128, 128, 0)] * 4
    assert got[4] == ("Good", 0x44, 0x77, 0xAA, 220)
    assert got[5] == ("Extremely poor", 0x88, 0x22, 0x55, 220)
    # the label rule, unlike the style rule, calls 0 "Good"
    assert df.select(eaqi.aqi_label(F.col("Value"), F.col("pollutant"))).first()[0] == "Good"


def _deciles(spark, values):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "g int, i int, v double")
    edges = decile_edges(df, ["g"], "v")
    out = df.join(edges, "g").select("i", decile_of(F.col("v"), F.col("edges")).alias("d"))
    return [r.d for r in out.orderBy("i").collect()]


@pytest.mark.parametrize("values,expected", [
    ([1, 1, 1, 1, 2, 2, 3, 4, 50, 7, 8, 9, 9, 9.5], [0, 0, 0, 0, 1, 1, 2, 3, 7, 4, 4, 5, 5, 7]),
    ([5, 5, 5], [None, None, None]),
    ([5], [None]),
    ([1, 2], [0, 9]),
])
def test_deciles_fixture(spark, values, expected):
    assert _deciles(spark, values) == expected


def test_deciles_match_pandas_qcut(spark):
    import random
    rnd = random.Random(7)
    for _ in range(5):
        vals = [round(rnd.uniform(0, 240), 1) for _ in range(rnd.randint(2, 60))] + [12.0, 12.0, 12.0]
        ref = pd.qcut(pd.Series(vals), q=10, labels=False, duplicates="drop").tolist()
        assert _deciles(spark, vals) == [int(x) for x in ref]


def test_parse_time(spark):
    df = spark.createDataFrame([(1546300800123456789,)], "Start long")
    assert parse_time(df).first().Start == dt.datetime(2019, 1, 1, 0, 0, 0, 123456)
    txt = spark.createDataFrame([("2024-01-01 10:00:00+02:00",), ("nonsense",), ("2024-03-05 07:30:00",)], "Start string")
    assert [r.Start for r in parse_time(txt).collect()] == [
        dt.datetime(2024, 1, 1, 10, 0), None, dt.datetime(2024, 3, 5, 7, 30)]


def test_year_end_midnight_mode(spark):
    df = spark.createDataFrame([(dt.datetime(2019, 12, 31, 0, 0),), (dt.datetime(2019, 12, 31, 1, 0),)], "Start timestamp_ntz")
    assert time_range(df, "2019-01-01", "2019-12-31", "midnight").count() == 1
    assert time_range(df, "2019-01-01", "2019-12-31", "day").count() == 2


def test_value_text_half_up(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.25,), (None,), (float("nan"),)], "v double")
    got = [r.t for r in df.select(fixed_decimals(F.col("v"), 2).alias("t")).collect()]
    assert got == ["0.13", "2.68", "0.25", "N/A", "N/A"]


def test_keys(spark):
    df = spark.createDataFrame([("  http://x/y/SPO-1\t",), ("SPO-2",), (" spo-3 ",)], "s string")
    got = [(r.a, r.b) for r in df.select(short_id(F.col("s")).alias("a"),
                                         normalize_key(short_id(F.col("s"))).alias("b")).collect()]
    assert got == [("SPO-1", "spo-1"), ("SPO-2", "spo-2"), ("spo-3", "spo-3")]
    assert norm_col_name("﻿ Sampling-Point.Id / X ") == "sampling_point_id_x"
