"""Plan shapes: how often the live queries read the readings, and which aggregates see them."""

import re

import pytest

from aeris.operators import compare as CMP
from aeris.plans import catalog

ONE_SCAN = ["station_meta", "hourly_mean", "hour_view_at", "tier_breakdown", "station_summary", "station_count",
            "station_table", "all_hours", "frame_index", "chart_bands"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def _event_scans(spark_plan):
    return len(re.findall(r"FileScan parquet \[[^\]]*user_id", spark_plan))


@pytest.mark.parametrize("name, scans", [(n, 1) for n in ONE_SCAN] + [("hour_view", 2), ("map_payload", 2)])
def test_the_readings_are_scanned_once(spark, sf_small, name, scans):
    """The default hour of ``hour_view`` adds one narrow aggregate of the times (no value, no station)."""
    _, physical = _plan(catalog.queries()[name](spark, sf_small))
    assert _event_scans(physical) == scans


def test_summary_reads_readings_by_hash_aggregates(spark, sf_small):
    ext = CMP.station_labels(catalog._recent(spark, sf_small), catalog._coords(spark, sf_small).limit(0))
    pre = CMP._extremes(CMP.compare_series(catalog._recent(spark, sf_small)), ["country", "pollutant", "url"])
    assert "SortAggregate" not in _plan(pre)[1] and "ObjectHashAggregate" not in _plan(pre)[1]
    assert "hours" in ext.columns


def test_deciles_of_many_distinct_values_match_pandas(spark):
    import numpy as np
    import pandas as pd
    from aeris.functions.deciles import decile_edges
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 5000), "v": np.where(rng.random(5000) < .4, 100 + rng.random(5000), rng.random(5000) * 240)})
    df = decile_edges(spark.createDataFrame(pdf).repartition(5), ["g"], "v")
    plan = _plan(df)[1]
    assert "percentile" not in plan and "collect" not in plan
    for r in df.collect():
        x = np.quantile(pdf.v[pdf.g == r.g], [i / 10 for i in range(11)])
        assert np.allclose(r.edges, x, rtol=1e-12, atol=0)
    assert decile_edges(spark.createDataFrame([], "g int, v double"), ["g"], "v").count() == 0
