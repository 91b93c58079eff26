"""Releases of the same data: verified, up to date, unverified.

The download service asks for one data set; a series may be in several, with overlapping times. Readings are stored
with the release as the outermost partition, so asking for one prunes folders. ``best_release`` merges them: of the
readings of one series and time the one of the release that comes first in the order of trust stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: data set numbers of the download request -----------------
UP_TO_DATE, VERIFIED, HISTORICAL = 1, 2, 3
# ---------------------------------------------------------------------------

TRUST = [VERIFIED, UP_TO_DATE, HISTORICAL]
DATASET = "dataset"
READING = ["country", "pollutant", "Samplingpoint", "Start"]


def _rank(order: list[int]) -> Column:
    c = F.col(DATASET)
    out = None
    for k, d in enumerate(order):
        out = F.when(c == d, F.lit(k)) if out is None else out.when(c == d, F.lit(k))
    return out


def best_release(readings: DataFrame, order: list[int] | None = None) -> DataFrame:
    """``READING, Value, dataset`` of one reading per series and time: that of the first release in ``order`` which has
    it (releases that ``order`` leaves out don't count; their folders are pruned). Repeated rows within a release:
    the least value.

    One hash aggregate on fixed-width buffers with a partial step before its shuffle, so a series with a third of all
    readings is spread by its times; no window, no join of the releases."""
    order = TRUST if order is None else order
    rows = readings.where(F.col(DATASET).isin(order)).withColumn("_rank", _rank(order))
    # least value per release first: then a rank is unique within its key
    one = rows.groupBy(*READING, "_rank").agg(F.min("Value").alias("Value"))
    best = one.groupBy(*READING).agg(F.min_by("Value", "_rank").alias("Value"), F.min("_rank").alias("_rank"))
    back = F.element_at(F.array(*[F.lit(d) for d in order]), F.col("_rank") + 1)
    return best.select(*READING, "Value", back.alias(DATASET))
