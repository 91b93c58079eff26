"""Exact decile binning per group, the equal-frequency rule of the reference.

Edges are the exact (linear-interpolation) quantiles 0, 0.1, …, 1 of the
group's values; duplicate edges are dropped; a value's bin is the number of
edges strictly below it minus one (first bin closed on the left). With a
single distinct edge there are no bins and the label is null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PROBS = [i / 10 for i in range(11)]


def decile_edges(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per group with ``edges`` = distinct exact decile edges; nulls do not count.

    No group is ever held in one buffer. Rows are counted per (group, value), then per whole-number bucket of
    the value (at most 241 of them where values are clipped to 0..240). Running counts over the buckets tell
    which ones hold the 22 ranks an edge is interpolated from, and only those buckets' values are ranked, each
    bucket by itself in a running sum.

    The counted values are dealt to tasks by (group, bucket) once: bucket sums, the join with the buckets hit and the
    ranks inside a bucket all use that one exchange (the bucket's highest value, which a rank is checked against, makes
    both uses read the same columns).
    """
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, value)])    # frames without a key have no edges
    keyed = values.where(known).withColumn("_b", F.floor(F.col(value))).where(F.col("_b").isNotNull())
    counted = keyed.groupBy(*keys, "_b", value).agg(F.count(F.lit(1)).alias("_w")).repartition(*keys, "_b")
    group, steps = Window.partitionBy(*keys), (Window.unboundedPreceding, Window.currentRow)
    buckets = (counted.groupBy(*keys, "_b").agg(F.sum("_w").alias("_bw"), F.max(value).alias("_top"))
               .withColumn("_n", F.sum("_bw").over(group))
               .withColumn("_from", F.sum("_bw").over(group.orderBy("_b").rowsBetween(*steps)) - F.col("_bw")))
    at = [(F.col("_n") - F.lit(1)) * F.lit(p) for p in _PROBS]
    ranks = [(F.floor(x), F.ceil(x)) for x in at]

    def covers(rank: Column, width: str) -> Column:
        return (rank >= F.col("_from")) & (rank < F.col("_from") + F.col(width))

    hit = reduce(or_, [covers(r, "_bw") for pair in ranks for r in pair])
    ranked = (counted.join(buckets.where(hit).select(*keys, "_b", "_n", "_from", "_top"), [*keys, "_b"])
              .where(F.col(value) <= F.col("_top"))
              .withColumn("_from", F.col("_from") - F.col("_w") + F.sum("_w").over(
                  Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(*steps))))
    found = ranked.groupBy(*keys, "_n").agg(*[
        F.max(F.when(covers(r, "_w"), F.col(value).cast("double"))).alias(f"_{side}{i}")
        for i, pair in enumerate(ranks) for side, r in zip(("lo", "hi"), pair)])

    def edge(i: int) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        below, above = ranks[i]
        return F.when(lo == hi, lo).otherwise((above - at[i]) * lo + (at[i] - below) * hi)

    return found.select(*keys, F.array_distinct(F.array(*[edge(i) for i in range(len(_PROBS))])).alias("edges"))


def decile_of(value: Column, edges: Column) -> Column:
    """Bin index of ``value`` given sorted distinct ``edges``; null with < 2 edges.

    The count of edges below the value is unrolled over the (at most 11) edge
    positions, so it stays in generated code (a lambda would be interpreted
    per row).
    """
    below = None
    for i in range(1, len(_PROBS) + 1):
        term = F.when(F.try_element_at(edges, F.lit(i)) < value, F.lit(1)).otherwise(F.lit(0))
        below = term if below is None else below + term
    return F.when(F.size(edges) >= 2, F.greatest(F.lit(0), below - F.lit(1)))
