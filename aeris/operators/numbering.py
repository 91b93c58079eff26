"""Row numbers without a window over all rows of a group.

Rows are counted per part (a range of the sorted table, or a split of a file), and the counts' running sums give each
part its first number; a row's number is that plus its place in its part. Only the counts meet in one place: a few
rows per part, whatever a group holds.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeris.session import materialize


def _numbered(rows: DataFrame, group: list[str], part: list[str], col: str) -> DataFrame:
    """``rows`` with ``_at`` (its order inside a part, with equal steps of 1 from any start) → ``col``, from 0 in each group."""
    counts = rows.groupBy(*group, *part).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_k_{c}") for c in [*group, *part]),
                           (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*group, *part]])
    kept = [c for c in rows.columns if c not in (*part, "_at")]
    return rows.join(starts, on).select(*kept, (F.col("_at") + F.col("_start")).alias(col))


def number_rows(df: DataFrame, group: list[str], order: list[str], col: str) -> DataFrame:
    """Number the rows of each ``group`` from 0 in the ``order`` of columns (nulls first). The sorted table is written
    once. Rows equal in group and order are numbered in any order; they meet in one task, which sorts on disk."""
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
                       "numbered")
    return _numbered(rows, group, ["_part"], col)


def file_order() -> Column:
    """What sorts the rows of a file scan as they stand: file, place of the split, row of the split. A split is read by
    one task from front to back; ``monotonically_increasing_id`` alone would follow the packing of splits into tasks,
    which goes by size."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def number_lines(scan: DataFrame, col: str) -> DataFrame:
    """Number the rows of a file scan, from 0, over all its files in the order of their paths. The rows are written once."""
    rows = materialize(scan.withColumn("_place", file_order()).withColumn("_file", F.col("_place.file"))
                       .withColumn("_block", F.col("_place.block")).withColumn("_at", F.col("_place.row")).drop("_place"),
                       "lines").withColumn("_all", F.lit(0))
    # within a file, then over files: no window sees more than one file's splits, or the files
    inside = _numbered(rows.withColumn("_name", F.col("_file")), ["_file"], ["_block"], "_line")
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("_file").alias("_name"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return inside.drop("_file", "_all").join(starts, "_name").withColumn(col, F.col("_line") + F.col("_before")) \
        .drop("_line", "_before", "_name")
