"""A table of days on plain Parquet that can be merged into.

Layout: ``root/day=YYYY-MM-DD/version=N/*.parquet`` (``day`` may stand for a longer stretch, the first day of a year for
instance, where a day has few rows). A merge rewrites only the days that new rows touch, each as a new
version (its batch number), by dynamic partition overwrite; readers take the newest version of every day, found by
listing folders, without reading older ones. Then older versions go, except the one before, so that a merge which was
lost half-way (its driver died) can be repeated under the same number with the same result. A day thus holds at most
two versions, however many merges there were, and readers see each day before or after a merge, never in between.

New rows are written once to ``root/_staging`` (overwritten by the next merge), so their plan runs once; rows that are
in files already (``stored``) are not written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "day"
_VERSION = "version"
_STAGING = "_staging"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str, key: str) -> dict[str, str]:
    """``value -> path`` of the folders ``key=value`` in ``path``."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return {}
    found = ((s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory())
    return {name[len(key) + 1:]: full for name, full in found if name.startswith(f"{key}=")}


def versions(spark: SparkSession, root: str, days: Iterable[str] | None = None) -> dict[str, dict[int, str]]:
    """``day -> version -> folder`` of all days, or of those given; one call lists them."""
    wanted = "*" if days is None else "{" + ",".join(days) + "}"
    fs, p = file_system(spark, f"{root}/{DAY}={wanted}/{_VERSION}=*")
    out: dict[str, dict[int, str]] = {}
    for status in fs.globStatus(p) or []:
        full = status.getPath().toString()
        day, version = (x.split("=", 1)[1] for x in full.rsplit("/", 2)[1:])
        out.setdefault(day, {})[int(version)] = full
    return out


def age_files(spark: SparkSession, root: str, key: str, seconds: int = 10) -> None:
    """Give the files below ``root/key=N`` times of change in the order of N, ending now: the order in which a file
    stream takes them."""
    import time
    found = sorted((int(v), p) for v, p in _folders(spark, root, key).items())
    now = int(time.time() * 1000)
    for k, (_, folder) in enumerate(found):
        fs, p = file_system(spark, folder)
        for status in fs.listStatus(p):
            fs.setTimes(status.getPath(), now - (len(found) - 1 - k) * seconds * 1000, -1)


def read_days(spark: SparkSession, root: str, schema: T.StructType, days: Iterable[str] | None = None,
              before: int | None = None) -> DataFrame:
    """Current rows of all days (or of those given), with their ``day``; ``before`` ignores versions from that number
    on. Only the folders of the chosen versions are listed and read."""
    paths = []
    for _, found in sorted(versions(spark, root, days).items()):
        old = [v for v in found if before is None or v < before]
        if old:
            paths.append(found[max(old)])
    full = T.StructType([*(f for f in schema.fields if f.name != DAY), T.StructField(DAY, T.DateType())])
    if not paths:
        return spark.createDataFrame([], full)
    names = full.fieldNames()
    return spark.read.schema(full).option("basePath", root).parquet(*paths).select(*names)


def prune(spark: SparkSession, root: str, days: Iterable[str]) -> None:
    """Drop all versions but the two newest of each of ``days``."""
    for found in versions(spark, root, days).values():
        for v in sorted(found)[:-2]:
            fs, p = file_system(spark, found[v])
            fs.delete(p, True)


def merge_days(new: DataFrame, root: str, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame],
               part_key: str | None = None, stored: bool = False) -> list[str]:
    """Merge ``new`` (which has a ``day``) into the days it touches: ``merge(old, new)`` gives their new rows.
    Returns the days. ``version`` must grow from merge to merge; repeating the last one changes nothing.

    ``part_key`` names a column by whose values a day's rows are dealt to files, so that a day of any size is written
    by many tasks; adaptive execution merges small ones. A ``merge`` that deals by day and ``part_key`` itself saves a
    second shuffle. ``stored`` says that ``new`` is no more than read from files, by a plan that may run twice."""
    spark = new.sparkSession
    schema = new.schema
    if not stored:
        staged = f"{root}/{_STAGING}"
        new.write.mode("overwrite").parquet(staged)
        new = spark.read.schema(schema).parquet(staged)
    days = sorted(r[0].isoformat() for r in new.select(DAY).distinct().collect() if r[0] is not None)
    if not days:
        return []
    old = read_days(spark, root, schema, days, before=version).select(*schema.fieldNames())
    out = merge(old, new).withColumn(_VERSION, F.lit(version))
    if part_key is not None:
        out = out.repartition(F.col(DAY), F.col(part_key))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, _VERSION).parquet(root))
    prune(spark, root, days)
    return days
