"""Reading the driver's parquet tables with the columns a job needs.

Only ``spark.read.parquet`` plus ``select``: Catalyst prunes the read schema
and pushes filters into the scan. Like catalog tables, an input is opened
once (file listing and Parquet footer schema read once) and the
DataFrame is reused by every query, for as long as its files stay as they are: every use compares a stamp
of the table's files (number, bytes, time of change; one call to the file system) and opens the table anew after new
files arrive, with all that was derived from it. ``refresh_tables()`` drops everything, for changes that a stamp
cannot show (a file replaced deep in a folder by one of the same length).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
READINGS = ("events", "customer", "nation")     # what the readings and the station metadata are derived from
HISTORIC = ("lineitem",)

_OPENED: dict[tuple, tuple] = {}


def path_of(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def stamp(spark: SparkSession, path: str) -> tuple:
    """What the files of ``path`` look like now: bytes, number, time of change of the top folder."""
    from aeris.sources.daystore import file_system
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return ()
    status = fs.getFileStatus(p)
    if status.isFile():
        return status.getLen(), 1, status.getModificationTime()
    summary = fs.getContentSummary(p)
    return summary.getLength(), summary.getFileCount(), status.getModificationTime()


def _kept(spark: SparkSession, sf_dir: str, of: tuple[str, ...], key: tuple, build):
    """What ``build`` gave for ``key`` while the tables ``of`` had the files they have now."""
    now = tuple(stamp(spark, path_of(sf_dir, name)) for name in of)
    full = (spark, sf_dir, *key)
    seen = _OPENED.get(full)
    if seen is None or seen[0] != now:
        seen = (now, build())
        _OPENED[full] = seen
    return seen[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _kept(spark, sf_dir, (name,), ("table", name), lambda: spark.read.parquet(path_of(sf_dir, name)))


def snapshot_value(spark: SparkSession, sf_dir: str, name: str, what: str, compute):
    """A scalar derived from a table (e.g. its latest time), computed once while its files stay as they are."""
    return _kept(spark, sf_dir, (name,), ("value", name, what), lambda: compute(table(spark, sf_dir, name)))


def session_view(spark: SparkSession, sf_dir: str, name: str, build, of: tuple[str, ...] = READINGS) -> DataFrame:
    """A derived view (a lazy DataFrame: no data is computed or kept) defined once
    per session and input folder, like ``createOrReplaceTempView`` for an
    application's standard views; defined anew when a table it is made ``of`` has other files."""
    return _kept(spark, sf_dir, of, ("view", name), build)


def session_folder(spark: SparkSession, sf_dir: str, name: str, write, of: tuple[str, ...] = READINGS):
    """A derived input folder (e.g. the stored readings layout, or a landing folder
    of arriving files) written once per session and input folder; ``write``
    returns what the callers need (its path). Written anew when a table it is made ``of`` has other files."""
    return _kept(spark, sf_dir, of, ("folder", name), write)


def column_bounds(spark: SparkSession, sf_dir: str, name: str, column: str) -> tuple:
    """Least and greatest value of a column; after new files arrive only they are scanned (``sources.bounds``)."""
    from aeris.session import scratch_path
    from aeris.sources.bounds import bounds
    store = _kept(spark, sf_dir, (), ("bounds", name, column), lambda: scratch_path(spark, f"bounds-{name}-{column}"))
    return _kept(spark, sf_dir, (name,), ("ends", name, column),
                 lambda: bounds(spark, path_of(sf_dir, name), column, store))


def refresh_tables() -> None:
    _OPENED.clear()
