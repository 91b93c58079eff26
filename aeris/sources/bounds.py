"""Least and greatest value of a column per file, kept as a small table beside the data.

"Now" of the live view and the ends of the sliders are bounds of a column. Instead of a scan at every refresh, each
file's bounds are found once, when it is first listed, and stored with its path, time of change and length. A refresh
lists the files (no file is opened), scans one column of the files that are new or changed, and takes the bounds over
what is listed: new files move them, deleted ones stop counting, old ones are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE = ["path", "modified", "length"]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, modified, length`` of the Parquet files below ``path`` (a file or a folder)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("modificationTime").alias("modified"), "length")
            .where(~F.substring_index("path", "/", -1).rlike("^[_.]")))


def file_bounds(spark: SparkSession, path: str, column: str, store: str) -> DataFrame:
    """``path, modified, length, lo, hi`` of every file listed now; ``store`` keeps what is known and is brought up to
    date. Files without a value have null bounds."""
    seen = _exists(spark, store)
    kind = spark.read.parquet(store).schema["lo"].dataType if seen else spark.read.parquet(path).schema[column].dataType
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType()),
                           T.StructField("length", T.LongType()), T.StructField("lo", kind), T.StructField("hi", kind)])
    known = spark.read.schema(schema).parquet(store) if seen else spark.createDataFrame([], schema)
    now = listing(spark, path)
    new = now.join(known, _FILE, "left_anti")
    arrived = [r["path"] for r in new.select("path").collect()]    # the files of an arrival
    if arrived:
        one = spark.read.parquet(*arrived) if seen else spark.read.option("recursiveFileLookup", "true").parquet(path)
        per = one.groupBy(F.col("_metadata.file_path").alias("_p")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        found = new.join(per.withColumn("_p", _plain("_p")), _plain("path") == F.col("_p"), "left").drop("_p")
        found.select(schema.fieldNames()).coalesce(1).write.mode("append").parquet(store)
        known = spark.read.schema(schema).parquet(store)
    return known.join(now, _FILE, "left_semi").dropDuplicates(_FILE)


def _plain(col: str) -> F.Column:
    """A path without scheme and host, percent codes decoded."""
    p = F.regexp_replace(F.col(col), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.coalesce(F.try_url_decode(p), p)


def _exists(spark: SparkSession, path: str) -> bool:
    from aeris.sources.daystore import file_system
    fs, p = file_system(spark, path)
    return fs.exists(p)


def bounds(spark: SparkSession, path: str, column: str, store: str) -> tuple:
    """Least and greatest value of ``column`` over the files listed now."""
    return tuple(file_bounds(spark, path, column, store).agg(F.min("lo"), F.max("hi")).first())
