"""Readings arriving as files → hourly means and classified rows, incrementally.

The reference re-fetches seven days and recomputes; a Spark user instead
streams the arriving files:

* ``run_hourly_mean`` — fresh means per station and hour. A reading that is delivered twice (the same seven days are
  fetched again and again) passes once: ``dropDuplicatesWithinWatermark`` keeps the keys of the last seven days as
  state. Each micro-batch becomes states (sum, count, ...) that are merged into the days they touch, in a table of days
  (``sources.daystore``), whose files and bytes don't grow with the number of batches.
* ``run_hourly_final`` — final history in ``append`` mode: each window once, when the watermark has passed it.
* ``run_classify`` — clean + tier + station coordinates, appended to Parquet; each reading once, coordinates read
  again for every micro-batch.

Readings later than the watermark are dropped by these queries, counted and reported; ``streaming.history`` keeps them.

Watermarks need TIMESTAMP (not NTZ): wall-clock times are mapped to instants
as if they were UTC (independent of the session zone) and mapped back on output.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.functions.eaqi import aqi_label
from aeris.functions.keys import normalize_key, short_id
from aeris.functions.timefmt import instant_to_ntz, ntz_to_instant
from aeris.operators import rollup
from aeris.operators.clean import valid_value
from aeris.sources import daystore

KEY = rollup.STATION_HOUR
READING = ["country", "pollutant", "Samplingpoint", "Start"]   # what makes two deliveries the same reading
WATERMARK = "7 days"


BATCH_BYTES = 64 * 1024 ** 3


def readings_stream(spark: SparkSession, source_dir: str, schema, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Arriving files, oldest first; a micro-batch takes about ``batch_bytes`` of them, however many files that is."""
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
            .parquet(source_dir))


def _finish(query) -> int:
    """Wait for the query to end. Returns the rows it dropped as later than the watermark, over the micro-batches the
    session keeps progress of (``spark.sql.streaming.numRecentProgressUpdates``), and warns if there are any."""
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if late:
        warnings.warn(f"{late} rows arrived more than {WATERMARK} late and were dropped", stacklevel=3)
    return late


def clean_stream(stream: DataFrame) -> DataFrame:
    return (stream.where(F.col("Start").isNotNull() & valid_value(F.col("Value")))
            .withColumn("station_id", short_id(F.col("Samplingpoint"))))


def once_stream(stream: DataFrame) -> DataFrame:
    """Cleaned readings, each once however often it is delivered within the watermark (the first delivery counts)."""
    return (clean_stream(stream).withColumn("_ts", ntz_to_instant(F.col("Start")))
            .withWatermark("_ts", WATERMARK).dropDuplicatesWithinWatermark(READING))


def hourly_mean_stream(stream: DataFrame) -> DataFrame:
    return (once_stream(stream)
            .groupBy("country", "pollutant", "station_id", F.window("_ts", "1 hour").alias("w"))
            .agg(F.sum("Value").alias("sum_value"), F.count(F.lit(1)).alias("n")))


def run_hourly_mean(spark: SparkSession, source_dir: str, schema, sink_dir: str,
                    checkpoint_dir: str, batch_bytes: int = BATCH_BYTES) -> int:
    """Run the stream over everything available now, then stop. Returns the late rows dropped."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        daystore.merge_days(rollup.station_hour_states(batch), sink_dir, batch_id, rollup.merged, "station_id")

    q = (once_stream(readings_stream(spark, source_dir, schema, batch_bytes))
         .select(*READING, "Value")
         .writeStream.foreachBatch(merge)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    return _finish(q)


def run_hourly_final(spark: SparkSession, source_dir: str, schema, sink_dir: str,
                     checkpoint_dir: str, batch_bytes: int = BATCH_BYTES) -> int:
    """Final history: ``append`` mode writes each hourly window exactly once, when the
    watermark (latest time − 7 days) has passed its end, to a Parquet file sink
    (exactly-once through the sink's commit log). Returns the late rows dropped."""
    q = (hourly_mean_stream(readings_stream(spark, source_dir, schema, batch_bytes))
         .select("country", "pollutant", "station_id",
                 instant_to_ntz(F.col("w.start")).alias("hour"),
                 (F.col("sum_value") / F.col("n")).alias("Value"), "n")
         .writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    return _finish(q)


def latest_per_key(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Current mean of every station and hour."""
    return rollup.hourly(spark, sink_dir).select(*KEY, "Value", "n")


def classify(clean: DataFrame, coords: DataFrame) -> DataFrame:
    """Label, and attach coordinates (left join)."""
    c = coords.select("key", "lat", "lon", "station_name")
    return (clean.withColumn("aqi_label", aqi_label(F.col("Value"), F.col("pollutant")))
            .withColumn("key", normalize_key(F.col("station_id")))
            .join(c, "key", "left").drop("key"))


def run_classify(spark: SparkSession, source_dir: str, schema, coords: Callable[[], DataFrame], sink_dir: str,
                 checkpoint_dir: str, batch_bytes: int = BATCH_BYTES) -> int:
    """``coords`` is called for every micro-batch, so that stations added while the stream runs are found. A batch that
    is repeated after a failure replaces its own rows. Returns the late rows dropped."""
    def append(batch: DataFrame, batch_id: int) -> None:
        (classify(batch, coords()).withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink_dir))

    once = once_stream(readings_stream(spark, source_dir, schema, batch_bytes))
    q = (once.drop("_ts").writeStream.foreachBatch(append)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    return _finish(q)
