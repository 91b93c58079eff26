"""Hourly history that takes readings of any lateness, each once, and says what it corrected.

A stream with a watermark drops what comes later than that. Here each micro-batch

1. keeps the readings whose key is in no earlier batch: keys are stored per day, and a batch reads those of the days it
   touches only, so a reading delivered again counts once however late it comes; the grouping that gives each reading
   once takes the stored keys too, so rows are shuffled and written once for both;
2. calls those late that are older than the latest time of earlier batches less the watermark (the rule of Spark's
   own watermark);
3. merges the states of all of them, by event time, into the history, and those of the late ones into a table of
   corrections too: what each hour got after it was thought to be final.

So the history equals one batch over all files, at any time. All tables are tables of days (``sources.daystore``):
a repeated micro-batch gives the same result, and files and bytes don't grow with the number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeris.operators import rollup
from aeris.operators.clean import clean_readings
from aeris.sources import daystore
from aeris.streaming.hourly import BATCH_BYTES, READING, WATERMARK, readings_stream

_CLOCK = T.StructType([T.StructField("latest", T.TimestampNTZType()), T.StructField(daystore.DAY, T.DateType())])
_KEYS = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("pollutant", T.StringType()),
    T.StructField("Samplingpoint", T.StringType()), T.StructField("Start", T.TimestampNTZType()),
    T.StructField(daystore.DAY, T.DateType())])


def _clock(spark: SparkSession, root: str, before: int) -> DataFrame:
    """The latest time of all batches before one (a row, or none), kept as a table of one day."""
    return daystore.read_days(spark, f"{root}/clock", _CLOCK, before=before)


def add_batch(batch: DataFrame, root: str, batch_id: int) -> None:
    """Take one batch of raw readings into the history in ``root``."""
    spark = batch.sparkSession
    arrived = clean_readings(batch).select(*READING, "Value", F.lit(False).alias("_known"))
    days = [r[0].isoformat() for r in arrived.select(F.to_date("Start")).distinct().collect()]
    if not days:
        return
    known = daystore.read_days(spark, f"{root}/keys", _KEYS, days, before=batch_id) \
        .select(*READING, F.lit(None).cast("double").alias("Value"), F.lit(True).alias("_known"))
    fresh = arrived.unionByName(known).groupBy(*READING).agg(F.min("Value").alias("Value"), F.max("_known").alias("_known")) \
        .where(~F.col("_known")).drop("_known").withColumn(daystore.DAY, F.to_date("Start"))
    schema, fresh_dir = fresh.schema, f"{root}/_fresh"
    fresh.write.mode("overwrite").parquet(fresh_dir)
    fresh = spark.read.schema(schema).parquet(fresh_dir)
    clock = _clock(spark, root, batch_id).agg(F.max("latest")).first()[0]
    daystore.merge_days(fresh.select(_KEYS.fieldNames()), f"{root}/keys", batch_id, DataFrame.unionByName, "Samplingpoint",
                        stored=True)
    daystore.merge_days(rollup.reading_states(fresh), f"{root}/states", batch_id, rollup.merged, rollup.STATION, stored=True)
    if clock is not None:
        bound = F.lit(clock.isoformat(sep=" ")).cast("timestamp_ntz") - F.expr(f"INTERVAL {WATERMARK}")
        late = rollup.reading_states(fresh.where(F.col("Start") < bound))
        daystore.merge_days(late, f"{root}/corrections", batch_id, rollup.merged, rollup.STATION, stored=True)
    latest = fresh.agg(F.max("Start").alias("latest")).where("latest is not null") \
        .withColumn(daystore.DAY, F.lit("1970-01-01").cast("date"))
    daystore.merge_days(latest, f"{root}/clock", batch_id,
                        lambda old, new: old.unionByName(new).groupBy(daystore.DAY).agg(F.max("latest").alias("latest")))


def run_history(spark: SparkSession, source_dir: str, schema, root: str, checkpoint_dir: str,
                batch_bytes: int = BATCH_BYTES) -> None:
    """Take everything that has arrived in ``source_dir`` into the history in ``root``, then stop."""
    q = (readings_stream(spark, source_dir, schema, batch_bytes).select(*READING, "Value")
         .writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, root, batch_id))
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def history(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame:
    """Means per station and hour over all readings that arrived."""
    return rollup.hourly(spark, f"{root}/states", days)


def corrections(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame:
    """What late readings added, per station and hour: ``sum_value, n``."""
    return daystore.read_days(spark, f"{root}/corrections", rollup.HOURLY_SCHEMA, days).select(
        *rollup.STATION_HOUR, "sum_value", "n")
