"""Chart- and map-ready outputs: payload records, legend, counts, peaks, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeris.functions.eaqi import effective_pollutant
from aeris.operators.numbering import number_rows

GROUP = ["country", "pollutant"]
# --- Fixed values: map payload of the reference -----------------------------
PAYLOAD_COLUMNS = ["lon", "lat", "color_r", "color_g", "color_b", "color_a",
                   "station_name", "aqi_label", "value_str", "area_type"]
BUCKETS = [("urban", ["urban", "unknown"]), ("suburban", ["suburban"]),
           ("rural", ["rural", "rural-nearcity", "rural_nearcity"])]
# Question sent to the text model about a peak (metric and date filled in)
PEAK_PROMPT = ("Explain briefly in only 1-2 sentences what event could cause there to be an air quality "
               "(%s) peak on %s in Europe. Keep your response short and concise.")
# ---------------------------------------------------------------------------


def area_bucket(area):
    norm = F.coalesce(F.lower(area), F.lit("unknown"))
    out = None
    for name, members in BUCKETS:
        out = F.when(norm.isin(members), F.lit(name)) if out is None else out.when(norm.isin(members), F.lit(name))
    return out


def map_payload(view: DataFrame) -> DataFrame:
    """One JSON record per station and map bucket (urban/suburban/rural).

    Fixed field order, NaN → null, nulls written (not dropped). Areas outside
    the known list fall out, as on the reference's map. Records stay one per
    row (JSON-lines), so no bucket is ever gathered into a single value.
    """
    cols = [F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
            if dict(view.dtypes)[c] in ("double", "float") else F.col(c) for c in PAYLOAD_COLUMNS]
    return (view.withColumn("bucket", area_bucket(F.col("area_type")))
            .where(F.col("bucket").isNotNull())
            .select(*GROUP, "bucket", "station_id",
                    F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record")))


def payload_pages(view: DataFrame, page_rows: int = 5000) -> DataFrame:
    """The map payload as objects of three arrays (``{"urban": [...], "suburban": [...], "rural": [...]}``), in pages of
    up to ``page_rows`` records: ``country, pollutant, page, n_pages, payload``.

    Records stand by bucket, then by station id and record. Their places come from counts per sorted part and
    running sums (``number_rows``), so no group is sorted in one task, and a page is all that is ever gathered. The
    arrays of all pages, one after the other, are the arrays of the whole object."""
    names = [name for name, _ in BUCKETS]
    records = map_payload(view).withColumn("_bucket", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("bucket")))
    placed = number_rows(records, GROUP, ["_bucket", "station_id", "record"], "_place") \
        .withColumn("page", F.floor(F.col("_place") / page_rows).cast("int"))
    one = F.struct("_place", "record")
    pages = placed.groupBy(*GROUP, "page").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("bucket") == n, one))).alias(f"_{n}") for n in names])
    arrays = [F.concat(F.lit(f'"{n}":['), F.array_join(F.transform(f"_{n}", lambda r: r["record"]), ","), F.lit("]")) for n in names]
    total = placed.groupBy(*GROUP).agg((F.max("page") + 1).alias("n_pages"))      # one row per group
    return pages.select(*GROUP, "page", F.concat(F.lit("{"), F.concat_ws(",", *arrays), F.lit("}")).alias("payload")) \
        .join(total, GROUP).select(*GROUP, "page", "n_pages", "payload")


def write_map_payload(payload: DataFrame, path: str) -> str:
    """JSON-lines sink: one directory per (country, pollutant, bucket), one record per line."""
    (payload.select("record", *GROUP, "bucket")
        .write.mode("overwrite").partitionBy(*GROUP, "bucket").text(path))
    return path


def legend(pollutants: DataFrame, dim: DataFrame) -> DataFrame:
    """Legend rows per pollutant seen in the data: label, colour and range text
    ``lo–hi`` (``lo+`` for the open tier). Unknown pollutants use PM10's table."""
    d = F.broadcast(dim.select(F.col("pollutant").alias("_ep"), "tier", "lower", "upper", "label", "colour"))
    fmt = lambda c: F.regexp_replace(F.col(c).cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
    rng = F.when(F.col("upper") == F.lit(float("inf")), F.concat(fmt("lower"), F.lit("+"))) \
           .otherwise(F.concat(fmt("lower"), F.lit("–"), fmt("upper")))
    return (pollutants.select("pollutant").distinct()
            .withColumn("_ep", effective_pollutant(F.col("pollutant")))
            .join(d, "_ep").select("pollutant", "tier", "label", "colour", rng.alias("range_text")))


def station_count(files: DataFrame) -> DataFrame:
    """Per group: stations (one per file, as in the station table) and rows loaded, from ``station_files``."""
    return files.groupBy("country", "pollutant").agg(
        F.count(F.lit(1)).alias("stations"), F.sum("_n").alias("rows_loaded"))


def station_names(meta: DataFrame) -> DataFrame:
    """Non-null station names per group, for the picker (sorted on output)."""
    return meta.where(F.col("station_name").isNotNull()).select(*GROUP, "station_name")


def peak_days(daily: DataFrame, k: int = 5) -> DataFrame:
    """Top-k days by daily mean per pollutant; ties → earlier day (the limit is the feature).

    ``row_number <= k`` over a per-pollutant window is planned as a
    WindowGroupLimit, which keeps only k rows per partition before the shuffle.
    """
    w = Window.partitionBy("pollutant").orderBy(F.desc("AvgValue"), F.asc("Date"))
    return daily.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def peak_prompts(peaks: DataFrame) -> DataFrame:
    """The question text per (date, metric); the model call itself is not built."""
    return peaks.select("pollutant", "Date", "rank", F.format_string(
        PEAK_PROMPT, F.col("pollutant"), F.date_format("Date", "yyyy-MM-dd")).alias("prompt"))
