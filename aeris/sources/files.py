"""Readings as Parquet files, manifests and tolerant scans.

The reference downloads one Parquet file per station series, found through a
manifest (one URL per line), and reads them with 20 threads. Here readings
live in a shared folder laid out the way a Spark table should be:

* directories per ``country=…/pollutant=…`` (the request predicates become
  partition pruning);
* rows range-partitioned by (country, pollutant, series, time) before writing,
  so a group, or one series, holding a third of all rows is split over several
  tasks and files, and each file holds contiguous, sorted series (Parquet
  min/max statistics then skip row groups for a series or time predicate); the
  number of tasks is left to adaptive execution;
* no file per series — that would be the small-file problem at scale.

``write_manifest`` lists the files and the scans read them back as one
multi-file Spark scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeris.functions.keys import short_id, strip_all

# --- Fixed values: manifest header of the download service -------------------
MANIFEST_HEADER = "ParquetFileUrl"
# ---------------------------------------------------------------------------

SERIES_SCHEMA = T.StructType([
    T.StructField("Samplingpoint", T.StringType()),
    T.StructField("Start", T.TimestampNTZType()),
    T.StructField("Value", T.DoubleType()),
    T.StructField("country", T.StringType()),
    T.StructField("pollutant", T.StringType()),
])
PARTITIONS = ["country", "pollutant"]
DATASET = "dataset"
ROWS_PER_FILE = 5_000_000


def _by_range(df: DataFrame, num_partitions: int | None, *cols: str) -> DataFrame:
    """Range partitioning; without a number, adaptive execution merges small partitions by their bytes."""
    return df.repartitionByRange(*([num_partitions] if num_partitions else []), *cols)


def write_series(raw: DataFrame, root: str, num_partitions: int | None = None, releases: bool = False) -> str:
    """Write readings under ``root`` partitioned by country and pollutant, with ``releases`` by ``dataset`` above them."""
    folders = [DATASET, *PARTITIONS] if releases else PARTITIONS
    keyed = raw.withColumn("_series", short_id(F.col("Samplingpoint")))
    (_by_range(keyed, num_partitions, *folders, "_series", "Start")
        .sortWithinPartitions(*folders, "_series", "Start")
        .drop("_series")
        .write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*folders).parquet(root))
    return root


def _series_schema(start_type: str, value_type: str = "double", releases: bool = False) -> T.StructType:
    types = {"Start": {"timestamp": T.TimestampNTZType(), "nanos": T.LongType(), "text": T.StringType()}[start_type],
             "Value": {"double": T.DoubleType(), "text": T.StringType()}[value_type]}
    out = T.StructType([T.StructField(f.name, types.get(f.name, f.dataType)) for f in SERIES_SCHEMA.fields])
    return out.add(DATASET, T.IntegerType()) if releases else out


def scan_readings(spark: SparkSession, paths: list[str] | str, tolerant: bool = False,
                  base_path: str | None = None, start_type: str = "timestamp",
                  value_type: str = "double", releases: bool = False) -> DataFrame:
    """Multi-file scan with a declared schema; ``url`` is the file each row came from. ``releases``: the readings are
    stored by ``dataset`` too, which becomes a column.

    ``tolerant`` leaves out files that cannot be read in full (a failing file
    contributes nothing, as in the reference's per-file try/except) instead of
    failing the job; ``skipped_files`` lists them. This costs a second pass, so it is off by default.
    ``start_type`` says how the files store ``Start``: ``timestamp`` (wall clock), ``nanos`` (Parquet
    TIMESTAMP(NANOS) as written by pandas — read as integer nanoseconds; the
    session must set ``spark.sql.legacy.parquet.nanosAsLong``) or ``text``; the last two are
    parsed to wall-clock TIMESTAMP_NTZ. ``value_type='text'`` reads text values and
    coerces them to double (bad text → null, dropped later by the cleaning).
    """
    if start_type == "nanos" and spark.conf.get(_NANOS, "false") != "true":
        raise ValueError(f"nanosecond times need a session with {_NANOS}=true")
    df = _open(spark, paths, _series_schema(start_type, value_type, releases), base_path, tolerant) \
        .withColumn("url", F.col("_metadata.file_path"))
    if tolerant:
        bad = skipped_files(spark, paths, base_path, start_type, value_type).select(F.col("path").alias("url"))
        df = df.join(bad, "url", "left_anti").select(*df.columns)
    if start_type != "timestamp":
        from aeris.functions.timefmt import parse_time
        df = parse_time(df, "Start")
    if value_type == "text":
        df = df.withColumn("Value", F.col("Value").try_cast("double"))
    return df


_NANOS = "spark.sql.legacy.parquet.nanosAsLong"


def _open(spark: SparkSession, paths: list[str] | str, schema: T.StructType, base_path: str | None,
          tolerant: bool) -> DataFrame:
    reader = spark.read.schema(schema)
    if base_path:
        reader = reader.option("basePath", base_path)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def list_files(spark: SparkSession, paths: list[str] | str, base_path: str | None = None) -> DataFrame:
    """One row per file, ``path``; no file is opened (the source's content column is not asked for)."""
    reader = spark.read.format("binaryFile")
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.load([paths] if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"))


def skipped_files(spark: SparkSession, paths: list[str] | str, base_path: str | None = None,
                  start_type: str = "timestamp", value_type: str = "double") -> DataFrame:
    """Files that a tolerant scan leaves out: ``path, rows_stored, rows_read``.

    A file counts as readable when a tolerant read of all its columns yields as many rows as its footer
    states (a read of no column touches footers only). ``rows_stored`` is null where the footer itself is
    unreadable, or the file holds no row."""
    schema = _series_schema(start_type, value_type)
    rows = _open(spark, paths, schema, base_path, tolerant=True).withColumn("path", F.col("_metadata.file_path"))
    stored = rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows_stored"))
    kept = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows_read"),
        *[F.count(c).alias(f"_{c}") for c in schema.fieldNames() if c not in PARTITIONS])
    return (list_files(spark, paths, base_path).join(stored, "path", "left")
            .join(kept.withColumn("_all", F.col("_Start") + F.col("_Value") + F.col("_Samplingpoint")), "path", "left")
            .where(F.col("rows_stored").isNull() | ~F.col("rows_read").eqNullSafe(F.col("rows_stored"))
                   | F.col("_all").isNull())
            .select("path", "rows_stored", F.coalesce("rows_read", F.lit(0)).alias("rows_read")))


def with_series(scan: DataFrame) -> DataFrame:
    """Station id of each row: the Samplingpoint's tail, else the file name's."""
    return scan.withColumn("series", short_id(F.coalesce(F.col("Samplingpoint"), F.col("url"))))


def write_manifest(spark: SparkSession, series_root: str, manifest_dir: str) -> str:
    """List the files as a manifest: header line, a blank line, padded paths.

    One row per file from the listing; the manifest is written sorted by path.
    """
    files = list_files(spark, series_root).select(F.col("path").alias("p"))
    body = files.select(F.concat(F.lit("  "), F.col("p"), F.lit(" ")).alias("value"), F.col("p").alias("_k"))
    extra = spark.createDataFrame([(MANIFEST_HEADER, ""), ("", "")], "value string, _k string")
    (extra.unionByName(body).orderBy("_k").select("value")
        .write.mode("overwrite").text(manifest_dir))
    return manifest_dir


def manifest_entries(spark: SparkSession, manifest: str) -> DataFrame:
    """Manifest → (pos, path): trimmed lines without blanks or the header line.

    ``pos`` orders entries as in the manifest (file path, then position in it).
    """
    lines = spark.read.text(manifest).select(
        strip_all(F.col("value")).alias("path"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line")).alias("pos"))
    return (lines.where((F.col("path") != "") & ~F.col("path").contains(MANIFEST_HEADER))
            .select("pos", "path"))


def manifest_first(entries: DataFrame) -> DataFrame:
    """The first manifest entry (one row)."""
    return entries.agg(F.min_by("path", "pos").alias("path"))


def _bare(path: F.Column) -> F.Column:
    """A path without scheme and host, percent codes decoded: the same for every spelling of one file."""
    p = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.coalesce(F.try_url_decode(p), p)


def read_manifest(spark: SparkSession, entries: DataFrame, base_path: str, tolerant: bool = False,
                  start_type: str = "timestamp", value_type: str = "double") -> DataFrame:
    """Scan the files a manifest lists.

    Only the folders they lie in reach the driver (one per country and pollutant, however many files); the
    files themselves are chosen by a semi join on their path. A listed file that is not there fails the
    call, unless ``tolerant``.
    """
    folders = [r.d for r in entries.select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct().collect()]
    listed = entries.select(_bare(F.col("path")).alias("_p")).distinct()
    if not folders:
        return _open(spark, base_path, _series_schema("timestamp"), None, tolerant) \
            .withColumn("url", F.col("_metadata.file_path")).limit(0)
    if not tolerant:
        there = list_files(spark, folders, base_path).select(_bare(F.col("path")).alias("_p"))
        absent = [r[0] for r in listed.join(there, "_p", "left_anti").limit(5).collect()]
        if absent:
            raise FileNotFoundError(f"listed in the manifest but absent, among others: {absent}")
    scan = scan_readings(spark, folders, tolerant=tolerant, base_path=base_path,
                         start_type=start_type, value_type=value_type)
    return scan.withColumn("_p", _bare(F.col("url"))).join(listed, "_p", "left_semi").drop("_p")


def select_partition(series: DataFrame, countries: list[str] | None = None,
                     pollutants: list[str] | None = None, start: str | None = None,
                     end: str | None = None, datasets: list[int] | None = None) -> DataFrame:
    """The download request as predicates: partition columns (``dataset`` too, where readings are stored by release)
    prune directories,
    the time range is pushed into the Parquet scan. ``None`` means no restriction; an empty list selects nothing."""
    out = series if datasets is None else series.where(F.col(DATASET).isin(datasets))
    if countries is not None:
        out = out.where(F.col("country").isin(countries))
    if pollutants is not None:
        out = out.where(F.col("pollutant").isin(pollutants))
    if start:
        out = out.where(F.col("Start") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col("Start") <= F.lit(end).cast("timestamp_ntz"))
    return out


HISTORIC_SCHEMA = T.StructType([
    T.StructField("Date", T.TimestampNTZType()), T.StructField("Value", T.DoubleType()),
    T.StructField("Latitude", T.DoubleType()), T.StructField("Longitude", T.DoubleType()),
    T.StructField("pollutant", T.StringType()),
])


def write_historic(hist: DataFrame, root: str, num_partitions: int | None = None) -> str:
    """The historic table as one dataset partitioned by pollutant (the reference keeps
    one database table per pollutant). Range-partitioned on (pollutant, Date, place), so one bulk-loaded day is split too, and
    sorted by Date within files, so a pollutant prunes directories and a date range
    skips row groups; a pollutant with most of the rows is spread over many files."""
    (_by_range(hist, num_partitions, "pollutant", "Date", "Latitude", "Longitude")
        .sortWithinPartitions("pollutant", "Date")
        .write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("pollutant").parquet(root))
    return root


def scan_historic(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(HISTORIC_SCHEMA).parquet(root).select(
        "pollutant", "Date", "Value", "Latitude", "Longitude")
