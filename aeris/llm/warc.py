"""Content-addressed WARC archive.

Each page becomes one WARC record. The archive is two Parquet tables: ``payloads`` holds the bytes of each
distinct payload once, under its SHA-256, and ``headers`` holds the exact header bytes of every record with
the digest of its payload. ``records`` joins them back to the original record bytes; ``read_records`` parses
headers and checks every payload against both digests.

Payload: the html in UTF-8 (null: empty). Of records with equal payloads of at least ``min_revisit_bytes``
bytes the one with the largest id is the response (of fully equal ids one of them) and the others are
revisits that refer to it; smaller payloads are always responses, stored once as well. A null id is written
as an empty id and loses against every other. Other columns are ignored; an empty table gives empty tables.

Equal digests are taken as equal bytes only after a check: a SHA-256 with two SHA-1 values or two lengths
stops the write. The payload table is shuffled by digest and row, never all copies of one payload into
one task: only the response row of a group carries its bytes.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import as_bytes, sliced, stored
from aeris.session import scratch_path

_VERSION = "WARC/1.1"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _described(batches):
    """Digests and the compressed payload of each page."""
    import pyarrow as pa
    import zstandard
    pack = zstandard.ZstdCompressor(level=1)
    for b in sliced(batches, column=2):
        data = as_bytes(b.column(2))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
             pa.array([sha1_base32(x) for x in data], pa.string()), pa.array([len(x) for x in data], pa.int64()),
             pa.array([pack.compress(x) for x in data], pa.binary())],
            names=["page_id", "url", "sha256", "sha1", "n_bytes", "packed"])


def _uri(url):
    """A header value stays on one line: line ends in an address are percent-encoded."""
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _header(kind: str):
    """Exact header bytes of a record (the payload follows them)."""
    id_ = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lines = [F.lit(_VERSION), F.lit(f"WARC-Type: {kind}"),
             F.concat(F.lit("WARC-Record-ID: <urn:page:"), id_, F.lit(">")),
             F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))), F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))]
    if kind == "revisit":
        lines += [F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.coalesce(F.col("response_id").cast("string"), F.lit("")),
                           F.lit(">"))]
    size = F.lit("0") if kind == "revisit" else F.col("n_bytes").cast("string")
    lines += [F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), size)]
    return F.concat_ws("\r\n", *lines, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit_bytes: int = 0) -> None:
    """Write ``path/payloads`` and ``path/headers``."""
    three = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).alias("html"))
    described = three.mapInArrow(
        _described, "page_id long, url string, sha256 binary, sha1 string, n_bytes long, packed binary") \
        .withColumn("row", F.monotonically_increasing_id())
    all_rows = stored(described, "warc-described")  # digests and payloads once; later steps read columns of it
    small = all_rows.drop("packed")
    # one row per digest: the largest id, then the last row; a digest stands for one SHA-1 and one length
    groups = stored(small.groupBy("sha256").agg(
        F.max(F.struct(F.col("page_id").alias("id"), "row")).alias("last"), F.count(F.lit(1)).alias("n"),
        F.min("sha1").alias("sha1_min"), F.max("sha1").alias("sha1_max"), F.min("n_bytes").alias("len_min"),
        F.max("n_bytes").alias("len_max")), "warc-groups")
    if not groups.where("sha1_min <> sha1_max or len_min <> len_max").isEmpty():
        raise ValueError("one SHA-256 stands for payloads with different SHA-1 values or lengths")
    chosen = groups.select("sha256", F.col("last.id").alias("response_id"), F.col("last.row").alias("response_row"))
    # the bytes: rows that are the chosen one of their digest
    keys = chosen.select(F.col("response_row").alias("row"))
    all_rows.select("row", "sha256", "n_bytes", "packed").join(keys, "row", "left_semi").drop("row") \
        .write.mode("overwrite").parquet(f"{path}/payloads")
    typed = small.join(chosen, "sha256").withColumn(
        "is_response", (F.col("row") == F.col("response_row")) | (F.col("n_bytes") < min_revisit_bytes))
    header = F.when(F.col("is_response"), _header("response")).otherwise(_header("revisit")).cast("binary")
    typed.select("sha256", header.alias("header")).write.mode("overwrite").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``header, payload, record``: every record's exact bytes, the payload joined by digest. A revisit has
    the payload it refers to, and a record without a block."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")

    def run(batches):
        import pyarrow as pa
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for b in sliced(batches, 4 << 20):
            heads = b.column(0).to_pylist()
            data = [unpack.decompress(x, max_output_size=n) if n else b"" for x, n in
                    zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            whole = [h + (b"" if b"\r\nWARC-Type: revisit\r\n" in h else d) + b"\r\n\r\n"
                     for h, d in zip(heads, data, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (heads, data, whole)],
                                             names=["header", "payload", "record"])

    return headers.join(payloads, "sha256").select("header", "packed", "n_bytes") \
        .mapInArrow(run, "header binary, payload binary, record binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive read back, one row per record: header fields, and the digest and length of the stored bytes.

    Every stored payload is unpacked and hashed once, where it lies; headers then meet the verified
    facts by digest, so that a payload with very many revisits is not copied to each of them. A payload that does
    not match its address, or a header with another SHA-1, fails the read."""
    def verified(batches):
        import pyarrow as pa
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for b in sliced(batches, 4 << 20, column=2):
            sha1 = []
            for key, n, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = unpack.decompress(x, max_output_size=n) if n else b""
                if hashlib.sha256(data).digest() != key or len(data) != n:
                    raise ValueError(f"payload {key.hex()} does not match its digest")
                sha1.append(sha1_base32(data))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sha1, pa.string())],
                                             names=["sha256", "payload_bytes", "payload_digest"])

    facts = spark.read.parquet(f"{path}/payloads").select("sha256", "n_bytes", "packed") \
        .mapInArrow(verified, "sha256 binary, payload_bytes long, payload_digest string")
    text = F.col("header").cast("string")
    field = lambda name, body: F.regexp_extract(text, rf"\r\n{name}: {body}\r\n", 1)
    headers = spark.read.parquet(f"{path}/headers").select(
        "sha256", F.nullif(field("WARC-Record-ID", "<urn:page:(-?\\d*)>"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Type", "(\\w+)").alias("record_type"), field("WARC-Target-URI", "([^\\r\\n]*)").alias("target_uri"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("header_digest"),
        F.nullif(field("WARC-Refers-To", "<urn:page:(-?\\d*)>"), F.lit("")).cast("long").alias("refers_to"))
    joined = headers.join(facts, "sha256")
    checked = F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")) \
        .otherwise(F.raise_error(F.lit("a header's digest differs from its payload's")).cast("string"))
    return joined.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "target_uri")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archive of all pages to the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "warc-archive")
    write_archive(pages, path)
    return read_records(pages.sparkSession, path)
