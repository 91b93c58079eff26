"""CSV station metadata: dialect discovery, row rule, file order, sink.

Dialect discovery looks at every line once, in one Spark job, and takes the
first pair of encoding and separator in the reference's order that can decode
the file and gives at least four columns and one row. The same job tells whether a
cell may hold a line break; only then is a file read whole by one task, otherwise it is split.

Row rule of the reference: a line with more fields than the header is skipped, empty fields counted, and a shorter one
is padded with nulls. Spark's PERMISSIVE mode marks lines with another number of fields than the schema; the text of
those alone is looked at again, and their separators outside of quotes are counted.
"""

from __future__ import annotations

import codecs
import csv
import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeris.operators.metadata import union_metadata
from aeris.operators.numbering import number_lines

# --- Fixed values: probing order of the reference ----------------------------
ENCODINGS = ["utf-8-sig", "utf-8", "utf-16", "utf-16le", "utf-16be", "latin-1", "cp1252"]
SEPARATORS = [",", ";", "\t", "|"]
MIN_COLUMNS = 4
# ---------------------------------------------------------------------------

_JAVA_ENCODING = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16", "utf-16le": "UTF-16LE",
                  "utf-16be": "UTF-16BE", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}


_UTF16 = ("utf-16", "utf-16le", "utf-16be")


def _reader(spark: SparkSession, sep: str, encoding: str, multi_line: bool):
    """Quoted cells may hold separators, doubled quotes and (``multi_line``) line breaks. A multi-line file is read
    by one task. Columns are not pruned: a line's fields must be counted."""
    r = (spark.read.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"')
         .option("encoding", _JAVA_ENCODING[encoding]).option("mode", "PERMISSIVE").option("columnPruning", "false")
         .option("enforceSchema", "true").option("recursiveFileLookup", "true")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false"))
    # line splitting works on bytes; UTF-16 text needs the charset-aware multi-line parser
    return r.option("multiLine", "true") if multi_line or encoding in _UTF16 else r


def _survey(spark: SparkSession, path: str):
    """One pass over every line of the file, as raw bytes: is any of them not UTF-8, does any hold a NUL
    (ASCII text in UTF-16) or an odd number of quotes, how many are not blank, and which is the first of those (the
    header)."""
    raw = F.col("value").cast("binary")
    blank = F.regexp_replace(F.hex(raw), "^((00|09|0A|0B|0C|0D|20)*)$", "") == ""
    quotes = F.length(F.col("value")) - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        (~F.is_valid_utf8(F.col("value"))).alias("bad"), F.contains(raw, F.lit(b"\x00")).alias("nul"),
        (quotes % 2 == 1).alias("odd"), F.when(~blank, F.hex(raw)).alias("line"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id()).alias("at"))
    return lines.agg(
        F.max("bad").alias("bad"), F.max("nul").alias("nul"), F.max("odd").alias("odd"), F.count("line").alias("n_lines"),
        F.min_by("line", F.when(F.col("line").isNotNull(), F.col("at"))).alias("header")).first()


def _dialect(seen) -> tuple[str, str] | None:
    if seen.header is None or seen.n_lines < 2:
        return None
    head = bytes.fromhex(seen.header)
    if seen.nul:
        fits = {"utf-16"} if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else \
            {"utf-16be"} if head[:1] == b"\x00" else {"utf-16le"}
    else:
        fits = {"latin-1", "cp1252"} if seen.bad else {"utf-8-sig", "utf-8"}

    def cells(pair: tuple[str, str]) -> int:
        text = head.decode(pair[0], errors="replace").strip("\x00\r")
        return max((len(row) for row in csv.reader([text], delimiter=pair[1])), default=0)

    pairs = [(enc, sep) for enc in ENCODINGS if enc in fits for sep in SEPARATORS]
    return next((pair for pair in pairs if cells(pair) >= MIN_COLUMNS), None)


def discover_dialect(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """First (encoding, separator), in the fixed order, that can decode the whole file and gives at least
    four header cells and one more line; None if there is none, or the file is empty.

    Whether an encoding fits is judged on all lines, in one Spark job: a separator is a byte of its own in
    each of them, so only the header (one line) is looked at on the driver. A header cell must not hold a
    line break. Big-endian UTF-16 without a byte-order mark starts with a NUL, little-endian does not."""
    return _dialect(_survey(spark, path))


def _fields(record: Column, sep: str) -> Column:
    """Number of fields of a record: its separators outside of quoted cells, and one. A quote opens a cell only where
    the cell begins; elsewhere it is an ordinary character."""
    s = re.escape(sep)
    bare = F.regexp_replace(record, f'(^|{s})"(?:[^"]|"")*+"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def read_csv_metadata(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8",
                      multi_line: bool | None = None, row_col: str | None = None) -> DataFrame:
    """All-string CSV read of a file or a folder of files with the reference's row rule (long rows skipped, short
    padded). ``multi_line=None`` looks whether any line has an odd number of quotes. ``row_col`` names a column with the
    number of each kept row, over all files in the order of their paths ("the first row" of what is read)."""
    if multi_line is None:
        multi_line = bool(_survey(spark, path).odd)
    header = _reader(spark, sep, encoding, multi_line).csv(path).columns
    names = [c.lstrip("﻿") for c in header]
    corrupt = "_corrupt"
    schema = T.StructType([*(T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))),
                           T.StructField(corrupt, T.StringType())])
    rows = _reader(spark, sep, encoding, multi_line).schema(schema).option("columnNameOfCorruptRecord", corrupt).csv(path)
    # always true, and keeps a cell in the scan: Spark refuses one that asks for the marked lines alone (a plain count)
    some_cell = F.coalesce(F.length("_c0"), F.lit(0)) >= 0
    kept = rows.where((F.col(corrupt).isNull() | (_fields(F.col(corrupt), sep) <= len(names))) & some_cell)
    if row_col is None:
        return kept.drop(corrupt).toDF(*names)
    return number_lines(kept.drop(corrupt), "_row").toDF(*names, row_col)


def read_csv_discovered(spark: SparkSession, path: str, row_col: str | None = None) -> DataFrame | None:
    seen = _survey(spark, path)
    found = _dialect(seen)
    if found is None:
        return None
    enc, sep = found
    return read_csv_metadata(spark, path, sep=sep, encoding=enc, multi_line=bool(seen.odd), row_col=row_col)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8") -> str:
    """CSV sink with header (one directory of part files)."""
    (df.write.mode("overwrite").option("header", "true").option("sep", sep).option("escape", '"')
       .option("encoding", _JAVA_ENCODING[encoding])
       .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return path


def _rows_of(source, k: int) -> DataFrame | None:
    """What a source (a DataFrame or a zero-argument callable) yields; None if it is empty, or fails while it is built
    or read, which is reported by a warning that names the error."""
    try:
        df = source() if callable(source) else source
        if df is not None and not df.limit(1).isEmpty():
            return df
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"source {k} skipped: {type(e).__name__}: {str(e)[:200]}", stacklevel=3)
    return None


def first_non_empty(*sources, default: DataFrame | None = None) -> DataFrame | None:
    """The first source that yields rows, else ``default``. Later sources are not touched."""
    return next((df for df in (_rows_of(s, k) for k, s in enumerate(sources)) if df is not None), default)


def union_available(*sources) -> DataFrame | None:
    """All sources that yield rows as one frame (columns that some lack are null there); None if none does."""
    frames = [df for df in (_rows_of(s, k) for k, s in enumerate(sources)) if df is not None]
    return union_metadata(*frames) if frames else None
