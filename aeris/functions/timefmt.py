"""Time parsing, flooring and formatting on wall-clock (TIMESTAMP_NTZ) values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = "1970-01-01 00:00:00"

# --- Fixed values: display formats of the reference (Python strftime → Spark) ---
# "%Y-%m-%d %H:%M"      chart axis text
# "%d %b %Y, %H:%M"     frame header
# "%a %d %b, %H:%M"     worst/best time on a station card
# "%d %b, %H:%M"        slider / tooltip
FMT_AXIS = "yyyy-MM-dd HH:mm"
FMT_HEADER = "dd MMM yyyy, HH:mm"
FMT_CARD = "EEE dd MMM, HH:mm"
FMT_SLIDER = "dd MMM, HH:mm"
# ---------------------------------------------------------------------------


def _epoch() -> Column:
    return F.lit(_EPOCH).cast("timestamp_ntz")


def from_epoch_nanos(c: Column) -> Column:
    """Integer nanoseconds since epoch → TIMESTAMP_NTZ (sub-microseconds dropped).

    Exact decimal division: a double division would lose microseconds at
    today's magnitudes (~1.7e18 ns).
    """
    micros = F.floor(c.cast("decimal(38,0)") / F.lit(1000)).cast("long")
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def _try_cast_ntz(c: Column) -> Column:
    return c.try_cast(T.TimestampNTZType())


def parse_time(df: DataFrame, col: str = "Start") -> DataFrame:
    """Parse ``col`` by its type, decided at plan time (no per-row type test)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.DecimalType, T.DoubleType, T.FloatType)):
        parsed = from_epoch_nanos(F.col(col))
    elif isinstance(dtype, T.TimestampNTZType):
        parsed = F.col(col)
    elif isinstance(dtype, T.TimestampType):
        parsed = instant_to_ntz(F.col(col))          # zoned instant: its UTC wall clock
    elif isinstance(dtype, T.DateType):
        parsed = F.col(col).cast("timestamp_ntz")
    else:
        parsed = _try_cast_ntz(F.col(col).cast("string"))
    return df.withColumn(col, parsed)


def floor_hour(c: Column) -> Column:
    """Hour bucket of a wall-clock time, kept as TIMESTAMP_NTZ.

    Pure wall-clock arithmetic (whole hours since the epoch), so the result does
    not depend on the session time zone or its daylight-saving gaps, as a
    ``date_trunc`` round trip through TIMESTAMP would.
    """
    hours = F.timestamp_diff("HOUR", _epoch(), c)
    up = F.timestamp_add("HOUR", hours, _epoch())
    return F.when(up > c, F.timestamp_add("HOUR", hours - F.lit(1), _epoch())).otherwise(up)


def ntz_lit(value) -> Column:
    """A wall-clock literal (datetime or text) as TIMESTAMP_NTZ, independent of any zone.

    A Python ``datetime`` literal would be read in the Python process's local
    zone; its ISO text cast to TIMESTAMP_NTZ is not.
    """
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def ntz_to_instant(c: Column) -> Column:
    """Wall clock → TIMESTAMP instant read as UTC, whatever the session zone
    (watermarks and stream windows need TIMESTAMP)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), c))


def instant_to_ntz(c: Column) -> Column:
    """Inverse of ``ntz_to_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch())
