"""Cleaning and filtering of readings and historic rows."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeris.functions.timefmt import ntz_lit, parse_time

LIVE_WINDOW_DAYS = 7


def valid_value(c: Column) -> Column:
    """Usable measurement: not null, not NaN, not negative (the −999 sentinel); 0 stays."""
    return c.isNotNull() & ~F.isnan(c) & (c >= F.lit(0.0))


def parse_readings(raw: DataFrame) -> DataFrame:
    """Start parsed by type (ns integer or text → wall clock); Value coerced to double."""
    out = parse_time(raw, "Start")
    return out.withColumn("Value", F.col("Value").try_cast("double"))


def clean_readings(raw: DataFrame) -> DataFrame:
    """Parsed readings without null times, null/NaN values or negative sentinels."""
    parsed = parse_readings(raw)
    return parsed.where(F.col("Start").isNotNull() & valid_value(F.col("Value")))


def as_of_time(parsed: DataFrame):
    """Default "now" for the live window: the latest reading time, evaluated once
    (one scalar) so the window predicate becomes a literal pushed into the scan."""
    return parsed.agg(F.max("Start")).first()[0]


def last_days(clean: DataFrame, as_of: Column | str | _dt.datetime | None = None,
              days: int = LIVE_WINDOW_DAYS, reference: DataFrame | None = None) -> DataFrame:
    """Rows with ``Start >= as_of − days``. ``as_of`` defaults to the latest time seen
    in ``reference`` (or ``clean``)."""
    if as_of is None:
        as_of = as_of_time(reference if reference is not None else clean)
    if isinstance(as_of, Column):
        cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    else:
        if isinstance(as_of, str):
            as_of = _dt.datetime.fromisoformat(as_of)
        cutoff = ntz_lit(as_of - _dt.timedelta(days=days))
    return clean.where(F.col("Start") >= cutoff)


def between_days(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "Date") -> DataFrame:
    """Closed calendar-day range on a timestamp column (pushed to the scan as a range); ``None`` is open."""
    day = F.to_date(F.col(col))
    if start is not None:
        df = df.where(day >= F.lit(start).cast("date"))
    return df if end is None else df.where(day <= F.lit(end).cast("date"))


def on_day(df: DataFrame, day: str, col: str = "Date") -> DataFrame:
    return df.where(F.to_date(F.col(col)) == F.lit(day).cast("date"))


def with_coords(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Rows with both coordinates (null and NaN dropped)."""
    return df.dropna(subset=[lat, lon])


def time_range(df: DataFrame, start: str, end: str, end_mode: str = "day",
               col: str = "Start") -> DataFrame:
    """Inclusive time range. ``end_mode='midnight'`` reproduces the reference's
    year filter whose upper bound is midnight of the last day (later hours lost);
    ``'day'`` keeps the whole last day."""
    lo = F.lit(start).cast("timestamp_ntz")
    if end_mode == "midnight":
        return df.where((F.col(col) >= lo) & (F.col(col) <= F.lit(end).cast("timestamp_ntz")))
    if end_mode != "day":
        raise ValueError(f"end_mode must be 'day' or 'midnight', not {end_mode!r}")
    hi = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))
