"""Station identifiers and column-name normalisation."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading/trailing whitespace of any kind (Spark's trim only removes spaces).
_EDGE_SPACE = r"^\s+|\s+$"
BYTE_ORDER_MARK = "\ufeff"
NAME_BREAKS = "-./"


def strip_all(c: Column) -> Column:
    """Trim every kind of leading/trailing whitespace, like Python's ``str.strip``."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def short_id(c: Column) -> Column:
    """Trimmed text after the last ``/`` (unchanged when there is none)."""
    return F.substring_index(strip_all(c), "/", -1)


def normalize_key(c: Column) -> Column:
    """Join key for station ids: trimmed and lower case."""
    return F.lower(strip_all(c))


def station_key(c: Column) -> Column:
    return normalize_key(short_id(c))


def snake_case(name: str) -> str:
    """Column rename used when cleaning metadata: lower case, spaces → ``_``."""
    return name.lower().replace(" ", "_")


def norm_col_name(name: str) -> str:
    """Header name without byte-order mark and outer white space, in lower case, where every run
    of white space, hyphens, dots and slashes is one ``_``."""
    text = name.replace(BYTE_ORDER_MARK, "").strip().lower()
    runs = groupby(text, key=lambda ch: ch.isspace() or ch in NAME_BREAKS)
    return "".join("_" if is_break else "".join(chars) for is_break, chars in runs)
