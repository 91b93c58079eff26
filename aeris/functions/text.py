"""Value text for tooltips and cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: text of missing values --------------------------------
MISSING_TEXT = "N/A"
NO_LABEL_TEXT = "—"
# ---------------------------------------------------------------------------


def fixed_decimals(c: Column, digits: int, missing: str | None = MISSING_TEXT) -> Column:
    """``v`` with ``digits`` decimals as text, rounding half up on the decimal value.

    Going through DECIMAL(18,6) first fixes the binary noise of doubles, so both
    this and the DuckDB oracle print 0.125 → "0.13" (Python's printf would say
    "0.12"; a documented deviation on exact ties only).
    """
    dec = c.try_cast("decimal(18,6)").cast(f"decimal(18,{digits})").cast("string")
    # infinities, and values beyond the decimal's range, print as floating-point text
    inf = F.lit(float("inf"))
    plain = F.when(c == inf, F.lit("inf")).when(c == -inf, F.lit("-inf")).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))
    valid = c.isNotNull() & ~F.isnan(c)
    out = F.when(valid, F.coalesce(dec, plain))
    return out.otherwise(F.lit(missing)) if missing is not None else out
