"""Colour ramp for the historic map.

The dashboard samples the public palette "Wistia" (yellow to orange) at
``value / 240``. A named palette is a table of 256 colours, interpolated
between its stops, so a value takes entry ``floor(256 * t)`` (at most 255).
Alpha (180) and the missing rule (all zero) are the reference's.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 240.0
ALPHA = 180
ENTRIES = 256
# --- Fixed values: stops of the palette "Wistia", position → (r, g, b) of 255 ---
STOPS = [
    (0.00, (228, 255, 122)),
    (0.25, (255, 232, 26)),
    (0.50, (255, 189, 0)),
    (0.75, (255, 160, 0)),
    (1.00, (252, 127, 0)),
]
# ---------------------------------------------------------------------------


def palette(ch: int) -> list[int]:
    """Channel ``ch`` of the 256 palette colours: linear between the stops, truncated to whole numbers."""
    out = []
    for i in range(ENTRIES):
        t = Fraction(i, ENTRIES - 1)
        (p0, c0), (p1, c1) = next((a, b) for a, b in zip(STOPS, STOPS[1:]) if t <= b[0])
        out.append(int(c0[ch] + (t - Fraction(p0)) / (Fraction(p1) - Fraction(p0)) * (c1[ch] - c0[ch])))
    return out


def clip_value(v: Column, cap: float = CAP) -> Column:
    """Null and NaN → 0 (missing), then clip to [0, cap]."""
    return F.least(F.greatest(F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(cap))


def ramp_columns(clipped: Column, missing: Column) -> dict[str, Column]:
    entry = F.least(F.floor(clipped / F.lit(CAP) * F.lit(ENTRIES)), F.lit(ENTRIES - 1)).cast("int") + F.lit(1)
    out = {}
    for i, name in enumerate(("color_r", "color_g", "color_b")):
        out[name] = F.when(missing, F.lit(0)).otherwise(F.element_at(F.lit(palette(i)), entry))
    out["color_a"] = F.when(missing, F.lit(0)).otherwise(F.lit(ALPHA))
    return out
