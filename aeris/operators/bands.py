"""Which band of a table of any size a value falls into.

The index has 24 bands, which a broadcast range join serves (``functions.eaqi``). Limits per station, season or permit
are a table that grows with the data, and a range condition alone would become a nested-loop join. Here a band
gets a level, a width (a power of 16) at or above its own, and the one or two bins of that width which it meets; a
value's bin follows from it. Band and value then meet by equality on (keys, bin), one plain hash or sort-merge join
per level that spreads a hot key over its bins, and the range condition is checked on the few bands of that bin.
Spark's estimate of the band side misses the rows that an ``explode`` adds, here or in how the bands were made, so the
bands of a level are counted first, and only few of them may be sent whole to every executor.

Bands without a lower or upper bound are a level of their own, joined on the keys alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = 4              # levels are powers of 2 ** 4
_OPEN = 1 << 20        # the level of bands that are open on some side
_LEAST = 2.0 ** -1000  # narrower bands count as this wide
_FEW = 20_000          # a level of more bands is never broadcast


def _level(lower: Column, upper: Column) -> Column:
    is_open = lower.isNull() | upper.isNull() | (lower == -math.inf) | (upper == math.inf)
    width = F.greatest(upper - lower, F.lit(_LEAST))
    return F.when(is_open, F.lit(_OPEN)).otherwise((F.ceil(F.log2(width) / _STEP) * _STEP).cast("int"))


def _bin(value: Column, level: int) -> Column:
    return F.floor(value / F.lit(2.0 ** level)).cast("long")


def band_join(values: DataFrame, bands: DataFrame, keys: list[str], value: str, lower: str = "lower", upper: str = "upper",
              lower_closed: str | None = None) -> DataFrame:
    """``values`` with the columns of the band of the same ``keys`` that holds ``value``: above ``lower``, up to and with
    ``upper``. ``lower_closed`` names a boolean column of bands whose lower bound counts too. Null bounds are open.

    Null, NaN and unmatched values get null band columns. The bands of one key must not overlap; where they do, a value
    gets each of those of the narrowest level that holds it. The levels that occur and their numbers of bands reach the
    driver: as many as there are orders of magnitude among the widths."""
    rest = [c for c in bands.columns if c not in keys]
    marked = bands.withColumn("_level", _level(F.col(lower), F.col(upper)))
    out, v = values, F.col(value)
    matched: list[str] = []
    for level, n in sorted(map(tuple, marked.groupBy("_level").count().collect())):
        mine = marked.where(F.col("_level") == level)
        names = {c: f"_b{level}_{c}".replace("-", "m") for c in rest}
        bin_name, hit = f"_bin{level}".replace("-", "m"), f"_hit{level}".replace("-", "m")
        on = list(keys)
        if level != _OPEN:
            # a band is no wider than a bin: it meets its first bin and perhaps the next one
            mine = mine.withColumn(bin_name, F.explode(F.array_distinct(F.array(_bin(F.col(lower), level), _bin(F.col(upper), level)))))
            out = out.withColumn(bin_name, _bin(v, level))
            on.append(bin_name)
        side = mine.select(*(F.col(c).alias(f"_k_{c}") for c in on), *(F.col(c).alias(names[c]) for c in rest), F.lit(True).alias(hit))
        if n > _FEW:
            side = side.hint("merge")
        lo, hi = F.col(names[lower]), F.col(names[upper])
        above = lo.isNull() | (v > lo)
        if lower_closed is not None:
            above |= (v == lo) & F.col(names[lower_closed])
        inside = above & (hi.isNull() | (v <= hi)) & ~F.isnan(v)
        for m in matched:       # found in a narrower level
            inside &= F.col(m).isNull()
        for c in on:
            inside &= F.col(c) == F.col(f"_k_{c}")
        out = out.join(side, inside, "left").drop(*(f"_k_{c}" for c in on), bin_name)
        matched.append(hit)
    found = {c: F.coalesce(*[F.col(h.replace("_hit", "_b") + f"_{c}") for h in matched]) if matched
             else F.lit(None).cast(bands.schema[c].dataType) for c in rest}
    return out.select(*values.columns, *(found[c].alias(c) for c in rest))
