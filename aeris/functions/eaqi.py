"""European Air Quality Index tiers as column expressions and as a dimension.

The tier lookup is a theta join "first upper bound >= value". With at most six
tiers per pollutant it is written as a CASE WHEN chain (stays inside
whole-stage codegen, no join); ``eaqi_dim`` gives the same bands as a literal
24-row table for range-join and legend/band outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: must equal the reference's index definition -------------
# Per pollutant, the upper bound (µg/m³) of each tier, lowest tier first;
# the last tier is open-ended.
THRESHOLDS = {
    "PM2.5": [5, 15, 50, 90, 140, float("inf")],
    "PM10": [15, 45, 120, 195, 270, float("inf")],
    "NO2": [10, 25, 60, 100, 150, float("inf")],
    "O3": [60, 100, 120, 160, 180, float("inf")],
}
LABELS = ["Good", "Fair", "Moderate", "Poor", "Very poor", "Extremely poor"]
COLOURS = ["#4477AA", "#77AADD", "#DDCC77", "#EE7733", "#CC3311", "#882255"]
DEFAULT_POLLUTANT = "PM10"
# Style of rows without a usable value
NO_DATA_LABEL = "No data"
NO_DATA_RGB = (128, 128, 128)
STYLE_ALPHA = 220
# Colour used when a label has no entry, and the label for unlabelled rows
FALLBACK_COLOUR = "#888"
UNKNOWN_LABEL = "Unknown"
# ---------------------------------------------------------------------------

LABEL_ORDER = LABELS + [UNKNOWN_LABEL]

DIM_SCHEMA = T.StructType([
    T.StructField("pollutant", T.StringType(), False),
    T.StructField("tier", T.IntegerType(), False),
    T.StructField("lower", T.DoubleType(), False),
    T.StructField("upper", T.DoubleType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("colour", T.StringType(), False),
])


def dim_rows() -> list[tuple]:
    rows = []
    for pollutant, uppers in THRESHOLDS.items():
        lower = 0.0
        for tier, (upper, label, colour) in enumerate(zip(uppers, LABELS, COLOURS), start=1):
            rows.append((pollutant, tier, float(lower), float(upper), label, colour))
            lower = float(upper)
    return rows


def eaqi_dim(spark: SparkSession) -> DataFrame:
    """The 24-row threshold dimension (size fixed by definition → safe to broadcast)."""
    return spark.createDataFrame(dim_rows(), DIM_SCHEMA)


def effective_pollutant(pollutant: Column) -> Column:
    """Pollutants without their own table fall back to PM10."""
    return F.when(pollutant.isin(list(THRESHOLDS)), pollutant).otherwise(F.lit(DEFAULT_POLLUTANT))


def _by_pollutant(pollutant: Column, per_tier) -> Column:
    """CASE over pollutant → CASE over tiers; ``per_tier(upper, idx)`` builds the inner chain."""
    out = None
    for name in THRESHOLDS:
        inner = per_tier(THRESHOLDS[name])
        out = (F.when(pollutant == name, inner) if out is None
               else out.when(pollutant == name, inner))
    return out.otherwise(per_tier(THRESHOLDS[DEFAULT_POLLUTANT]))


def _tier_chain(value: Column, pollutant: Column, outputs: list) -> Column:
    """outputs[i] for the first tier whose upper bound holds ``value``; null for
    null, NaN or negative values. 0 falls in tier 1 ("Good") — the label rule,
    distinct from the style rule."""
    def chain(uppers):
        c = None
        for upper, out in zip(uppers[:-1], outputs):
            cond = value <= F.lit(upper)
            c = F.when(cond, F.lit(out)) if c is None else c.when(cond, F.lit(out))
        return c.otherwise(F.lit(outputs[len(uppers) - 1]))

    valid = value.isNotNull() & ~F.isnan(value) & (value >= 0)
    return F.when(valid, _by_pollutant(pollutant, chain))


def tier_index(value: Column, pollutant: Column) -> Column:
    """1-based tier of ``value`` (null for null, NaN or negative values)."""
    return _tier_chain(value, pollutant, list(range(1, len(LABELS) + 1)))


def _pick(idx: Column, values: list) -> Column:
    c = None
    for i, v in enumerate(values, start=1):
        c = F.when(idx == i, F.lit(v)) if c is None else c.when(idx == i, F.lit(v))
    return c


def aqi_label(value: Column, pollutant: Column) -> Column:
    """Tier label, or null when the value is null/NaN/negative."""
    return _tier_chain(value, pollutant, LABELS)


def label_colour(label: Column) -> Column:
    """Hex colour of a tier label, ``#888`` for anything else."""
    c = None
    for lab, col in zip(LABELS, COLOURS):
        c = F.when(label == lab, F.lit(col)) if c is None else c.when(label == lab, F.lit(col))
    return c.otherwise(F.lit(FALLBACK_COLOUR))


def label_order(label: Column) -> Column:
    """Sort position of a label (Good … Extremely poor, Unknown), 99 otherwise."""
    c = None
    for i, lab in enumerate(LABEL_ORDER):
        c = F.when(label == lab, F.lit(i)) if c is None else c.when(label == lab, F.lit(i))
    return c.otherwise(F.lit(99))




def _rgb(hex_str: str) -> tuple[int, int, int]:
    return tuple(int(hex_str[i:i + 2], 16) for i in (1, 3, 5))


def with_aqi_style(df: DataFrame, value: str = "Value", pollutant: str = "pollutant") -> DataFrame:
    """Map styling: "No data", grey, invisible for null/NaN/<= 0; else the tier's label,
    colour and alpha 220.

    The tier is computed once into a helper column and the five outputs are
    small CASEs on it (Catalyst keeps the helper, since it is referenced
    several times), which keeps the generated code compact.
    """
    v = F.col(value)
    has_value = v.isNotNull() & ~F.isnan(v) & (v > 0)
    out = df.withColumn("_tier", F.when(has_value, tier_index(v, F.col(pollutant))))
    t = F.col("_tier")
    cols = {"aqi_label": F.coalesce(_pick(t, LABELS), F.lit(NO_DATA_LABEL))}
    rgbs = [_rgb(c) for c in COLOURS]
    for ch, name in enumerate(("color_r", "color_g", "color_b")):
        cols[name] = F.coalesce(_pick(t, [rgb[ch] for rgb in rgbs]), F.lit(NO_DATA_RGB[ch]))
    cols["color_a"] = F.when(t.isNotNull(), F.lit(STYLE_ALPHA)).otherwise(F.lit(0))
    return out.withColumns(cols).drop("_tier")


def classify_range_join(df: DataFrame, dim: DataFrame, value: str = "Value",
                        pollutant: str = "pollutant") -> DataFrame:
    """Second form of the tier lookup: left range join to the broadcast dimension.

    Equality on the effective pollutant makes it a broadcast hash join with
    the band test as a post-filter; the dimension has 24 rows by definition.
    """
    d = dim.select(
        F.col("pollutant").alias("_dim_pollutant"), F.col("lower").alias("_lower"),
        F.col("upper").alias("_upper"), F.col("tier").alias("_tier"), F.col("label").alias("aqi_label"))
    v = F.col(value)
    cond = ((effective_pollutant(F.col(pollutant)) == F.col("_dim_pollutant"))
            & v.isNotNull() & ~F.isnan(v) & (v >= 0)
            & (v <= F.col("_upper")) & ((F.col("_tier") == 1) | (v > F.col("_lower"))))
    return df.join(F.broadcast(d), cond, "left").drop("_dim_pollutant", "_lower", "_upper", "_tier")
