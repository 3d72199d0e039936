"""Column expressions on pixel values: validity, single-precision scaling, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def is_valid(v: Column, nodata: Column | None = None) -> Column:
    """Finite, and not the nodata value where that is finite itself."""
    if nodata is None:
        return finite(v)
    return finite(v) & F.coalesce(~finite(nodata) | (v != nodata), F.lit(True))


def scaled(v: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo) in single precision, cut to 0..1; 0 for a collapsed or unknown range and for values that aren't finite."""
    share = (v.cast("float") - lo.cast("float")).cast("float") / (hi - lo).cast("float")
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).cast("float")
    return F.when(finite(lo) & finite(hi) & (hi > lo) & finite(v), cut).otherwise(F.lit(0.0).cast("float"))


def at_least(v: Column, threshold: float) -> Column:
    """Single-precision comparison."""
    return v >= F.lit(threshold).cast("float")


def below(v: Column, threshold: float) -> Column:
    return v < F.lit(threshold).cast("float")


def to_byte(norm: Column, valid: Column) -> Column:
    """0..255, halves to even; 0 where invalid."""
    return F.when(valid, F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), norm.cast("double"))) * 255)).otherwise(0).cast("int")


def hex_channels(colour: str) -> tuple[int, int, int]:
    c = colour.lstrip("#")
    return int(c[0:2], 16), int(c[2:4], 16), int(c[4:6], 16)


def blended(channel: Column, mask: Column, colour: int, alpha: float) -> Column:
    """The colour over the channel where the mask holds; halves to even."""
    return F.when(mask, F.rint(channel * (1.0 - alpha) + colour * alpha).cast("int")).otherwise(channel)


def hex_to_int(colour: Column, at: int) -> Column:
    """Channel 0, 1 or 2 of a `#rrggbb` column."""
    return F.conv(F.substring(F.regexp_replace(colour, "^#", ""), 2 * at + 1, 2), 16, 10).cast("int")
