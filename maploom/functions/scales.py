"""Rounding, 1-2-5 steps, levels and value scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_LEVELS = 2000


def half_up(x: Column) -> Column:
    """Rounds ties towards positive infinity."""
    return F.floor(x + 0.5)


def clamp01(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def share(v: Column, lo: Column, hi: Column, flat: float = 0.0) -> Column:
    """Where v lies between lo and hi, 0 to 1; flat if they don't differ."""
    return F.when(hi - lo > 0, clamp01((v - lo) / (hi - lo))).otherwise(F.lit(flat))


def one_two_five(raw: Column) -> Column:
    """The step of the series 1, 2, 5, 10 that is nearest above the cuts 1.5, 3.5 and 7.5."""
    mag = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    n = raw / mag
    return F.when(n <= 1.5, 1.0).when(n <= 3.5, 2.0).when(n <= 7.5, 5.0).otherwise(10.0) * mag


def nice_interval(relief: Column, target: float = 12) -> Column:
    return F.when(relief > 0, one_two_five(relief / target)).otherwise(F.lit(1.0))


def nice_step(raw: float) -> float:
    """one_two_five for a plain number."""
    mag = 10.0 ** math.floor(math.log10(raw))
    n = raw / mag
    return (1 if n <= 1.5 else 2 if n <= 3.5 else 5 if n <= 7.5 else 10) * mag


def contour_levels(lo: Column, hi: Column, interval: Column, most: int = MOST_LEVELS) -> Column:
    """Multiples of interval from lo to hi, as an array; empty if there are more than most, the interval isn't positive, or a bound is null."""
    first, last = F.ceil(lo / interval), F.floor(hi / interval)
    ok = (interval > 0) & (hi >= lo) & (last >= first) & (last - first + 1 <= most)
    levels = F.transform(F.sequence(F.when(ok, first).otherwise(F.lit(0)), F.when(ok, last).otherwise(F.lit(0))), lambda k: k * interval)
    return F.when(ok, levels).otherwise(F.array().cast("array<double>"))


def is_index(level: Column, interval: Column, every: int) -> Column:
    return F.lit(False) if every <= 0 else F.abs(half_up(level / interval)) % every == 0


def level_decimals(interval: Column) -> Column:
    """Decimals that a level's label needs, 0 to 3."""
    return F.least(F.greatest(F.ceil(-F.log10(interval) - 1e-9), F.lit(0)), F.lit(3)).cast("int")


def scale_value(v: Column, lo: Column, hi: Column, out_lo: float, out_hi: float, mode: str = "area") -> Column:
    """A size for a value: by length if mode is linear, else by area."""
    t = share(v, lo, hi, 1.0)
    if mode == "linear":
        return out_lo + (out_hi - out_lo) * t
    return F.sqrt(out_lo * out_lo + t * (out_hi * out_hi - out_lo * out_lo))


def angle_value(v: Column, lo: Column, hi: Column, mode: str = "degrees", offset_deg: float = 0) -> Column:
    """Radians, counter-clockwise, for a bearing or for a value as a share of a full turn."""
    deg = v if mode == "degrees" else share(v, lo, hi) * 360
    return -((deg + offset_deg) * math.pi) / 180


def stride_for(nrows: Column, ncols: Column, target: Column) -> Column:
    return F.greatest(half_up(F.greatest(nrows, ncols) / F.greatest(target, F.lit(4))), F.lit(1)).cast("int")


def budget(across: Column, aspect: Column) -> tuple[Column, Column]:
    """(marks, verdict) of a halftone so many marks across."""
    marks = half_up(across * across * aspect)
    return marks, F.when(marks <= 1200, "comfortable").when(marks <= 4000, "heavy").otherwise("too many")
