"""Angles, magnitudes and small row-wise helpers; a null stays a null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(delta: Column) -> Column:
    """A difference of degrees brought back across the half turn."""
    return F.when(delta > 180, delta - 360).when(delta < -180, delta + 360).otherwise(delta)


def magnitude(*axes: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (x * x for x in axes)))


def roll(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(y, F.sqrt(x * x + z * z)))


def pitch(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(x, F.abs(z)))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def dominant_axis(*spreads: Column) -> Column:
    """Number of the axis of the largest spread: a null wins, then the first of equals."""
    top = F.greatest(*spreads)
    out = F.lit(None).cast("int")
    for k, s in reversed(list(enumerate(spreads))):
        out = F.when(s == top, k).otherwise(out)
    for k, s in reversed(list(enumerate(spreads))):
        out = F.when(s.isNull(), k).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a null condition is 0.0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def scaled_adc(adc: Column) -> Column:
    """A 16-bit reading as percent of full scale, in single precision."""
    return adc.cast("float") / F.lit(32767).cast("float") * F.lit(100).cast("float")

