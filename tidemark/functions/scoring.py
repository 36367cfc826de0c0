"""Score expressions. Missing parts are left out of a mean instead of counting as 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean over the parts that aren't null, by weight; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x * w, F.lit(0.0)) for x, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts])
    return F.when(weight > 0, clamp01(total / weight))


def balanced(x: Column, target: float, tolerance: float) -> Column:
    """1 at the target, falling to 0 at the tolerance on either side."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(x - target) / tolerance))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, straight between."""
    return clamp01((x - low) / (high - low))


def iso_score(iso: Column, low: float = 50.0, high: float = 6400.0) -> Column:
    """Falls from 1 to 0 with the logarithm of the sensitivity."""
    return F.when(iso > 0, 1 - F.log(F.greatest(F.lit(low), F.least(F.lit(high), iso.cast("double"))) / low) / F.log(F.lit(high / low)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def span_score(hours: Column) -> Column:
    """Duration: full at half an hour, 0.6 at two days, nothing from ten days."""
    return F.when(hours < 0.5, clamp01(hours / 0.5)).when(hours <= 48, 1 - 0.4 * (hours - 0.5) / 47.5).otherwise(F.greatest(F.lit(0.0), 0.6 * (1 - (hours - 48) / 192)))


def quantile_normal(x: Column, low: Column, q1: Column, q3: Column, high: Column, floor: float = 0.1, ceiling: float = 0.9) -> Column:
    """Piecewise straight from the least value to the largest over the quartiles; 0.5 where all values are alike."""
    width = ceiling - floor
    a, b = floor + width * 0.25, floor + width * 0.75
    part = lambda lo, hi, y0, y1: y0 + (y1 - y0) * (x - lo) / F.nullif(hi - lo, F.lit(0.0))
    inner = (
        F.when(x <= low, F.lit(floor)).when(x >= high, F.lit(ceiling)).when(x <= q1, F.coalesce(part(low, q1, floor, a), F.lit(a))).when(x <= q3, F.coalesce(part(q1, q3, a, b), F.lit(b))).otherwise(F.coalesce(part(q3, high, b, ceiling), F.lit(ceiling)))
    )
    return F.when(high - low <= 1e-9, F.lit(0.5)).otherwise(inner)
