"""Rounding, guarded ratios and statistics with the engine's conventions for empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds halves towards plus infinity: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; `empty` where b is 0 or null."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(empty).cast("double"))


def sample_deviation(x: Column) -> Column:
    """Standard deviation with n - 1; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean, 0 where the weights sum to 0."""
    return ratio(F.sum(value * weight), F.sum(weight))


def median_of(a: Column) -> Column:
    """Median of an array of doubles; the mean of the middle two of an even number; null if empty."""
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))


def deviation_of(a: Column) -> Column:
    """Sample standard deviation of an array; 0 for fewer than two values."""
    m = mean_of(a)
    return F.when(F.size(a) < 2, 0.0).otherwise(F.sqrt(F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda x, y: x + y) / (F.size(a) - 1)))


#: Scales the median absolute deviation to a standard deviation under the normal law, a fixed value.
MAD_SCALE = 1.4826


def mad_of(a: Column) -> Column:
    """Median absolute deviation of an array, scaled; null if empty."""
    m = median_of(a)
    return median_of(F.transform(a, lambda x: F.abs(x - m))) * MAD_SCALE


def robust_scale(a: Column, floor: float = 0.5) -> Column:
    """The larger of `floor` and the scaled MAD (the sample deviation where that is 0); `floor` for fewer than two values."""
    mad = mad_of(a)
    return F.when(F.size(a) < 2, floor).otherwise(F.greatest(F.when(mad > 0, mad).otherwise(deviation_of(a)), F.lit(floor)))


def percentile_rank(a: Column, x: Column) -> Column:
    """round(100 * share of values <= x); 0 if empty."""
    below = F.size(F.filter(a, lambda v: v <= x))
    return F.when(F.size(a) > 0, F.floor(below * 100.0 / F.size(a) + 0.5)).otherwise(F.lit(0)).cast("long")
