"""Statistics over a sorted, bounded ARRAY<DOUBLE> column, as Column expressions.

For short arrays that already sit in a row (a series of years, a stored peer list). Statistics of
whole groups live in ``operators.ranking`` and of peer groups in ``operators.cohort``; neither
gathers a group into an array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: consistency factors and anomaly cut-offs ---------------------------------------
MAD_SCALE = 0.6745
MEAN_AD_SCALE = math.sqrt(math.pi / 2)
UNUSUAL_Z = 3.5
ELEVATED_Z = 2.0
MIN_PEERS = 10
PREFERRED_PEERS = 20


def finite_sorted(values: Column) -> Column:
    return F.array_sort(F.filter(values, lambda v: F.abs(v) < float("inf")))


def quantile(ordered: Column, q: float) -> Column:
    """Type-7 quantile of a sorted array; NULL when it is empty or q lies outside 0..1."""
    if not 0 <= q <= 1:
        return F.lit(None).cast("double")
    position = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.try_element_at(ordered, F.floor(position).cast("int") + 1)
    high = F.try_element_at(ordered, F.ceil(position).cast("int") + 1)
    return F.when(F.size(ordered) > 0, low + (high - low) * (position - F.floor(position)))


def percentile_rank(value: Column, peers: Column) -> Column:
    """100 x (below + half of equal) / n."""
    below = F.size(F.filter(peers, lambda p: p < value))
    equal = F.size(F.filter(peers, lambda p: p == value))
    return F.when(value.isNotNull() & (F.size(peers) > 0), (below + 0.5 * equal) / F.size(peers) * 100)


def deviations(ordered: Column, center: Column) -> Column:
    return F.array_sort(F.transform(ordered, lambda v: F.abs(v - center)))


def median_absolute_deviation(ordered: Column) -> Column:
    return quantile(deviations(ordered, quantile(ordered, 0.5)), 0.5)


def robust_z(value: Column, center: Column, mad: Column, mean_ad: Column) -> Column:
    """0.6745 (x - median) / MAD; the mean deviation stands in for a zero MAD."""
    return (
        F.when(mad > 0, MAD_SCALE * (value - center) / mad)
        .when(mean_ad > 0, (value - center) / (MEAN_AD_SCALE * mean_ad))
        .when(value == center, F.lit(0.0))
    )


def robust_z_of(value: Column, ordered: Column) -> Column:
    center = quantile(ordered, 0.5)
    spread = deviations(ordered, center)
    total = F.aggregate(spread, F.lit(0.0), lambda a, v: a + v)
    return robust_z(value, center, quantile(spread, 0.5), F.try_divide(total, F.size(spread)))


def anomaly_label(z: Column) -> Column:
    return F.when(z >= UNUSUAL_Z, "unusually_high").when(z >= ELEVATED_Z, "elevated").when(z.isNotNull(), "typical")


def linear_slope(points: Column, x: str = "x", y: str = "y") -> Column:
    """Least-squares slope over an ARRAY<STRUCT<x, y>>; NULL below two points or without x spread."""
    n = F.size(points)

    def total(f):
        return F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))

    mean_x = F.try_divide(total(lambda p: p[x].cast("double")), n)
    mean_y = F.try_divide(total(lambda p: p[y]), n)
    covariance = total(lambda p: (p[x] - mean_x) * (p[y] - mean_y))
    variance = total(lambda p: (p[x] - mean_x) * (p[x] - mean_x))
    return F.when(n >= 2, F.try_divide(covariance, variance))
