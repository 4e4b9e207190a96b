"""Closed-form statistics on count columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-sided 95 % normal quantile and the coefficients of the published
# error-function approximation (Abramowitz and Stegun, formula 7.1.26).
Z_95 = 1.959963984540054
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _d(value: Column) -> Column:
    return value.cast("double")


def proportion(k: Column, n: Column) -> Column:
    return F.when(n > 0, _d(k) / _d(n)).otherwise(0.0)


def wilson(k: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval: exact 0 and 1 at the ends, [0, 0] for an empty sample."""
    size = F.when(n > 0, _d(n))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _d(k) / size))
    z2 = z * z
    scale = F.lit(1.0) + F.lit(z2) / size
    center = (p + F.lit(z2) / (size * 2)) / scale
    radius = F.lit(z) / scale * F.sqrt(p * (1 - p) / size + F.lit(z2) / (size * size * 4))
    low = F.when(n <= 0, 0.0).when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - radius))
    high = F.when(n <= 0, 0.0).when(k == n, 1.0).otherwise(F.least(F.lit(1.0), center + radius))
    return low, high


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error about 1e-7."""
    scaled = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * scaled)
    poly = F.lit(0.0)
    for coefficient in reversed(ERF_A):
        poly = (poly + F.lit(coefficient)) * t
    tail = poly * F.exp(-scaled * scaled)
    return F.when(x < 0, 0.5 * tail).otherwise(1.0 - 0.5 * tail)


def newcombe(p1: Column, low1: Column, high1: Column, p2: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    """Newcombe-Wilson 95 % interval of p1 - p2 from the two proportions and their Wilson bounds."""
    low = p1 - p2 - F.sqrt(F.pow(p1 - low1, 2) + F.pow(high2 - p2, 2))
    high = p1 - p2 + F.sqrt(F.pow(high1 - p1, 2) + F.pow(p2 - low2, 2))
    return low, high


def pooled_error(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Standard error of p1 - p2 under a common proportion."""
    pool = _d(k1 + k2) / _d(n1 + n2)
    return F.sqrt(pool * (1 - pool) * (1 / _d(n1) + 1 / _d(n2)))


def kappa(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cohen's kappa from the 2x2 agreement counts (both 1, only first, only second, both 0)."""
    n = _d(a + b + c + d)
    observed = _d(a + d) / n
    first, second = _d(a + b) / n, _d(a + c) / n
    chance = first * second + (1 - first) * (1 - second)
    return F.when(n == 0, 0.0).when(chance >= 1.0, 1.0).otherwise((observed - chance) / (1 - chance))
