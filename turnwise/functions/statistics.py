"""Tail probabilities as column expressions, for rows that are already aggregates: a midpoint sum over a bounded interval each."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 10_000


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _integral(f, low: Column, high: Column) -> Column:
    step = (high - low) / NODES
    return step * _sum(F.transform(F.sequence(F.lit(0), F.lit(NODES - 1)), lambda i: f(low + (i + 0.5) * step)))


def ln_gamma(x: Column) -> Column:
    """Of a positive number: Stirling's series at x + 8, brought back by the recurrence."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5))
    return series - sum((F.log(x + k) for k in range(1, 8)), F.log(x))


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) for ``dof`` >= 1 degrees of freedom; 1.0 for 0. The density of the root of X is integrated up to where the rest is nothing."""
    top = F.least(F.sqrt(statistic), F.sqrt(dof) + 14)
    constant = (dof / 2 - 1) * math.log(2) + ln_gamma(dof / 2)
    below = _integral(lambda y: F.exp((dof - 1) * F.log(y) - y * y / 2 - constant), F.lit(0.0), top)
    return F.when((dof < 1) | (statistic <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - below))


def t_tails(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for ``dof`` degrees of freedom, which need not be whole. With s = arctan(t / sqrt(dof)) the integral is over a cosine's power."""
    top = F.atan(F.abs(t) / F.sqrt(dof))
    constant = ln_gamma((dof + 1) / 2) - ln_gamma(dof / 2) - 0.5 * math.log(math.pi)
    within = _integral(lambda s: F.exp(constant + (dof - 1) * F.log(F.cos(s))), F.lit(0.0), top)
    return F.greatest(F.lit(0.0), 1 - 2 * within)


def kolmogorov_tail(distance: Column, n: Column, m: Column) -> Column:
    """P(D >= distance) of the two-sample Kolmogorov-Smirnov statistic by its limit law; 1.0 if a side is empty."""
    x = distance * F.sqrt(n * m / F.nullif(n + m, F.lit(0)))
    tail = _sum(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x)))
    return F.when((n == 0) | (m == 0) | (x < 0.2), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))
