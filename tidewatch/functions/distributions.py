"""Tail probabilities as column expressions."""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.expressions import let

KOLMOGOROV_TERMS = 30
# the two series of the Kolmogorov distribution converge equally fast about here
KOLMOGOROV_TURN = 1.18


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def log_gamma_half(dof: Column) -> Column:
    """ln Gamma(dof / 2) for whole dof > 0, by its recurrence down to Gamma(1) or Gamma(1/2)."""
    half = dof / 2
    steps = F.sequence(F.lit(0), F.floor((dof - 1) / 2).cast("int"))
    start = F.when(dof % 2 == 0, F.lit(0.0)).otherwise(F.lit(log(sqrt(pi))))
    return start + _sum(F.transform(steps, lambda j: F.when(j > 0, F.log(half - j)).otherwise(0.0)))


def _lower_series(a: Column, x: Column, terms: Column) -> Column:
    """Sum of x^n / (a (a + 1) ... (a + n))."""
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (a + n)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.aggregate(terms, start, step, lambda acc: acc["sum"])


def _upper_fraction(a: Column, x: Column, terms: Column) -> Column:
    """The continued fraction of the upper incomplete gamma function, evaluated forwards."""
    first = 1 / (x + 1 - a)
    start = F.struct(F.lit(1e300).alias("c"), first.alias("d"), first.alias("h"))

    def step(acc: Column, n: Column) -> Column:
        factor, b = n * (a - n), x + 1 - a + 2 * n
        d = 1 / (factor * acc["d"] + b)
        c = b + factor / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    return F.aggregate(terms, start, step, lambda acc: acc["h"])


def chi2_tail(statistic: Column, dof: Column) -> Column:
    """Probability of at least this chi-square value; null without degrees of freedom.

    The regularised incomplete gamma function: its series below the mean, its continued fraction above.
    """
    whole = F.when(dof > 0, dof.cast("double"))

    def tail(n: Column) -> Column:
        a, x = n / 2, statistic / 2
        terms = F.transform(
            F.sequence(F.lit(1), (200 + 12 * F.sqrt(a)).cast("int")), lambda k: k.cast("double")
        )
        front = F.exp(a * F.log(x) - x - log_gamma_half(n))
        return (
            F.when(x <= 0, 1.0)
            .when(x < a + 1, 1 - front * _lower_series(a, x, terms))
            .otherwise(front * _upper_fraction(a, x, terms))
        )

    return F.when(whole.isNotNull() & statistic.isNotNull(), let(whole, tail))


def kolmogorov_tail(scaled: Column) -> Column:
    """Limiting probability of a largest gap, times sqrt(n m / (n + m)), of at least this."""
    numbers = F.transform(F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)), lambda j: j.cast("double"))
    squared = scaled * scaled
    far = 2 * _sum(
        F.transform(numbers, lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * j * j * squared))
    )
    near = 1 - sqrt(2 * pi) / scaled * _sum(
        F.transform(numbers, lambda j: F.exp(-F.pow(2 * j - 1, F.lit(2)) * (pi * pi / 8) / squared))
    )
    return F.when(scaled <= 0, 1.0).when(scaled < KOLMOGOROV_TURN, near).otherwise(far)
