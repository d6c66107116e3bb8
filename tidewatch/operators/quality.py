"""Input rules: ranges, patterns, required fields, lengths and shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import catalog as c


def in_range(value: Column, low: float, high: float, required: bool = False) -> Column:
    """Whether the value lies in [low, high]; a missing optional value passes."""
    return F.coalesce(value.between(low, high), F.lit(not required))


def matches(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(pattern), F.lit(False))


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks, in rule order."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def range_rules(
    ranges: Mapping[str, tuple[float, float]], required: Sequence[str] = ()
) -> dict[str, Column]:
    return {
        name: in_range(F.col(name), low, high, name in required)
        for name, (low, high) in ranges.items()
    }


def count_ok(
    n: Column, low: int = c.MIN_REQUEST_STEPS, high: int = c.MAX_REQUEST_STEPS
) -> Column:
    return F.coalesce(n.between(low, high), F.lit(False))


def length_ok(
    array: Column, low: int = c.MIN_REQUEST_STEPS, high: int = c.MAX_REQUEST_STEPS
) -> Column:
    return count_ok(F.size(array), low, high)


def shape_ok(array: Column, shape: Sequence[int]) -> Column:
    """Whether nested arrays have the given sizes; -1 accepts any size."""
    size, *inner = shape
    fits = F.lit(True) if size == -1 else F.size(array) == size
    if inner:
        fits = fits & F.forall(array, lambda part: shape_ok(part, inner))
    return F.coalesce(fits, F.lit(False))


def route(violations: Column) -> Column:
    """Where a row goes: ``good`` or ``dead_letter``."""
    return F.when(F.size(violations) == 0, "good").otherwise("dead_letter")


def split_good_bad(df: DataFrame, violations: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others."""
    return df.filter(F.size(violations) == 0), df.filter(F.size(violations) > 0)
