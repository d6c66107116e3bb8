"""Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk tiers and their upper bounds.
TIER_BOUNDS = (("low", 0.2), ("medium", 0.5), ("high", 0.8))
TOP_TIER = "critical"
TIERS = ("low", "medium", "high", "critical")
ALERT_TIERS = ("high", "critical")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A lambda evaluates what it uses from outside again for every element.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def risk_tier(p: Column) -> Column:
    tier = F.when(p < TIER_BOUNDS[0][1], TIER_BOUNDS[0][0])
    for name, bound in TIER_BOUNDS[1:]:
        tier = tier.when(p < bound, name)
    return tier.when(p.isNotNull(), TOP_TIER)


def confidence(p: Column) -> Column:
    """Twice the larger class probability, cut at 1: it is 1 for every p in [0, 1]."""
    return F.least(2 * F.greatest(p, 1 - p), F.lit(1.0))


def certainty(p: Column) -> Column:
    """Distance from the coin flip: 0 at p = 0.5, 1 at p = 0 or 1."""
    return F.abs(2 * p - 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, v: total + v,
    )


def double_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """From the logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(logit)
    hit = F.when(target == 1, p).otherwise(1 - p)
    side = F.when(target == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return side * F.pow(1 - hit, F.lit(gamma)) * binary_cross_entropy(logit, target)


def unit_hash(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) fixed by seed and id, the same in every run and engine.

    The parts are set apart, so (1, 23) and (12, 3) differ.
    """
    text = F.concat(F.lit(str(seed)), *[F.concat(F.lit("|"), i.cast("string")) for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", number)


def millis_id(prefix: str, ts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.unix_millis(ts).cast("string"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600.0


def default_for(value: Column, default: float, zero_is_missing: bool = False) -> Column:
    """Fill a missing value; optionally treat a true 0 as missing too."""
    known = F.nullif(value, F.lit(0.0)) if zero_is_missing else value
    return F.coalesce(known, F.lit(default))


@dataclass(frozen=True)
class StepRule:
    """Points 1, 2, 3 … for a value beyond each cut; ``cuts`` go from mild to severe."""

    column: str
    sense: str  # "below" or "above"
    cuts: tuple[float, ...]

    def points(self, value: Column | None = None, severest_first: bool = True) -> Column:
        x = F.col(self.column) if value is None else value
        steps = list(enumerate(self.cuts, start=1))
        if severest_first:
            steps.reverse()
        chain = None
        for points, cut in steps:
            beyond = x < cut if self.sense == "below" else x > cut
            chain = F.when(beyond, points) if chain is None else chain.when(beyond, points)
        return chain.otherwise(0)


def step_score(rules: Sequence[StepRule], severest_first: bool = True) -> Column:
    """Sum of the rules' points. A missing value scores 0.

    ``severest_first=False`` tests the mildest cut first, so that no rule can
    give more than one point.
    """
    score = F.lit(0)
    for rule in rules:
        score = score + rule.points(severest_first=severest_first)
    return score
