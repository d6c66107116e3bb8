"""Search over ranges of parameters: seeded draws and successive halving on growing shares of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import unit_hash


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def value(self, u: Column) -> Column:
        return self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def value(self, u: Column) -> Column:
        low, high = F.log(F.lit(self.low)), F.log(F.lit(self.high))
        return F.exp(low + u * (high - low))


@dataclass(frozen=True)
class Choice:
    values: tuple

    def value(self, u: Column) -> Column:
        place = F.floor(u * len(self.values)).cast("int")
        return F.element_at(F.array(*[F.lit(v) for v in self.values]), place + 1)


def draw(spark: SparkSession, space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` settings, each parameter fixed by seed, number and name."""
    candidate = F.col("id").alias("candidate")
    drawn = [
        kind.value(unit_hash(seed, F.col("id"), F.lit(name))).alias(name)
        for name, kind in space.items()
    ]
    return [r.asDict() for r in spark.range(n).select(candidate, *drawn).orderBy("candidate").collect()]


def successive_halving(
    rows: DataFrame, space: dict, loss: Callable[[dict], Column], row_id: Sequence[str], n: int,
    keep: int = 2, rungs: int = 3, seed: int = 42,
) -> DataFrame:
    """One row per drawn setting: ``candidate``, its parameters, the last ``rung`` it was tried in and its mean
    loss there.

    In each rung all settings that are left are tried side by side in one pass over a share of the
    rows, fixed by a hash of their id; the best ``1 / keep`` of them, ties to the smaller number, go on to a
    share ``keep`` times as large. The last rung takes all rows. What comes to the driver is one number per setting. ``loss``
    turns a setting into a column; a mean that is null or NaN is the worst.
    """
    left, done = draw(rows.sparkSession, space, n, seed), {}
    place = unit_hash(seed, *[F.col(c) for c in row_id])
    for rung in range(rungs):
        share = 1 / keep ** (rungs - 1 - rung)
        some = rows.where(place < share) if share < 1 else rows
        means = some.agg(*[F.avg(loss(s)).alias(f"c{s['candidate']}") for s in left]).first()
        scored = []
        for s in left:
            mean = means[f"c{s['candidate']}"]
            known = mean is not None and mean == mean
            scored.append((not known, mean if known else 0.0, s["candidate"], s))
            done[s["candidate"]] = (s, rung, mean if known else None)
        scored.sort(key=lambda x: x[:3])
        left = [s for *_, s in scored[: max(1, -(-len(scored) // keep))]]
    kinds = {c: "string" if isinstance(v, Choice) and isinstance(v.values[0], str) else "double"
             for c, v in space.items()}
    schema = "candidate long, " + "".join(f"{c} {k}, " for c, k in kinds.items()) + "rung int, loss double"
    table = [
        (number, *[s[c] if kinds[c] == "string" else float(s[c]) for c in space], rung, mean)
        for number, (s, rung, mean) in sorted(done.items())
    ]
    return rows.sparkSession.createDataFrame(table, schema)
