"""Reproducible splits, leak checks, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import unit_hash
from tidewatch.operators.ordered import ROWS_PER_TASK, row_numbers

# Split names and shares.
SPLITS = (("train", 0.7), ("val", 0.15), ("test", 0.15))


def _bounds(shares: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    if abs(sum(share for _, share in shares) - 1.0) >= 1e-6:
        raise ValueError("split shares must sum to 1")
    total, bounds = 0.0, []
    for name, share in shares:
        total += share
        bounds.append((name, total))
    return bounds


def split_of(
    *ids: Column, seed: int = 42, shares: Sequence[tuple[str, float]] = SPLITS
) -> Column:
    """Split name from a hash of the id: no sort, no shuffle, the same in every run.

    Given an entity id, all rows of the entity fall into one split.
    """
    u = unit_hash(seed, *ids)
    *inner, (last, _) = _bounds(shares)
    chain = None
    for name, bound in inner:
        chain = F.when(u < bound, name) if chain is None else chain.when(u < bound, name)
    return chain.otherwise(last)


def split_exact(
    df: DataFrame,
    id_column: str,
    seed: int = 42,
    shares: Sequence[tuple[str, float]] = SPLITS,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Splits of exactly ``int(share * n)`` rows, the last taking the rest.

    Rows are ranked by their hash; the rank is a chunked running count, not a
    sort in one task.
    """
    *inner, (last, _) = shares
    _bounds(shares)
    hashed = df.withColumn("_u", unit_hash(seed, F.col(id_column)))
    ranked = row_numbers(hashed, [], ["_u", id_column], "_rank", limit).withColumn(
        "_n", df.agg(F.count(F.lit(1))).scalar()
    )
    upto, chain = F.lit(0), None
    for name, share in inner:
        upto = upto + F.floor(F.lit(share) * F.col("_n"))
        inside = F.col("_rank") <= upto
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return ranked.withColumn("split", chain.otherwise(last)).drop("_u", "_rank", "_n")


def leaked_ids(
    splits: dict[str, DataFrame], id_column: str
) -> DataFrame:
    """Shared ids per pair of splits: ``(left_split, right_split, n_shared)``.

    All pairs are counted in one aggregation over the ids: each id has one flag
    per split.
    """
    names = list(splits)
    tagged = None
    for name, df in splits.items():
        part = df.select(F.col(id_column).alias("_id"), F.lit(name).alias("_split"))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy("_id").agg(
        *[F.max((F.col("_split") == n).cast("int")).alias(f"_in_{n}") for n in names]
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = flags.agg(
        *[F.sum(F.col(f"_in_{a}") * F.col(f"_in_{b}")).alias(f"{a}_{b}") for a, b in pairs]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left_split"),
                F.lit(b).alias("right_split"),
                F.coalesce(F.col(f"{a}_{b}"), F.lit(0)).alias("n_shared"),
            )
            for a, b in pairs
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def class_weights(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """``n / (k * n_c)`` per class, with k the classes seen; an unseen class counts as 1."""
    counted = [
        F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias(f"n_{c}") for c in classes
    ]
    one = df.agg(*counted, F.count(label).alias("n"))
    seen = sum(((F.col(f"n_{c}") > 0).cast("int") for c in classes), F.lit(0))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(f"n_{c}").alias("n_class"),
                (F.col("n") / (seen * F.greatest(F.col(f"n_{c}"), F.lit(1)))).alias("weight"),
            )
            for c in classes
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def split_stats(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label)).alias("positive_rate")
    )
