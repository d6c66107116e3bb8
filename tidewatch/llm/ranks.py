"""Ranks within groups of any size, from a range-partitioned order written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import materialise

# monotonically_increasing_id holds the task above and the place in the task below this bit
TASK_BIT = 33


def same_group(left: str, right: str, group: Sequence[str]) -> Column:
    """Join condition on the group columns of two aliases; null groups are equal."""
    condition = F.lit(True)
    for c in group:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def ranked(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], purpose: str,
    rank: str = "rank", size: str = "size",
) -> DataFrame:
    """``rows`` with their rank from 0 within the group and the group's size, written once.

    Rows are dealt to tasks by ranges of group and order, nulls first, so a large group
    spans as many ranges as it fills. Rows equal in both get distinct ranks in any order. A rank is the
    place in the range, plus the rows of the ranges before, less those before the group. Read
    ``rows`` from files: ties are told apart by their place there.
    """
    columns = rows.columns
    if not group:  # all rows are one group
        rows, group = rows.withColumn("_all", F.lit(0)), ["_all"]
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    spread = (
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys, F.col("_tie"))
        .sortWithinPartitions(*keys, F.col("_tie"))
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    task, place = F.shiftright("_at", TASK_BIT), F.col("_at").bitwiseAND((1 << TASK_BIT) - 1)
    held = materialise(spread, purpose).withColumn("_task", task).withColumn("_at", place)
    parts = materialise(
        held.groupBy("_task", *group).agg(
            F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
        ),
        f"{purpose}-parts",
    )
    # one row per range
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(
        parts.groupBy("_task").agg(F.sum("_n").alias("_n"))
        .select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")),
        f"{purpose}-bases",
    )
    groups = parts.join(bases, "_task").groupBy(*group).agg(
        F.min(F.col("_base") + F.col("_first")).alias("_start"), F.sum("_n").alias(size)
    )
    placed = held.join(bases, "_task").alias("l")
    joined = placed.join(groups.alias("r"), same_group("l", "r", group))
    return joined.select(
        *[F.col(f"l.{c}") for c in columns],
        (F.col("_base") + F.col("_at") - F.col("_start")).alias(rank), F.col(size),
    )
