"""Row numbers, running values, lags and row frames per entity.

A plain window puts all rows of an entity into one task. Here rows are dealt to
tasks by ranges of entity and order, of ``ROWS_PER_TASK`` rows or less on average, so an
entity of any size spans as many ranges as it fills. Each range is worked on by itself.
Only the first and the last group of a range can go on in another one, so what earlier
ranges carry over comes from two rows per range and is broadcast, one row per range at
most. There is one path for every size. The ranges are written once to the shared
folder, because Spark may choose others when it computes them again.

``limit=None`` asks for plain windows instead, for input whose groups are small by
construction, such as one row per entity and hour. Keys and values may be null; null
keys are one group. The order columns must tell the rows of a group apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written_once

ROWS_PER_TASK = 5_000_000

_CHUNK = "_range"


def range_count(rows: int, usual: int) -> int | None:
    """How many ranges ``rows`` need, or None where the session's ``usual`` number is enough."""
    needed = -(-rows // ROWS_PER_TASK)
    return needed if needed > usual else None


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the number of their range in ``_range``; numbers rise with keys and order.

    The session's number of shuffle partitions is used, unless ranges would then hold more
    than ``ROWS_PER_TASK`` rows on average, which the footers of the written table tell; they
    are dealt again to as many as that takes.
    """

    def dealt(rows: DataFrame, *number: int) -> DataFrame:
        if keys or order:
            rows = rows.repartitionByRange(*number, *keys, *order)
        return written_once(rows.withColumn(_CHUNK, F.spark_partition_id()), "ranges")

    parts = dealt(df)
    if keys or order:
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        number = range_count(parts.count(), usual)
        if number:
            parts = dealt(parts.drop(_CHUNK), number)
    return parts


def _upto(keys: Sequence[str], order: Sequence[str]) -> Window:
    return (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _border_groups(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the first and the last group of each range."""
    if not keys:
        return parts
    group = F.struct(*keys)
    borders = parts.groupBy(F.col(_CHUNK).alias("_range_at")).agg(
        F.min(group).alias("_range_first"), F.max(group).alias("_range_last")
    )
    at_border = group.eqNullSafe(F.col("_range_first")) | group.eqNullSafe(F.col("_range_last"))
    return parts.join(
        F.broadcast(borders), (F.col(_CHUNK) == F.col("_range_at")) & at_border, "left_semi"
    )


def _carried(parts: DataFrame, keys: Sequence[str], totals: dict[str, Column], fold) -> DataFrame:
    """What the earlier ranges of a group amount to, for ranges that continue one.

    A group that goes on is the last of its range and the first of the next, so the totals
    of two groups per range are enough, and one row per range at most comes out.
    """
    earlier = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        _border_groups(parts, keys)
        .groupBy(_CHUNK, *keys)
        .agg(*[c.alias(f"_carried_{name}") for name, c in totals.items()])
        .select(
            F.col(_CHUNK).alias("_range_at"),
            *[F.col(k).alias(f"_range_key_{i}") for i, k in enumerate(keys)],
            F.count(F.lit(1)).over(earlier).alias("_range_before"),
            *[fold(F.col(f"_carried_{name}"), earlier).alias(f"_carried_{name}") for name in totals],
        )
        .filter("_range_before > 0")
    )


def _continued(local: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = F.col(_CHUNK) == F.col("_range_at")
    for i, k in enumerate(keys):
        same = same & local[k].eqNullSafe(F.col(f"_range_key_{i}"))
    return local.join(F.broadcast(carried), same, "left")


def join_group_values(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of rows with one row of values per group; null keys meet null keys.

    The rows of a large group are a skewed side of a sort-merge join, which adaptive
    execution spreads over several tasks.
    """
    right = values.withColumnsRenamed({k: f"_range_key_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(F.col(f"_range_key_{i}"))
    return df.join(right, same).drop(*[f"_range_key_{i}" for i in range(len(keys))])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "row_num",
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Position of each row in its group, from 1. ``order`` must be unique in a group."""
    one = df.withColumn(name, F.lit(1).cast("long"))
    return running_sums(one, keys, order, [name], limit=limit)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Replace each column by its running sum, the row itself included.

    Null values add nothing; the sum is null until the first known one.
    """
    if limit is None:
        spec = _upto(keys, order)
        return df.select(
            *[F.sum(c).over(spec).alias(c) if c in columns else F.col(c) for c in df.columns]
        )
    parts = in_ranges(df, keys, order)
    spec = _upto([_CHUNK, *keys], order)
    local = parts.select(
        _CHUNK, *[F.sum(c).over(spec).alias(c) if c in columns else F.col(c) for c in df.columns]
    )
    carried = _carried(
        parts, keys, {c: F.sum(c) for c in columns}, lambda total, w: F.sum(total).over(w)
    )

    def added(c: str) -> Column:
        both = F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_carried_{c}"), F.lit(0))
        return F.when(F.col(c).isNotNull() | F.col(f"_carried_{c}").isNotNull(), both).alias(c)

    joined = _continued(local, carried, keys)
    return joined.select(*[added(c) if c in columns else local[c] for c in df.columns])


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``{new: old}``: the last known value of ``old`` at or before the row."""
    if limit is None:
        spec = _upto(keys, order)
        return df.select(
            "*",
            *[F.last(old, ignorenulls=True).over(spec).alias(new) for new, old in columns.items()],
        )
    parts = in_ranges(df, keys, order)
    spec = _upto([_CHUNK, *keys], order)
    local = parts.select(
        "*", *[F.last(old, ignorenulls=True).over(spec).alias(new) for new, old in columns.items()]
    )
    at = F.struct(*order)
    carried = _carried(
        parts, keys,
        {new: F.max_by(old, F.when(F.col(old).isNotNull(), at)) for new, old in columns.items()},
        lambda last, w: F.last(last, ignorenulls=True).over(w),
    )
    return _continued(local, carried, keys).select(
        *[local[c] for c in df.columns],
        *[F.coalesce(local[new], F.col(f"_carried_{new}")).alias(new) for new in columns],
    )


def over_previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    build: Callable[[Window], dict[str, Column]],
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add window columns that look back at most ``reach`` rows.

    Groups are cut into blocks of exactly ``limit`` rows by row number, and the last
    ``reach`` rows of each block are repeated before the next one.
    """
    if limit is None:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[c.alias(n) for n, c in build(spec).items()])
    if limit <= reach:
        raise ValueError("a block must be longer than the look-back")
    numbered = row_numbers(df, keys, order, "_n", limit)
    block = F.floor((F.col("_n") - 1) / limit)
    in_tail = (F.col("_n") - 1) % limit >= limit - reach
    copies = F.when(in_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = numbered.withColumn("_copy", F.explode(copies)).withColumn(
        "_block", block + F.col("_copy")
    )
    spec = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        spread.select("*", *[c.alias(n) for n, c in build(spec).items()])
        .filter(F.col("_copy") == 0)
        .drop("_n", "_copy", "_block")
    )


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    q: float = 0.5,
    limit: int | None = ROWS_PER_TASK,
    accuracy: int = 10_000,
) -> dict[str, float | None]:
    """Per column, the smallest value whose share of rows at or below it reaches ``q``.

    Two passes. A sketch gives a narrow bracket around each quantile. The second pass
    counts the rows below it in one group and merges equal values inside it, so only
    about ``4 / accuracy`` of the distinct values are shuffled. One number per column
    comes to the driver.
    """
    values = df.select(*[c.cast("double").alias(name) for name, c in columns.items()])
    off = 2 / accuracy
    bracket = values.agg(
        *[
            F.struct(
                F.percentile_approx(
                    n, [max(0.0, q - off), min(1.0, q + off)], accuracy
                ).alias("ends"),
                F.count(n).alias("all"),
            ).alias(n)
            for n in columns
        ]
    ).first()
    known = [n for n in columns if bracket[n]["ends"] is not None]
    if not known:
        return dict.fromkeys(columns)
    low = {n: bracket[n]["ends"][0] for n in known}
    high = {n: bracket[n]["ends"][1] for n in known}
    # rows below the bracket are one group, with a value under all others
    cells = [
        F.when(
            F.col(n) <= high[n],
            F.struct(
                F.lit(n).alias("column"),
                (F.col(n) >= low[n]).alias("inside"),
                F.when(F.col(n) >= low[n], F.col(n)).alias("x"),
            ),
        )
        for n in known
    ]
    merged = (
        values.select(F.explode(F.array(*cells)).alias("r"))
        .filter("r is not null")
        .select("r.*")
        .groupBy("column", "inside", "x")
        .agg(F.count(F.lit(1)).alias("upto"))
    )
    upto = running_sums(merged, ["column"], ["inside", "x"], ["upto"], limit)
    wanted = F.create_map(*[F.lit(v) for n in known for v in (n, bracket[n]["all"] * q)])
    found = {
        r["column"]: r["x"]
        for r in upto.filter(F.col("inside") & (F.col("upto") >= wanted[F.col("column")]))
        .groupBy("column")
        .agg(F.min("x").alias("x"))
        .collect()
    }
    return {n: found.get(n) for n in columns}
