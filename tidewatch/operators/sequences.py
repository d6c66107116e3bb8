"""Lags, sliding sequences, bounded history, pooling, gap filling, vector assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.catalog import SEQUENCE_STEPS
from tidewatch.functions.expressions import default_for
from tidewatch.operators.ordered import (
    ROWS_PER_TASK,
    fill_forward,
    join_group_values,
    over_previous_rows,
    row_numbers,
    running_sums,
)


def lag_matrix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    n: int,
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """``window_0 … window_{n-1}``: the value of the row itself and the n-1 before it."""

    def build(spec: Window) -> dict[str, Column]:
        return {f"window_{i}": F.lag(value, i).over(spec) for i in range(n)}

    return over_previous_rows(df, keys, order, n - 1, build, limit)


def sliding_sequences(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    n: int = SEQUENCE_STEPS,
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """The last n feature rows as an array of structs, for rows that have n of them.

    The structs keep missing values, which a bare collected list would drop.
    """

    def build(spec: Window) -> dict[str, Column]:
        frame = spec.rowsBetween(-(n - 1), Window.currentRow)
        return {"sequence": F.collect_list(F.struct(*order, *features)).over(frame)}

    return over_previous_rows(df, keys, order, n - 1, build, limit).filter(
        F.size("sequence") == n
    )


def last_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "recency"
) -> DataFrame:
    """The n latest rows per group, 1 being the latest.

    Spark keeps at most n rows per group in every input partition before the
    shuffle, so a large group stays small.
    """
    latest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn(name, F.row_number().over(latest)).filter(F.col(name) <= n)


def last_sequence(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], n: int
) -> DataFrame:
    """One row per group with its n latest feature rows, oldest first."""
    return (
        last_rows(df, keys, order, n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, *features))).alias("sequence"))
    )


def mean_vector(df: DataFrame, keys: Sequence[str], vectors: str) -> DataFrame:
    """Element-wise mean over an array of equally long vectors, one row per element."""
    return (
        df.select(*keys, F.explode(vectors).alias("_v"))
        .select(*keys, F.posexplode("_v").alias("pos", "x"))
        .groupBy(*keys, "pos")
        .agg(F.avg("x").alias("mean"))
    )


def pool(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], how: str
) -> DataFrame:
    """One row per group: the last, mean or largest value of each column."""
    if how == "last":
        at = F.struct(*order)
        return df.groupBy(*keys).agg(*[F.max_by(v, at).alias(v) for v in values])
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling: {how}")
    fold = F.avg if how == "mean" else F.max
    return df.groupBy(*keys).agg(*[fold(v).alias(v) for v in values])


def pool_softmax(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    values: Sequence[str],
) -> DataFrame:
    """Mean of each column weighted by the softmax of the score within the group.

    Two aggregations and a join on the group; null keys are one group.
    """
    keys = list(keys)
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    weighed = join_group_values(df, top, keys).withColumn(
        "_w", F.exp(F.col(score) - F.col("_top"))
    )
    return weighed.groupBy(*keys).agg(
        *[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values]
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, list(columns))


def fill_linear(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``<c>_linear``: missing values between two known ones lie on their line.

    Before the first and after the last known value the gap stays missing.
    """
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("v")))
             for c in columns}
    marked = df.withColumns({f"_k_{c}": k for c, k in known.items()}).withColumn(
        "_back", -F.unix_micros(time)
    )
    before = fill_forward(
        marked, keys, [time], {f"_b_{c}": f"_k_{c}" for c in columns}, limit
    )
    both = fill_forward(
        before, keys, ["_back"], {f"_a_{c}": f"_k_{c}" for c in columns}, limit
    )

    def on_line(c: str) -> Column:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        share = (F.unix_micros(time) - F.unix_micros(b["t"])) / (
            F.unix_micros(a["t"]) - F.unix_micros(b["t"])
        )
        return F.coalesce(F.col(c), b["v"] + (a["v"] - b["v"]) * share)

    return both.select(*df.columns, *[on_line(c).alias(f"{c}_linear") for c in columns])


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tiebreak: str,
    gap_seconds: float,
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``session``: 1 for the first run of rows, one more after each idle gap."""

    def build(spec: Window) -> dict[str, Column]:
        idle = F.unix_micros(time) - F.unix_micros(F.lag(time).over(spec))
        starts = idle.isNull() | (idle > F.lit(int(gap_seconds * 1_000_000)))
        return {"session": starts.cast("long")}

    order = [time, tiebreak]
    return running_sums(
        over_previous_rows(df, keys, order, 1, build, limit), keys, order, ["session"], limit=limit
    )


def impute_steps(
    steps: Column, defaults: Mapping[str, float], zero_is_missing: bool = False
) -> Column:
    """Array of structs to array of vectors, with a default for each missing field."""
    return F.transform(
        steps,
        lambda s: F.array(
            *[
                default_for(s[name].cast("double"), value, zero_is_missing)
                for name, value in defaults.items()
            ]
        ),
    )


def pad_steps(vectors: Column, steps: int, width: int) -> Column:
    """Repeat the last vector up to ``steps``; an empty sequence becomes zeros."""
    last = F.coalesce(
        F.try_element_at(vectors, F.lit(-1)), F.array_repeat(F.lit(0.0), width)
    )
    return F.concat(vectors, F.array_repeat(last, F.greatest(F.lit(0), steps - F.size(vectors))))


def assemble_vector(
    static: Column, vectors: Column, steps: int, width: int, cut: int, total: int,
    keep: str = "last",
) -> Column:
    """Static values, then the flattened series cut to ``cut``, zero-padded to ``total``.

    ``keep="first"`` cuts after the first values, ``"last"`` keeps the latest ones.
    """
    flat = F.flatten(pad_steps(vectors, steps, width))
    if keep == "first":
        series = F.slice(flat, 1, cut)
    else:
        series = F.slice(flat, max(1, steps * width - cut + 1), cut)
    joined = F.slice(F.concat(static, series), 1, total)
    return F.concat(joined, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), total - F.size(joined))))


def assemble_pooled(parts: Sequence[tuple[Column, int]], steps: int, total: int) -> Column:
    """Means over the padded steps of several series, one after the other, zero-padded."""

    def mean(vectors: Column, width: int) -> Column:
        padded = pad_steps(vectors, steps, width)
        sums = F.aggregate(
            padded,
            F.array_repeat(F.lit(0.0), width),
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
        )
        return F.transform(sums, lambda s: s / F.size(padded))

    joined = F.slice(F.concat(*[mean(v, width) for v, width in parts]), 1, total)
    return F.concat(joined, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), total - F.size(joined))))


__all__ = [
    "assemble_pooled", "assemble_vector", "fill_forward", "fill_linear", "fill_zero",
    "impute_steps", "lag_matrix", "last_rows", "last_sequence", "mean_vector", "pad_steps",
    "pool", "pool_softmax", "row_numbers", "sessions", "sliding_sequences",
]
