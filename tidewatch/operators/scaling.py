"""Column statistics and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import ROWS_PER_TASK, exact_quantiles

EPS = 1e-8
METHODS = ("min_max", "z_score", "robust")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: min, max, mean and sample deviation of every column, in one pass."""
    return df.agg(
        *[
            F.struct(
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )


def medians(
    df: DataFrame, columns: Sequence[str], limit: int | None = ROWS_PER_TASK
) -> DataFrame:
    """``(column, median, mad)`` with the lower median and its lower median distance."""
    middle = exact_quantiles(df, {c: F.col(c) for c in columns}, 0.5, limit)
    spread = exact_quantiles(
        df, {c: F.abs(F.col(c) - F.lit(m)) for c, m in middle.items() if m is not None}, 0.5, limit
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(middle[c]).cast("double").alias("median"),
                F.lit(spread.get(c)).cast("double").alias("mad"),
            )
            for c in columns
        ]
    )
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def stats_table(
    df: DataFrame,
    columns: Sequence[str],
    robust: bool = True,
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """``(column, min, max, mean, std)``, to store and apply later.

    ``robust`` adds ``median`` and ``mad``, which take more passes.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                *[F.col(c)[m].alias(m) for m in ("min", "max", "mean", "std")],
            )
            for c in columns
        ]
    )
    plain = moments(df, columns).select(F.explode(rows).alias("r")).select("r.*")
    return plain.join(medians(df, columns, limit), "column", "left") if robust else plain


def scaled(x: Column, stats: Column, method: str, eps: float = EPS) -> Column:
    """The value scaled by a struct of stored statistics."""
    if method == "min_max":
        return (x - stats["min"]) / (stats["max"] - stats["min"] + eps)
    if method == "z_score":
        return (x - stats["mean"]) / (stats["std"] + eps)
    if method == "robust":
        return (x - stats["median"]) / (stats["mad"] + eps)
    raise ValueError(f"unknown scaling method: {method}")


def stats_row(stats: DataFrame) -> DataFrame:
    """The statistics table as one map from column name to its numbers."""
    names = [c for c in stats.columns if c != "column"]
    return stats.agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.struct(*names)))  # one entry per column name
        ).alias("stats")
    )


def apply_scaling(
    df: DataFrame, stats: DataFrame, columns: Sequence[str], method: str, eps: float = EPS
) -> DataFrame:
    """Add ``<c>_norm`` from stored statistics.

    The statistics come in as a one-row scalar subquery, so the rows are not
    joined or moved. ``eps`` keeps constant columns at 0.
    """
    if method not in METHODS:
        raise ValueError(f"unknown scaling method: {method}")
    with_stats = df.withColumn("_stats", stats_row(stats).scalar())
    return with_stats.select(
        *df.columns,
        *[
            scaled(F.col(c), F.col("_stats")[c], method, eps).alias(f"{c}_norm")
            for c in columns
        ],
    )


def fit_min_max(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, dict]]:
    """Scaled frame and statistics; columns that are empty or constant are skipped.

    One aggregate for all columns; only its one row comes to the driver.
    """
    row = moments(df, columns).first()
    stats = {
        c: {"min": row[c]["min"], "max": row[c]["max"]}
        for c in columns
        if row[c]["min"] is not None and row[c]["min"] != row[c]["max"]
    }
    return df.withColumns(
        {
            f"{c}_norm": (F.col(c) - F.lit(s["min"])) / F.lit(s["max"] - s["min"])
            for c, s in stats.items()
        }
    ), stats
