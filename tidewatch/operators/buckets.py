"""Time buckets, pivots and bucket quality filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import catalog as c


def bucket(ts: Column, minutes: int = c.BUCKET_MINUTES) -> Column:
    """Start of the bucket that holds the time."""
    return F.window(ts, f"{minutes} minutes")["start"]


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def day_bucket(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def pivot_profile(
    df: DataFrame, keys: Sequence[str], item: str, value: str, items: Sequence[str]
) -> DataFrame:
    """Five aggregates per item: ``<item>_mean, _std, _min, _max, _count``.

    The items are a parameter, so the schema is known before the run and all
    columns come from one aggregation with one shuffle. An item without rows in
    a bucket gives nulls, its count included.
    """
    columns = []
    for name in items:
        x = F.when(F.col(item) == name, F.col(value))
        n = F.count(F.when(F.col(item) == name, F.lit(1)))
        columns += [
            F.avg(x).alias(f"{name}_mean"),
            F.stddev_samp(x).alias(f"{name}_std"),
            F.min(x).alias(f"{name}_min"),
            F.max(x).alias(f"{name}_max"),
            F.when(n > 0, F.count(x)).alias(f"{name}_count"),
        ]
    return df.filter(F.col(item).isin(list(items))).groupBy(*keys).agg(*columns)


def pivot_mean(
    df: DataFrame, keys: Sequence[str], item: str, value: str, items: Sequence
) -> DataFrame:
    """Mean per item, one column each."""
    return (
        df.filter(F.col(item).isin(list(items)))
        .groupBy(*keys)
        .agg(
            *[F.avg(F.when(F.col(item) == name, F.col(value))).alias(str(name)) for name in items]
        )
    )


def with_min_points(
    df: DataFrame, keys: Sequence[str], value: str, min_points: int = c.MIN_POINTS
) -> DataFrame:
    """Buckets with enough points, with their count and mean."""
    return (
        df.groupBy(*keys)
        .agg(F.count(value).alias("n_points"), F.avg(value).alias("mean_value"))
        .filter(F.col("n_points") >= min_points)
    )


def missing_ratio(columns: Sequence[str]) -> Column:
    missing = sum((F.col(name).isNull().cast("int") for name in columns), F.lit(0))
    return missing / F.lit(float(len(columns)))


def with_few_missing(
    df: DataFrame, columns: Sequence[str], max_missing: float = c.MAX_MISSING
) -> DataFrame:
    return df.withColumn("missing_ratio", missing_ratio(columns)).filter(
        F.col("missing_ratio") <= max_missing
    )


def coalesced_items(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per quantity, taken from the first of its items that is known."""
    return df.withColumns({name: F.coalesce(*items) for name, items in groups.items()})
