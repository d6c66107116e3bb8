"""Change between a reference and a current sample of one value."""

from __future__ import annotations

from collections.abc import Sequence
from math import log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.catalog import DRIFT_LIMIT
from tidewatch.functions.distributions import chi2_tail, kolmogorov_tail
from tidewatch.functions.expressions import ratio
from tidewatch.operators.ordered import ROWS_PER_TASK, running_sums


def ks_statistic(
    df: DataFrame, value: str, current: str, alpha: float = DRIFT_LIMIT,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Largest gap of the two empirical distributions, with its asymptotic critical value and p-value.

    ``current`` is true for rows of the current sample. There is drift if the p-value is below
    ``alpha``. If one sample is empty the numbers are null and there is no drift.
    """
    rows = df.select(F.col(value).alias("_x"), F.col(current).alias("_c"))
    counts = rows.groupBy("_x").agg(
        F.sum(F.when(~F.col("_c"), 1).otherwise(0)).alias("_ref"),
        F.sum(F.when(F.col("_c"), 1).otherwise(0)).alias("_cur"),
    )
    totals = rows.agg(
        F.struct(
            F.sum(F.when(~F.col("_c"), 1).otherwise(0)).alias("ref"),
            F.sum(F.when(F.col("_c"), 1).otherwise(0)).alias("cur"),
        )
    ).scalar()
    upto = running_sums(counts, [], ["_x"], ["_ref", "_cur"], limit)
    gaps = upto.withColumn("_t", totals).select(
        F.col("_t.ref").alias("n_reference"),
        F.col("_t.cur").alias("n_current"),
        F.abs(
            ratio(F.col("_ref"), F.col("_t.ref")) - ratio(F.col("_cur"), F.col("_t.cur"))
        ).alias("_gap"),
    )
    factor = sqrt(-log(alpha / 2) / 2)
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    both = (n > 0) & (m > 0)
    return (
        gaps.groupBy("n_reference", "n_current")
        .agg(F.max("_gap").alias("_ks"))
        .select(
            "n_reference",
            "n_current",
            F.when(both, F.col("_ks")).alias("ks"),
            (factor * F.sqrt(F.try_divide(n + m, n * m))).alias("critical"),
        )
        .withColumn("p_value", kolmogorov_tail(F.col("ks") * F.sqrt(F.try_divide(n * m, n + m))))
        .withColumn("drift", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    )


def binned_counts(
    df: DataFrame, value: str, current: str, edges: Sequence[float]
) -> DataFrame:
    """Reference and current counts per bin (edge, next edge], open at both ends."""
    bin_of = F.lit(0)
    for edge in edges:
        bin_of = bin_of + F.when(F.col(value) > edge, 1).otherwise(0)
    cells = []
    for i in range(len(edges) + 1):
        for name, side in (("ref", ~F.col(current)), ("cur", F.col(current))):
            cells.append(F.count(F.when((F.col("_bin") == i) & side, 1)).alias(f"{name}{i}"))
    one = df.withColumn("_bin", bin_of).agg(*cells)
    rows = [
        F.struct(
            F.lit(i).alias("bin"),
            F.col(f"ref{i}").alias("n_reference"),
            F.col(f"cur{i}").alias("n_current"),
        )
        for i in range(len(edges) + 1)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _with_shares(counts: DataFrame) -> DataFrame:
    totals = counts.agg(
        F.struct(F.sum("n_reference").alias("ref"), F.sum("n_current").alias("cur"))
    ).scalar()
    return counts.withColumn("_t", totals)


def chi2_statistic(counts: DataFrame, alpha: float = DRIFT_LIMIT) -> DataFrame:
    """Two-sample chi-square over the bins that hold any row, with its p-value.

    There is drift if the p-value is below ``alpha``. If one sample is empty, or all rows lie in one bin, nothing can be compared: the statistic is null
    for an empty sample and there is no drift.
    """
    n, m = F.col("n_reference"), F.col("n_current")
    both = n + m
    total = F.col("_t.ref") + F.col("_t.cur")
    expected_ref, expected_cur = both * F.col("_t.ref") / total, both * F.col("_t.cur") / total
    part = F.try_divide(F.pow(n - expected_ref, F.lit(2)), expected_ref) + F.try_divide(
        F.pow(m - expected_cur, F.lit(2)), expected_cur
    )
    one = (
        _with_shares(counts)
        .filter(both > 0)
        .agg(F.sum(part).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    )
    found = one.withColumn("p_value", chi2_tail(F.col("chi2"), F.col("dof")))
    return found.withColumn("drift", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def psi_statistic(
    counts: DataFrame, limit: float = DRIFT_LIMIT, floor: float = 1e-6
) -> DataFrame:
    """Population stability index; empty shares are lifted to ``floor``."""
    a = F.greatest(ratio(F.col("n_reference"), F.col("_t.ref")), F.lit(floor))
    b = F.greatest(ratio(F.col("n_current"), F.col("_t.cur")), F.lit(floor))
    one = _with_shares(counts).agg(F.sum((b - a) * F.log(b / a)).alias("psi"))
    return one.withColumn("drift", F.col("psi") > limit)
