"""Severity scores, onset times and horizon labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import catalog as c
from tidewatch.functions.expressions import StepRule, hours_between, step_score
from tidewatch.operators.ordered import join_group_values


def full_severity(
    rules: Sequence[StepRule],
    pressor_columns: Sequence[str],
    coma_columns: Sequence[str],
    coma_total: str,
    urine: str,
    coma_cuts: Sequence[float] = c.GCS_CUTS,
    urine_cuts: Sequence[float] = c.URINE_CUTS,
) -> Column:
    """Step score plus vasopressor use, coma scale and urine output.

    Any vasopressor counts 2 and replaces a lower pressure score; that part is
    expected first in ``rules``. The coma scale is the recorded total, or the
    sum of its parts when all are known. Low urine counts 3 or 4 and competes
    with the last rule, the kidney one.
    """
    pressure, *others, kidney = rules
    on_pressor = F.lit(False)
    for name in pressor_columns:
        on_pressor = on_pressor | F.coalesce(F.col(name) > 0, F.lit(False))
    coma = F.coalesce(F.col(coma_total), sum((F.col(n) for n in coma_columns), F.lit(0)))
    coma_points = StepRule("", "below", tuple(coma_cuts)).points(coma)
    low_urine = F.when(F.col(urine) < urine_cuts[1], 4).when(F.col(urine) < urine_cuts[0], 3)
    return (
        F.greatest(pressure.points(), F.when(on_pressor, 2).otherwise(0))
        + step_score(others)
        + coma_points
        + F.greatest(kidney.points(), F.coalesce(low_urine, F.lit(0)))
    )


def screening_score(
    breaths: Column,
    systolic: Column,
    coma: Column,
    limits: tuple[float, float, float] = (
        c.SCREEN_RESP_RATE,
        c.SCREEN_SYSTOLIC,
        c.SCREEN_GCS,
    ),
) -> Column:
    """One point each for fast breathing, low pressure and low coma scale."""
    signs = (breaths >= limits[0], systolic <= limits[1], coma <= limits[2])
    return sum((F.coalesce(s.cast("int"), F.lit(0)) for s in signs), F.lit(0))


def infection_signs(
    antibiotic: Column,
    culture: Column,
    wbc: Column,
    temperature: Column,
    wbc_range: tuple[float, float] = (c.WBC_LOW, c.WBC_HIGH),
    temperature_range: tuple[float, float] = (c.TEMP_LOW, c.TEMP_HIGH),
) -> dict[str, Column]:
    def outside(x: Column, low: float, high: float) -> Column:
        return F.coalesce((x < low) | (x > high), F.lit(False))

    return {
        "antibiotic_sign": F.coalesce(antibiotic > 0, F.lit(False)),
        "culture_sign": F.coalesce(culture > 0, F.lit(False)),
        "wbc_sign": outside(wbc, *wbc_range),
        "temperature_sign": outside(temperature, *temperature_range),
    }


def onset_flag(score: Column, time: Column, threshold: float = c.ONSET_SCORE) -> Column:
    return F.when(score >= threshold, time)


def onset_time(
    df: DataFrame,
    keys: Sequence[str],
    onset: str,
    name: str = "onset_time",
) -> DataFrame:
    """First onset of the whole group, on each of its rows; null keys are one group.

    The minimum is combined before the shuffle and joined back.
    """
    first = df.groupBy(*keys).agg(F.min(onset).alias(name))
    return join_group_values(df, first, keys).select(*df.columns, name)


def running_onset(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    onset: str,
    name: str = "onset_so_far",
) -> DataFrame:
    """First onset up to each row: null before it. Rows with the same time are peers.

    Onsets are times of their own rows, so the first of them is the group's
    earliest, shown from that time on.
    """
    first = onset_time(df, keys, onset, "_first")
    return first.withColumn(
        name, F.when(F.col(time) >= F.col("_first"), F.col("_first"))
    ).drop("_first")


def horizon_label(hours: Column, horizon: float = c.HORIZON_HOURS) -> Column:
    """1 when the event lies 0 to ``horizon`` hours ahead."""
    return F.when(hours.between(0, horizon), 1).otherwise(0)


def labelled(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    score: Column,
    threshold: float = c.ONSET_SCORE,
    horizon: float = c.HORIZON_HOURS,
) -> DataFrame:
    """Score, onset, hours to onset and horizon label for every row."""
    scored = df.withColumn("score", score).withColumn(
        "_onset", onset_flag(F.col("score"), F.col(time), threshold)
    )
    return (
        onset_time(scored, keys, "_onset")
        .withColumn("hours_to_event", hours_between(F.col("onset_time"), F.col(time)))
        .withColumn("label", horizon_label(F.col("hours_to_event"), horizon))
        .drop("_onset")
    )


def lead_time_recall(
    df: DataFrame, hours: str, target: str, predicted: str, windows: Sequence[int]
) -> DataFrame:
    """Recall among rows whose event lies within each number of hours."""
    wanted = [
        F.struct(
            F.lit(w).alias("hours_before"),
            F.sum(F.when(F.col(hours).between(0, w) & (F.col(target) == 1), 1).otherwise(0)).alias(
                "n_events"
            ),
            F.sum(
                F.when(
                    F.col(hours).between(0, w) & (F.col(target) == 1) & (F.col(predicted) == 1), 1
                ).otherwise(0)
            ).alias("n_found"),
        ).alias(f"w{w}")
        for w in windows
    ]
    rows = df.agg(*wanted).select(F.explode(F.array(*[f"w{w}" for w in windows])).alias("r"))
    return rows.select("r.*").withColumn(
        "recall", F.coalesce(F.try_divide("n_found", "n_events"), F.lit(0.0))
    )
