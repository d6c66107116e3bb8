"""Binary classification metrics over target and score columns.

Counts come from one aggregation. Curves and areas work on distinct scores with
running sums (see ``ordered``), never on a sort of all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.catalog import THRESHOLDS
from tidewatch.functions.expressions import focal_loss, ratio
from tidewatch.operators.ordered import (
    ROWS_PER_TASK,
    join_group_values,
    row_numbers,
    running_sums,
)
from tidewatch.session import written_once

COUNTS = ("tp", "fp", "tn", "fn")


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _cells(y: Column, hit: Column) -> dict[str, Column]:
    return {
        "tp": _count((y == 1) & hit),
        "fp": _count((y == 0) & hit),
        "tn": _count((y == 0) & ~hit),
        "fn": _count((y == 1) & ~hit),
    }


def confusion(
    df: DataFrame, y: str, p: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Counts at the strict decision ``p > threshold``."""
    cells = _cells(F.col(y), F.col(p) > threshold)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])


def rates() -> dict[str, Column]:
    """Metrics over the four counts; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    specificity = ratio(tn, tn + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": specificity,
        "npv": ratio(tn, tn + fn),
        "balanced_accuracy": (recall + specificity) / 2,
    }


def with_rates(counts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    wanted = rates()
    return counts.select("*", *[wanted[n].alias(n) for n in names or wanted])


def threshold_sweep(
    df: DataFrame, y: str, p: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Counts and rates per threshold.

    All thresholds are counted side by side in one pass; rows are not repeated
    per threshold.
    """
    cells = [
        F.struct(
            F.lit(t).alias("threshold"),
            *[c.cast("long").alias(n) for n, c in _cells(F.col(y), F.col(p) > t).items()],
        ).alias(f"t{i}")
        for i, t in enumerate(thresholds)
    ]
    one = df.agg(*cells)
    rows = one.select(
        F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("r")
    ).select("r.*")
    return with_rates(rows)


def optimal_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the best F1; the lowest wins a tie."""
    best = F.max_by(
        F.struct("threshold", "f1"), F.struct(F.col("f1"), (-F.col("threshold")).alias("low"))
    )
    return sweep.agg(best.alias("b")).select(
        F.col("b.threshold").alias("optimal_threshold"), F.col("b.f1").alias("optimal_f1")
    )


def score_profile(df: DataFrame, y: str, p: str, threshold: float = 0.5, by=()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(y).cast("double")).alias("positive_rate"),
        F.avg((F.col(p) > threshold).cast("double")).alias("predicted_positive_rate"),
        F.avg(p).alias("prob_mean"),
        F.stddev_pop(p).alias("prob_std"),
        F.min(p).alias("prob_min"),
        F.max(p).alias("prob_max"),
    )


def score_counts(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Per distinct score: its counts, and the counts at or above it (``tp``, ``fp``)."""
    by = list(by)
    falling = df.select(*by, F.col(y).alias("_y"), F.col(p).alias("_p"), (-F.col(p)).alias("_down"))
    counts = falling.groupBy(*by, "_down").agg(
        F.max("_p").alias("score"),
        _count(F.col("_y") == 1).alias("pos"),
        _count(F.col("_y") == 0).alias("neg"),
    )
    doubled = counts.select("*", F.col("pos").alias("tp"), F.col("neg").alias("fp"))
    return running_sums(doubled, by, ["_down"], ["tp", "fp"], limit).drop("_down")


def areas(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """AUROC (ties count half) and average precision; 0 if a class is missing.

    Average precision sums precision times recall gain over falling distinct
    scores. One class alone gives 0 for both.
    """
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    one = score_counts(df, y, p, by, limit).groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(neg * (tp - pos / 2)).alias("_roc"),
        F.sum(pos * tp / (tp + fp)).alias("_ap"),
    )
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return one.select(
        *by,
        "n_pos",
        "n_neg",
        ratio(F.col("_roc"), n_pos * n_neg).alias("auroc"),
        F.when(F.col("n_neg") > 0, ratio(F.col("_ap"), n_pos)).otherwise(0.0).alias(
            "average_precision"
        ),
    )


def _totals(df: DataFrame, y: str) -> Column:
    """Struct of the class sizes, as a scalar subquery."""
    return df.agg(
        F.struct(
            _count(F.col(y) == 1).alias("n_pos"), _count(F.col(y) == 0).alias("n_neg")
        ).alias("t")
    ).scalar()


def roc_points(df: DataFrame, y: str, p: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    counts = score_counts(df, y, p, (), limit).withColumn("_t", _totals(df, y))
    return counts.select(
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("_t.n_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("_t.n_pos")).alias("tpr"),
    )


def pr_points(df: DataFrame, y: str, p: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    counts = score_counts(df, y, p, (), limit).withColumn("_t", _totals(df, y))
    return counts.select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("_t.n_pos")).alias("recall"),
    )


def bin_edges(n_bins: int = 10) -> list[float]:
    """Edges of equal bins over [0, 1]: multiples of the step, the last exactly 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def calibration_bins(
    df: DataFrame, y: str, p: str, n_bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Share of positives, mean score and count per bin (low, high]; empty bins give 0.

    A score of 0 lies in no bin. ``n_total`` counts all rows, those in no bin
    included.
    """
    edges = bin_edges(n_bins)
    score, hit = F.col(p), F.col(y).cast("double")
    cells = []
    for i in range(n_bins):
        inside = (score > edges[i]) & (score <= edges[i + 1])
        cells.append(
            F.struct(
                F.lit(i).alias("bin"),
                F.lit(edges[i]).alias("low"),
                F.lit(edges[i + 1]).alias("high"),
                F.coalesce(F.avg(F.when(inside, hit)), F.lit(0.0)).alias("accuracy"),
                F.coalesce(F.avg(F.when(inside, score)), F.lit(0.0)).alias("confidence"),
                _count(inside).alias("n"),
            ).alias(f"b{i}")
        )
    one = df.groupBy(*by).agg(*cells, F.count(F.lit(1)).alias("n_total"))
    rows = F.explode(F.array(*[f"b{i}" for i in range(n_bins)])).alias("r")
    return one.select(*by, "n_total", rows).select(*by, "n_total", "r.*")


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col("n") / F.col("n_total") * F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.groupBy(*by).agg(F.sum(gap).alias("ece"))


def score_histogram(df: DataFrame, y: str, p: str, n_bins: int = 50) -> DataFrame:
    """Density per class over equal bins between the class's own smallest and largest score.

    A class with a single score gets a range of 1 around it.
    """
    half = F.when(F.min(p) == F.max(p), 0.5).otherwise(0.0)
    spans = df.groupBy(F.col(y).alias("class")).agg(
        (F.min(p) - half).alias("low"),
        (F.max(p) + half).alias("high"),
        F.count(F.lit(1)).alias("n_class"),
    )
    scored = df.select(F.col(y).alias("class"), F.col(p).alias("_p"))
    placed = join_group_values(scored, spans, ["class"])
    width = (F.col("high") - F.col("low")) / n_bins
    at = F.floor((F.col("_p") - F.col("low")) / width).cast("int")
    binned = placed.withColumn("bin", F.least(at, F.lit(n_bins - 1)))
    return (
        binned.groupBy("class", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("n_class").alias("_n"),
            F.max(width).alias("_w"),
        )
        .select(
            "class", "bin", "n",
            (F.col("n") / (F.col("_n") * F.col("_w"))).alias("density"),
        )
    )


def class_report(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, then plain and weighted means."""
    one = confusion(df, y, p, threshold)
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)

    def row(name: str, hit: Column, false: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + false).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + false + missed).alias("f1"),
            (hit + missed).cast("long").alias("support"),
        )

    classes = one.select(row("0", tn, fn, fp).alias("a"), row("1", tp, fp, fn).alias("b"))
    names = ("precision", "recall", "f1")
    total = F.col("a.support") + F.col("b.support")

    def mean(name: str, weights: tuple[Column, Column]) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[
                ratio(
                    F.col(f"a.{m}") * weights[0] + F.col(f"b.{m}") * weights[1],
                    weights[0] + weights[1],
                ).alias(m)
                for m in names
            ],
            total.alias("support"),
        )

    plain = mean("macro avg", (F.lit(1), F.lit(1)))
    weighted = mean("weighted avg", (F.col("a.support"), F.col("b.support")))
    return classes.select(
        F.explode(F.array(F.col("a"), F.col("b"), plain, weighted)).alias("r")
    ).select("r.*")


def metrics_by(
    df: DataFrame, y: str, p: str, by: Sequence[str], threshold: float = 0.5,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Counts, rates and areas per group; null keys are one group."""
    counts = with_rates(confusion(df, y, p, threshold, by))
    return join_group_values(counts, areas(df, y, p, by, limit).drop("n_pos", "n_neg"), by)


def latency_profile(df: DataFrame, millis: str, samples: str | None = None) -> DataFrame:
    """Latency per log row, and samples per second; a row is one sample unless it says more."""
    count = F.sum(samples) if samples else F.count(millis)
    return df.agg(
        F.count(millis).alias("n"),
        F.avg(millis).alias("latency_mean"),
        F.stddev_pop(millis).alias("latency_std"),
        ratio(count, F.sum(millis) / 1000).alias("per_second"),
    )


def reduced(loss: Column, reduction: str) -> Column:
    if reduction == "mean":
        return F.avg(loss)
    if reduction == "sum":
        return F.sum(loss)
    raise ValueError(f"unknown reduction: {reduction}")


def composite_loss(
    main: Column, auxiliary: Sequence[Column], target: Column, weight: float = 0.3
) -> Column:
    """Mean focal loss of the main logit plus weighted ones of the auxiliary logits."""
    total = F.avg(focal_loss(main, target))
    for logit in auxiliary:
        total = total + weight * F.avg(focal_loss(logit, target))
    return total


def fairness_gaps(df: DataFrame, y: str, p: str, group: str, threshold: float = 0.5) -> DataFrame:
    """Largest difference between groups in selection, true/false positive rate and ECE.

    Rows without a group are a group of their own.
    """
    counts = confusion(df, y, p, threshold, [group])
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    per_group = join_group_values(
        counts.select(
            group,
            ratio(tp + fp, tp + fp + tn + fn).alias("selected"),
            ratio(tp, tp + fn).alias("tpr"),
            ratio(fp, fp + tn).alias("fpr"),
        ),
        calibration_error(calibration_bins(df, y, p, by=[group]), [group]),
        [group],
    )

    def gap(name: str) -> Column:
        return F.max(name) - F.min(name)

    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        gap("selected").alias("demographic_parity_gap"),
        F.greatest(gap("tpr"), gap("fpr")).alias("equalized_odds_gap"),
        gap("ece").alias("calibration_gap"),
    )


def age_group(age: Column) -> Column:
    return F.when(age < 40, "<40").when(age < 65, "40-64").when(age < 80, "65-79").otherwise("80+")


SCORES_PER_TASK = 1_000


def bootstrap_ci(
    df: DataFrame, y: str, p: str, threshold: float = 0.5, n_resamples: int = 1000,
    level: float = 0.95, seed: int = 42,
) -> DataFrame:
    """Percentile intervals of the rates, AUROC and average precision over Poisson resamples.

    A Poisson(1) weight per row sums to Poisson(n) over the n rows of a score and class, so
    a resample draws two numbers per distinct score. Scores are drawn in chunks of
    ``SCORES_PER_TASK`` in falling order; the draws depend on seed and chunk alone, so the second
    pass, which knows how many positives and negatives lie above a chunk, draws the same again.
    """
    falling = df.select(F.col(y).alias("_y"), F.col(p).alias("_p")).groupBy("_p").agg(
        _count(F.col("_y") == 1).alias("pos"), _count(F.col("_y") == 0).alias("neg")
    )
    numbered = row_numbers(falling.withColumn("_down", -F.col("_p")), [], ["_down"], "_k")
    chunked = numbered.select(
        F.floor((F.col("_k") - 1) / SCORES_PER_TASK).alias("chunk"), "_k",
        (F.col("_p") > threshold).alias("hit"), "pos", "neg",
    )

    def drawn(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        frame = frame.sort_values("_k")
        rng = np.random.default_rng([seed, int(frame["chunk"].iloc[0])])
        size = (len(frame), n_resamples)
        pos = rng.poisson(frame["pos"].to_numpy()[:, None], size)
        neg = rng.poisson(frame["neg"].to_numpy()[:, None], size)
        return frame["hit"].fillna(False).to_numpy(bool)[:, None], pos, neg

    def totals(frame: pd.DataFrame) -> pd.DataFrame:
        hit, pos, neg = drawn(frame)
        area = (neg * (np.cumsum(pos, axis=0) - pos / 2)).sum(axis=0)
        return pd.DataFrame(
            {
                "chunk": frame["chunk"].iloc[0], "r": np.arange(n_resamples),
                "p": pos.sum(axis=0), "n": neg.sum(axis=0), "area": area,
                "tp": (pos * hit).sum(axis=0), "fp": (neg * hit).sum(axis=0),
            }
        )

    def precision(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        _, pos, neg = drawn(frame)
        above = above.sort_values("r")
        tp = np.cumsum(pos, axis=0) + above["p0"].to_numpy()
        fp = np.cumsum(neg, axis=0) + above["n0"].to_numpy()
        return pd.DataFrame(
            {"r": above["r"], "ap": (pos * tp / np.maximum(tp + fp, 1)).sum(axis=0)}
        )

    parts = written_once(
        chunked.groupBy("chunk").applyInPandas(
            totals, "chunk long, r long, p long, n long, area double, tp long, fp long"
        ),
        "bootstrap",
    )
    before = Window.partitionBy("r").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    above = parts.select(
        "chunk", "r", "n", "area",
        F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    ap = (
        chunked.groupBy("chunk")
        .cogroup(above.groupBy("chunk"))
        .applyInPandas(precision, "r long, ap double")
        .groupBy("r")
        .agg(F.sum("ap").alias("ap"))
    )
    area = above.groupBy("r").agg(F.sum(F.col("area") + F.col("n") * F.col("p0")).alias("area"))
    counts = parts.groupBy("r").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        (F.sum("n") - F.sum("fp")).alias("tn"), (F.sum("p") - F.sum("tp")).alias("fn"),
    )
    n_pos, n_neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    resampled = with_rates(counts).join(area, "r").join(ap, "r").select(
        *rates(),
        ratio(F.col("area"), (n_pos * n_neg).cast("double")).alias("auroc"),
        F.when(n_neg > 0, ratio(F.col("ap"), n_pos.cast("double"))).otherwise(0.0).alias(
            "average_precision"
        ),
    )
    names = [*rates(), "auroc", "average_precision"]
    tail = (1 - level) / 2
    bounds = resampled.agg(
        *[F.percentile(n, [tail, 0.5, 1 - tail]).alias(n) for n in names]  # n_resamples rows
    )
    point = with_rates(confusion(df, y, p, threshold)).select(
        *[F.col(n).alias(f"_{n}") for n in rates()]
    )
    curve = areas(df, y, p).select(
        *[F.col(n).alias(f"_{n}") for n in ("auroc", "average_precision")]
    )
    both = bounds.withColumn("_point", point.select(F.struct("*")).scalar()).withColumn(
        "_curve", curve.select(F.struct("*")).scalar()
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                F.col(f"_point._{n}" if n in rates() else f"_curve._{n}").alias("value"),
                F.col(n)[0].alias("low"),
                F.col(n)[2].alias("high"),
            )
            for n in names
        ]
    )
    return both.select(F.explode(rows).alias("r")).select("r.*")
