"""Classifier evaluation, calibration, fairness and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.catalog import THRESHOLDS
from tidewatch.functions.expressions import focal_loss as focal
from tidewatch.operators import drift, metrics
from tidewatch.operators.buckets import day_bucket
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import query
from tidewatch.session import work_folder
from tidewatch.sources import tables

COUNTS_SQL = (
    "count(*) FILTER (WHERE y = 1 AND p > {t}) AS tp, "
    "count(*) FILTER (WHERE y = 0 AND p > {t}) AS fp, "
    "count(*) FILTER (WHERE y = 0 AND NOT p > {t}) AS tn, "
    "count(*) FILTER (WHERE y = 1 AND NOT p > {t}) AS fn"
)
RATES_SQL = (
    "round((tp + fn) * 0.0 + (tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, "
    "round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, "
    "round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, "
    "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1, "
    "round(coalesce(tn / nullif(tn + fp, 0), 0), 8) AS specificity, "
    "round(coalesce(tn / nullif(tn + fn, 0), 0), 8) AS npv, "
    "round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 8) "
    "AS balanced_accuracy"
)
CONFUSION_SQL = f"WITH {i.SCORES_SQL}, c AS (SELECT {COUNTS_SQL.format(t=0.5)} FROM scores)"


@query("confusion_counts", f"{CONFUSION_SQL} SELECT tp, fp, tn, fn FROM c")
def confusion_counts(spark, d):
    return metrics.confusion(i.scores(spark, d), "y", "p", 0.5)


@query(
    "basic_metrics",
    f"{CONFUSION_SQL} SELECT accuracy, precision, recall, f1 FROM (SELECT {RATES_SQL} FROM c)",
)
def basic_metrics(spark, d):
    names = ["accuracy", "precision", "recall", "f1"]
    rows = metrics.with_rates(metrics.confusion(i.scores(spark, d), "y", "p", 0.5), names)
    return i.finished(rows.select(*names), 8)


@query(
    "clinical_metrics",
    f"{CONFUSION_SQL} SELECT specificity, npv, balanced_accuracy FROM (SELECT {RATES_SQL} FROM c)",
)
def clinical_metrics(spark, d):
    names = ["specificity", "npv", "balanced_accuracy"]
    rows = metrics.with_rates(metrics.confusion(i.scores(spark, d), "y", "p", 0.5), names)
    return i.finished(rows.select(*names), 8)


GROUPED_SQL = (
    f"WITH {i.SCORES_SQL}, g AS (SELECT q, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg "
    "FROM scores GROUP BY q)"
)


@query(
    "auroc",
    f"{GROUPED_SQL} SELECT round(sum(a.pos * b.neg * CASE WHEN a.q > b.q THEN 1.0 "
    "WHEN a.q = b.q THEN 0.5 ELSE 0.0 END) / sum(a.pos * b.neg), 8) AS auroc "
    "FROM g a CROSS JOIN g b",
)
def auroc(spark, d):
    return i.finished(metrics.areas(i.scores(spark, d), "y", "q").select("auroc"), 8)


CURVE_SQL = (
    f"{GROUPED_SQL}, c AS (SELECT q, pos, sum(pos) OVER (ORDER BY q DESC) AS tp, "
    "sum(neg) OVER (ORDER BY q DESC) AS fp, sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all "
    "FROM g)"
)


@query(
    "average_precision",
    f"{CURVE_SQL} SELECT round(sum(pos / p_all * tp / (tp + fp)), 8) AS average_precision FROM c",
)
def average_precision(spark, d):
    rows = metrics.areas(i.scores(spark, d), "y", "q").select("average_precision")
    return i.finished(rows, 8)


@query(
    "roc_points",
    f"{CURVE_SQL} SELECT round(q, 8) AS threshold, round(fp / n_all, 8) AS fpr, "
    "round(tp / p_all, 8) AS tpr FROM c",
)
def roc_points(spark, d):
    return i.finished(metrics.roc_points(i.scores(spark, d), "y", "q"), 8)


@query(
    "pr_points",
    f"{CURVE_SQL} SELECT round(q, 8) AS threshold, round(tp / (tp + fp), 8) AS precision, "
    "round(tp / p_all, 8) AS recall FROM c",
)
def pr_points(spark, d):
    return i.finished(metrics.pr_points(i.scores(spark, d), "y", "q"), 8)


SWEEP_SQL = (
    f"WITH {i.SCORES_SQL}, th(threshold) AS (SELECT unnest({list(THRESHOLDS)}::DOUBLE[])), "
    f"c AS (SELECT threshold, {COUNTS_SQL.format(t='threshold')} FROM scores CROSS JOIN th "
    f"GROUP BY threshold), sweep AS (SELECT threshold, tp, fp, tn, fn, {RATES_SQL} FROM c)"
)


@query("threshold_sweep", f"{SWEEP_SQL} SELECT * FROM sweep")
def threshold_sweep(spark, d):
    return i.finished(metrics.threshold_sweep(i.scores(spark, d), "y", "p"), 8)


@query(
    "optimal_threshold",
    f"{SWEEP_SQL} SELECT threshold AS optimal_threshold, f1 AS optimal_f1 FROM sweep "
    "ORDER BY f1 DESC, threshold LIMIT 1",
)
def optimal_threshold(spark, d):
    sweep = metrics.threshold_sweep(i.scores(spark, d), "y", "p")
    return i.finished(metrics.optimal_threshold(sweep), 8)


PROFILE_SQL = (
    "count(*) AS n, round(avg(y), 8) AS positive_rate, "
    "round(avg((p > 0.5)::INT), 8) AS predicted_positive_rate, round(avg(p), 8) AS prob_mean, "
    "round(stddev_pop(p), 8) AS prob_std, round(min(p), 8) AS prob_min, round(max(p), 8) AS prob_max"
)


@query("score_profile", f"WITH {i.SCORES_SQL} SELECT {PROFILE_SQL} FROM scores")
def score_profile(spark, d):
    return i.finished(metrics.score_profile(i.scores(spark, d), "y", "p"), 8)


@query(
    "score_profile_daily",
    f"WITH {i.PREDICTIONS_SQL}, t AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, p, "
    f"(event_type = 'error')::INT AS y FROM predictions) SELECT day, {PROFILE_SQL} FROM t "
    "GROUP BY day",
)
def score_profile_daily(spark, d):
    rows = i.predictions(spark, d).select(
        day_bucket(F.col("ts")).alias("day"), "p",
        (F.col("event_type") == "error").cast("int").alias("y"),
    )
    return i.finished(metrics.score_profile(rows, "y", "p", by=["day"]), 8)


_EDGES = metrics.bin_edges(10)
BINS_SQL = (
    f"WITH {i.SCORES_SQL}, e(bin, low, high) AS (VALUES "
    + ", ".join(
        f"({k}, {_EDGES[k]!r}::DOUBLE, {_EDGES[k + 1]!r}::DOUBLE)" for k in range(10)
    )
    + "), bins AS (SELECT bin, low, high, count(p) AS n, coalesce(avg(y), 0) AS accuracy, "
    "coalesce(avg(p), 0) AS confidence, (SELECT count(*) FROM scores) AS n_total "
    "FROM e LEFT JOIN scores ON p > low AND p <= high GROUP BY bin, low, high)"
)


@query(
    "calibration_bins",
    f"{BINS_SQL} SELECT bin, round(low, 8) AS low, round(high, 8) AS high, n, n_total, "
    "round(accuracy, 8) AS accuracy, round(confidence, 8) AS confidence FROM bins",
)
def calibration_bins(spark, d):
    return i.finished(metrics.calibration_bins(i.scores(spark, d), "y", "p"), 8)


@query(
    "ece",
    f"{BINS_SQL} SELECT round(sum(n / n_total * abs(accuracy - confidence)), 8) AS ece FROM bins",
)
def ece(spark, d):
    bins = metrics.calibration_bins(i.scores(spark, d), "y", "p")
    return i.finished(metrics.calibration_error(bins), 8)


@query(
    "score_histogram",
    f"WITH {i.SCORES_SQL}, s AS (SELECT y, min(q) AS low, max(q) AS high, count(*) AS n_class "
    "FROM scores GROUP BY y), b AS (SELECT scores.y, least(floor((q - low) / ((high - low) / 50)), "
    "49)::INT AS bin, n_class, (high - low) / 50 AS width FROM scores JOIN s ON scores.y = s.y) "
    "SELECT y AS class, bin, count(*) AS n, round(count(*) / (max(n_class) * max(width)), 8) "
    "AS density FROM b GROUP BY y, bin",
)
def score_histogram(spark, d):
    return i.finished(metrics.score_histogram(i.scores(spark, d), "y", "q"), 8)


@query(
    "class_report",
    f"{CONFUSION_SQL}, r AS (SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) "
    "AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall, "
    "coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support FROM c "
    "UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), "
    "coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), "
    "tp + fn FROM c) SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, "
    "round(f1, 8) AS f1, support FROM r UNION ALL SELECT 'macro avg', round(avg(precision), 8), "
    "round(avg(recall), 8), round(avg(f1), 8), sum(support)::BIGINT FROM r UNION ALL "
    "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8), "
    "round(sum(recall * support) / sum(support), 8), round(sum(f1 * support) / sum(support), 8), "
    "sum(support)::BIGINT FROM r",
)
def class_report(spark, d):
    return i.finished(metrics.class_report(i.scores(spark, d), "y", "p"), 8)


@query(
    "metrics_by_split",
    f"WITH {i.SCORES_SQL}, c AS (SELECT part, {COUNTS_SQL.format(t=0.5)} FROM scores "
    "GROUP BY part), g AS (SELECT part, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg "
    "FROM scores GROUP BY part, p), cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w "
    "AS fp FROM g WINDOW w AS (PARTITION BY part ORDER BY p DESC)), a AS (SELECT part, "
    "sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auroc, "
    "sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM cum GROUP BY part) "
    f"SELECT part, tp, fp, tn, fn, {RATES_SQL}, round(auroc, 8) AS auroc, "
    "round(average_precision, 8) AS average_precision FROM c JOIN a USING (part)",
)
def metrics_by_split(spark, d):
    return i.finished(metrics.metrics_by(i.scores(spark, d), "y", "p", ["part"]), 8)


@query(
    "evaluation_results",
    f"WITH {i.SCORES_SQL}, c AS (SELECT part, {COUNTS_SQL.format(t=0.5)} FROM scores GROUP BY part) "
    f"SELECT part, tp, fp, tn, fn, {RATES_SQL} FROM c",
)
def evaluation_results(spark, d):
    folder = work_folder(spark, "evaluation")
    counts = metrics.confusion(i.scores(spark, d), "y", "p", 0.5, ["part"])
    results = i.finished(metrics.with_rates(counts), 8)
    tables.write_json(results, folder)
    return spark.read.schema(results.schema).json(folder)


@query(
    "latency_profile",
    "SELECT count(value) AS n, round(avg(value), 8) AS latency_mean, "
    "round(stddev_pop(value), 8) AS latency_std, "
    "round(count(value) / (sum(value) / 1000), 8) AS per_second FROM events",
)
def latency_profile(spark, d):
    return i.finished(metrics.latency_profile(i.events(spark, d), "value"), 8)


def _focal_sql(x: str) -> str:
    hit = f"CASE WHEN y = 1 THEN 1 / (1 + exp(-({x}))) ELSE 1 - 1 / (1 + exp(-({x}))) END"
    bce = f"(greatest({x}, 0) - ({x}) * y + ln(1 + exp(-abs({x}))))"
    return f"(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END * pow(1 - ({hit}), 2) * {bce})"


@query(
    "focal_loss",
    f"WITH {i.SCORES_SQL} SELECT round(avg({_focal_sql('(q - 0.5) * 4')}), 8) AS loss_mean, "
    f"round(sum({_focal_sql('(q - 0.5) * 4')}), 4) AS loss_sum FROM scores",
)
def focal_loss(spark, d):
    loss = focal((F.col("q") - 0.5) * 4, F.col("y"))
    return i.scores(spark, d).agg(
        F.round(metrics.reduced(loss, "mean"), 8).alias("loss_mean"),
        F.round(metrics.reduced(loss, "sum"), 4).alias("loss_sum"),
    )


@query(
    "composite_loss",
    f"WITH {i.SCORES_SQL} SELECT round(avg({_focal_sql('(q - 0.5) * 4')}) "
    f"+ 0.3 * avg({_focal_sql('(p - 0.5) * 2')}) + 0.3 * avg({_focal_sql('q - p')}), 8) AS loss "
    "FROM scores",
)
def composite_loss(spark, d):
    p, q = F.col("p"), F.col("q")
    loss = metrics.composite_loss((q - 0.5) * 4, [(p - 0.5) * 2, q - p], F.col("y"), 0.3)
    return i.finished(i.scores(spark, d).agg(loss.alias("loss")), 8)


def _gaps_sql(rows: str, group: str) -> str:
    edges = ", ".join(
        f"({k}, {_EDGES[k]!r}::DOUBLE, {_EDGES[k + 1]!r}::DOUBLE)" for k in range(10)
    )
    return (
        f"{rows}, r AS (SELECT {group} AS g, avg((p > 0.5)::INT) AS selected, "
        "avg((p > 0.5)::INT) FILTER (WHERE y = 1) AS tpr, "
        "avg((p > 0.5)::INT) FILTER (WHERE y = 0) AS fpr FROM rows GROUP BY 1), "
        f"e(bin, low, high) AS (VALUES {edges}), "
        f"b AS (SELECT {group} AS g, bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap "
        f"FROM rows JOIN e ON p > low AND p <= high GROUP BY 1, 2), "
        f"t AS (SELECT {group} AS g, count(*) AS n_total FROM rows GROUP BY 1), "
        "c AS (SELECT t.g, coalesce(sum(n / n_total * gap), 0) AS ece FROM t LEFT JOIN b "
        "ON t.g = b.g GROUP BY t.g) "
        "SELECT count(*) AS n_groups, round(max(selected) - min(selected), 8) "
        "AS demographic_parity_gap, round(greatest(max(coalesce(tpr, 0)) - min(coalesce(tpr, 0)), "
        "max(coalesce(fpr, 0)) - min(coalesce(fpr, 0))), 8) AS equalized_odds_gap, "
        "round(max(ece) - min(ece), 8) AS calibration_gap FROM r JOIN c USING (g)"
    )


@query(
    "fairness_gaps",
    _gaps_sql(
        "WITH rows AS (SELECT lang, quality AS y, least(n_chars / 5000, 1.0) AS p "
        "FROM documents JOIN labels USING (doc_id))",
        "lang",
    ),
)
def fairness_gaps(spark, d):
    documents = i.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    rows = documents.join(i.table(spark, d, "labels"), "doc_id").select(
        "lang", F.col("quality").alias("y"),
        F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("p"),
    )
    return i.finished(metrics.fairness_gaps(rows, "y", "p", "lang"), 8)


@query(
    "fairness_by_age",
    _gaps_sql(
        f"WITH {i.SCORES_SQL}, rows AS (SELECT y, p, CASE WHEN q * 102 < 40 THEN '<40' "
        "WHEN q * 102 < 65 THEN '40-64' WHEN q * 102 < 80 THEN '65-79' ELSE '80+' END AS age "
        "FROM scores)",
        "age",
    ),
)
def fairness_by_age(spark, d):
    rows = i.scores(spark, d).withColumn("age", metrics.age_group(F.col("q") * 102))
    return i.finished(metrics.fairness_gaps(rows, "y", "p", "age"), 8)


_CELLS = (
    "c AS (SELECT count(*) FILTER (WHERE y = 1 AND p > 0.5)::DOUBLE AS tp, "
    "count(*) FILTER (WHERE y = 0 AND p > 0.5)::DOUBLE AS fp, "
    "count(*) FILTER (WHERE y = 0 AND p <= 0.5)::DOUBLE AS tn, "
    "count(*) FILTER (WHERE y = 1 AND p <= 0.5)::DOUBLE AS fn FROM scores)"
)


@query(
    "bootstrap_ci",
    f"WITH {i.SCORES_SQL}, {_CELLS}, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scores "
    "GROUP BY p), k AS (SELECT pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER "
    "(ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g), "
    "m AS (SELECT 'accuracy' AS metric, (tp + tn) / (tp + fp + tn + fn) AS value FROM c "
    "UNION ALL SELECT 'precision', tp / (tp + fp) FROM c "
    "UNION ALL SELECT 'recall', tp / (tp + fn) FROM c "
    "UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM c "
    "UNION ALL SELECT 'specificity', tn / (tn + fp) FROM c "
    "UNION ALL SELECT 'npv', tn / (tn + fn) FROM c "
    "UNION ALL SELECT 'balanced_accuracy', (tp / (tp + fn) + tn / (tn + fp)) / 2 FROM c "
    "UNION ALL SELECT 'auroc', sum(neg * (tp - pos / 2)) / (max(np) * max(nn)) FROM k "
    "UNION ALL SELECT 'average_precision', sum(pos * tp / (tp + fp)) / max(np) FROM k) "
    "SELECT metric, round(value, 8) AS value, true AS inside, true AS narrow FROM m",
)
def bootstrap_ci(spark, d):
    """Each metric with whether its interval holds it and is as narrow as the class sizes allow."""
    rows = i.scores(spark, d)
    least = metrics.confusion(rows, "y", "p").select(
        F.least(
            F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn"),
            F.col("tp") + F.col("fp"), F.col("tn") + F.col("fn"),
        ).alias("n")
    )
    found = metrics.bootstrap_ci(rows, "y", "p").withColumn("_n", least.scalar())
    # four standard errors of a share are at most two over the root of its denominator
    return i.finished(
        found.select(
            "metric", "value",
            F.col("value").between(F.col("low"), F.col("high")).alias("inside"),
            (F.col("high") - F.col("low") <= 4 / F.sqrt("_n")).alias("narrow"),
        ),
        8,
    )


def _halves(spark, d):
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return i.events(spark, d).select("value", (F.col("ts") >= middle).alias("current"))


HALVES_SQL = "halves AS (SELECT value, ts >= TIMESTAMP '2024-01-16' AS current FROM events)"
EDGES = (10, 20, 40, 60, 80, 100, 150)


_KS_ROOT = "(max(abs(a / n - b / m)) * sqrt((n * m)::DOUBLE / (n + m)))"
# the alternating series alone; it needs more terms where the library takes the other one
_KS_P = (
    "least(1.0, 2 * list_sum(list_transform(range(1, 2000), lambda j: "
    f"(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * pow({_KS_ROOT}, 2)))))"
)


@query(
    "drift_ks",
    f"WITH {HALVES_SQL}, t AS (SELECT count(*) FILTER (WHERE NOT current) AS n, "
    "count(*) FILTER (WHERE current) AS m FROM halves), c AS (SELECT DISTINCT value, "
    "sum((NOT current)::INT) OVER (ORDER BY value) AS a, "
    "sum(current::INT) OVER (ORDER BY value) AS b FROM halves) "
    "SELECT n AS n_reference, m AS n_current, round(max(abs(a / n - b / m)), 8) AS ks, "
    "round(sqrt(-ln(0.05 / 2) / 2) * sqrt((n + m) / (n * m)), 8) AS critical, "
    f"round({_KS_P}, 8) + 0.0 AS p_value, {_KS_P} < 0.05 AS drift "
    "FROM c CROSS JOIN t GROUP BY n, m",
)
def drift_ks(spark, d):
    return i.finished(drift.ks_statistic(_halves(spark, d), "value", "current"), 8)


BINNED_SQL = (
    f"WITH {HALVES_SQL}, x AS (SELECT current, "
    + " + ".join(f"(value > {e})::INT" for e in EDGES)
    + " AS bin FROM halves), b AS (SELECT bin, count(*) FILTER (WHERE NOT current)::DOUBLE AS n, "
    "count(*) FILTER (WHERE current)::DOUBLE AS m FROM x GROUP BY bin), "
    "t AS (SELECT sum(n) AS nt, sum(m) AS mt FROM b)"
)


@query(
    "drift_chi2",
    f"{BINNED_SQL}, s AS (SELECT sum(pow(n - (n + m) * nt / (nt + mt), 2) / ((n + m) * nt "
    "/ (nt + mt)) + pow(m - (n + m) * mt / (nt + mt), 2) / ((n + m) * mt / (nt + mt))) AS chi2, "
    "count(*) - 1 AS dof FROM b CROSS JOIN t), q AS (SELECT chi2, dof, exp(-chi2 / 2 + dof / 2.0 "
    "* ln(chi2 / 2) - lgamma(dof / 2.0)) * list_sum(list_transform(range(0, 400), lambda k: "
    "exp(k * ln(chi2 / 2) - lgamma(dof / 2.0 + k + 1) + lgamma(dof / 2.0)))) AS low FROM s) "
    "SELECT round(chi2, 8) AS chi2, dof, round(1 - low, 8) + 0.0 AS p_value, 1 - low < 0.05 AS drift FROM q",
)
def drift_chi2(spark, d):
    counts = drift.binned_counts(_halves(spark, d), "value", "current", EDGES)
    return i.finished(drift.chi2_statistic(counts), 8)


@query(
    "drift_psi",
    f"{BINNED_SQL}, s AS (SELECT sum((m / mt - n / nt) * ln((m / mt) / (n / nt))) AS psi "
    "FROM b CROSS JOIN t) SELECT round(psi, 8) AS psi, psi > 0.05 AS drift FROM s",
)
def drift_psi(spark, d):
    counts = drift.binned_counts(_halves(spark, d), "value", "current", EDGES)
    return i.finished(drift.psi_statistic(counts), 8)
