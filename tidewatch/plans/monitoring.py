"""Risk overview, alerts, logs, operations, privacy, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import catalog as c
from tidewatch.operators import monitor
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import query
from tidewatch.session import work_folder
from tidewatch.sources import tables

LATEST_SQL = (
    f"WITH {i.PREDICTIONS_SQL}, latest AS (SELECT * FROM predictions QUALIFY row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
)


def latest(spark, d):
    return monitor.latest_per_entity(i.predictions(spark, d), "user_id", ["ts", "event_id"])


@query(
    "alert_rows",
    f"WITH {i.PREDICTIONS_SQL}, t AS (SELECT event_id, user_id, {i.TIER_SQL} AS tier "
    "FROM predictions) SELECT * FROM t WHERE tier IN ('high', 'critical')",
)
def alert_rows(spark, d):
    return monitor.alerts(i.predictions(spark, d), "p").select("event_id", "user_id", "tier")


@query(
    "entity_lookup",
    "SELECT event_id, ts, event_type, value FROM events WHERE user_id = 8",
)
def entity_lookup(spark, d):
    rows = i.events(spark, d).filter(F.col("user_id") == 8)
    return i.finished(rows.select("event_id", "ts", "event_type", "value"))


@query(
    "latest_per_entity",
    f"{LATEST_SQL} SELECT user_id, event_id, ts, event_type, value FROM latest",
)
def latest_per_entity(spark, d):
    return i.finished(latest(spark, d).select("user_id", "event_id", "ts", "event_type", "value"))


@query(
    "risk_leaderboard",
    f"{LATEST_SQL} SELECT user_id, p, {i.TIER_SQL} AS tier FROM latest ORDER BY p DESC, user_id",
)
def risk_leaderboard(spark, d):
    return monitor.leaderboard(latest(spark, d).select("user_id", "p"), "p", "user_id")


@query(
    "recent_alerts",
    f"WITH {i.PREDICTIONS_SQL}, t AS (SELECT event_id, ts, user_id, {i.TIER_SQL} AS tier "
    "FROM predictions) SELECT * FROM t WHERE tier IN ('high', 'critical') "
    "ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def recent_alerts(spark, d):
    rows = monitor.alerts(i.predictions(spark, d), "p").select("event_id", "ts", "user_id", "tier")
    return i.finished(monitor.recent_alerts(rows, ["ts", "event_id"], c.KEPT_ALERTS))


@query(
    "risk_summary",
    f"{LATEST_SQL}, now AS (SELECT max(ts) AS ts FROM events) SELECT count(*) AS total_entities, "
    "count(*) FILTER (WHERE p >= 0.5) AS high_risk_entities, round(avg(p), 8) AS average_risk, "
    "(SELECT count(*) FROM predictions, now WHERE p >= 0.5 "
    "AND predictions.ts > now.ts - INTERVAL 1 HOUR) AS active_alerts FROM latest",
)
def risk_summary(spark, d):
    log = i.predictions(spark, d)
    now = log.agg(F.max("ts")).scalar()
    rows = monitor.risk_summary(latest(spark, d), "p", monitor.alerts(log, "p"), "ts", now)
    return i.finished(rows, 8)


@query(
    "risk_distribution",
    f"{LATEST_SQL}, t(tier) AS (VALUES ('low'), ('medium'), ('high'), ('critical')), "
    f"n AS (SELECT {i.TIER_SQL} AS tier, count(*) AS n FROM latest GROUP BY 1) "
    "SELECT tier, coalesce(n, 0) AS n FROM t LEFT JOIN n USING (tier)",
)
def risk_distribution(spark, d):
    return monitor.risk_distribution(latest(spark, d), "p")


@query(
    "risk_timeline",
    f"WITH {i.PREDICTIONS_SQL} SELECT user_id, ts, round(p * 100, 8) AS risk_percent, "
    f"{i.TIER_SQL} AS tier, CASE WHEN p < 0.2 THEN 20 WHEN p < 0.5 THEN 50 WHEN p < 0.8 THEN 80 "
    "ELSE 100 END AS band_top FROM predictions",
)
def risk_timeline(spark, d):
    return i.finished(monitor.risk_timeline(i.predictions(spark, d), "user_id", "ts", "p"), 8)


@query(
    "prediction_log",
    f"WITH {i.PREDICTIONS_SQL} SELECT ts AS logged_at, user_id::VARCHAR AS entity_id, "
    "p AS probability, value AS processing_time_ms FROM predictions",
)
def prediction_log(spark, d):
    folder = work_folder(spark, "prediction-log")
    log = monitor.prediction_log(i.predictions(spark, d), "user_id", "ts", "p", "value")
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp")
    tables.append_log(log.filter(F.col("logged_at") < middle), folder)
    tables.append_log(log.filter(F.col("logged_at") >= middle), folder)
    schema = (
        "logged_at timestamp, entity_id string, probability double, processing_time_ms double"
    )
    return i.finished(tables.read_table(spark, folder, schema))


@query(
    "ops_alerts",
    "WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, "
    "avg(value * 100) AS latency_mean, count(*) FILTER (WHERE event_type = 'error') / count(*) "
    "AS error_rate FROM events GROUP BY 1) SELECT window_start, n, "
    "round(latency_mean, 6) AS latency_mean, round(error_rate, 8) AS error_rate, "
    "latency_mean > 2000 AS latency_alert, error_rate > 0.05 AS error_alert FROM w "
    "WHERE latency_mean > 2000 OR error_rate > 0.05",
)
def ops_alerts(spark, d):
    log = i.events(spark, d).select(
        "ts", (F.col("value") * 100).alias("ms"), (F.col("event_type") == "error").alias("failed")
    )
    rows = monitor.ops_alerts(log, "ts", "ms", "failed")
    return i.finished(
        rows.withColumn("latency_mean", F.round("latency_mean", 6)).withColumn(
            "error_rate", F.round("error_rate", 8)
        )
    )


@query(
    "fallback_score",
    f"WITH {i.PREDICTIONS_SQL} SELECT event_id, CASE WHEN event_type = 'signup' THEN 0.1 ELSE p END "
    "AS p FROM predictions",
)
def fallback_score(spark, d):
    p = F.when(F.col("event_type") != "signup", F.col("p"))
    return i.predictions(spark, d).select("event_id", monitor.fallback_score(p).alias("p"))


@query(
    "decision_alerts",
    f"WITH {i.PREDICTIONS_SQL} SELECT event_id, user_id, p FROM predictions WHERE p >= 0.7",
)
def decision_alerts(spark, d):
    rows = i.predictions(spark, d).filter(F.col("p") >= c.DECISION_ALERT)
    return rows.select("event_id", "user_id", "p")


@query(
    "mask_identifiers",
    "SELECT sha256('pepper' || c_custkey::VARCHAR) AS c_custkey, c_nationkey, c_acctbal, "
    "c_mktsegment FROM customer",
)
def mask_identifiers(spark, d):
    return monitor.mask_identifiers(
        i.table(spark, d, "customer"), ["c_custkey"], ["c_name"], "pepper"
    )


@query(
    "retention_filter",
    "SELECT o_orderkey, o_orderdate FROM orders "
    "WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY",
)
def retention_filter(spark, d):
    rows = i.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    as_of = rows.agg(F.max("o_orderdate")).scalar()
    return rows.filter(monitor.within_retention(F.col("o_orderdate"), as_of))


@query(
    "retention_years",
    "SELECT o_orderkey, o_orderdate FROM orders "
    "WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 YEAR",
)
def retention_years(spark, d):
    rows = i.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    as_of = rows.agg(F.max("o_orderdate")).scalar()
    kept = monitor.within_retention(F.col("o_orderdate"), as_of, 0, c.RETENTION_YEARS)
    return rows.filter(kept)
