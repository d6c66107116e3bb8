"""Prediction log, risk overview, alerts, operations, privacy and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import catalog as c
from tidewatch.functions.expressions import ALERT_TIERS, TIERS, risk_tier
from tidewatch.operators.sequences import last_rows


def latest_per_entity(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Latest record per entity; each input partition passes on one row per entity."""
    others = [n for n in df.columns if n != entity]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(entity).agg(newest.alias("_r")).select(entity, "_r.*").select(*df.columns)


def alerts(df: DataFrame, p: str) -> DataFrame:
    """Rows in the two upper tiers."""
    return df.withColumn("tier", risk_tier(F.col(p))).filter(F.col("tier").isin(*ALERT_TIERS))


def recent_alerts(df: DataFrame, order: Sequence[str], n: int = c.KEPT_ALERTS) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order]).limit(n)


def risk_summary(
    latest: DataFrame, p: str, alert_log: DataFrame, time: str, as_of: Column
) -> DataFrame:
    """Entities, high-risk entities, mean risk, and alerts in the hour before ``as_of``."""
    overview = latest.agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_if(risk_tier(F.col(p)).isin(*ALERT_TIERS)).alias("high_risk_entities"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("average_risk"),
    )
    active = alert_log.agg(
        F.count_if(
            (F.col(time) > as_of - F.expr("interval 1 hour")) & (F.col(time) <= as_of)
        )
    )
    return overview.withColumn("active_alerts", active.scalar())


def risk_distribution(latest: DataFrame, p: str) -> DataFrame:
    """Entities per tier, empty tiers included."""
    tier = risk_tier(F.col(p))
    one = latest.agg(*[F.count_if(tier == t).alias(t) for t in TIERS])
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("n")) for t in TIERS])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def leaderboard(latest: DataFrame, p: str, entity: str, n: int | None = None) -> DataFrame:
    ranked = latest.withColumn("tier", risk_tier(F.col(p))).orderBy(F.desc(p), entity)
    return ranked.limit(n) if n else ranked


def risk_timeline(df: DataFrame, entity: str, time: str, p: str) -> DataFrame:
    """Risk in percent over time, with the tier band and its limits."""
    tier = risk_tier(F.col(p))
    band = F.when(tier == "low", 20).when(tier == "medium", 50).when(tier == "high", 80)
    return df.select(
        entity, time, (F.col(p) * 100).alias("risk_percent"), tier.alias("tier"),
        band.otherwise(100).alias("band_top"),
    )


def history(df: DataFrame, entity: str, order: Sequence[str], n: int = c.HISTORY_POINTS):
    return last_rows(df, [entity], order, n)


def prediction_log(
    df: DataFrame, entity: str, time: str, p: str, millis: str
) -> DataFrame:
    return df.select(
        F.col(time).alias("logged_at"),
        F.col(entity).cast("string").alias("entity_id"),
        F.col(p).alias("probability"),
        F.col(millis).alias("processing_time_ms"),
    )


def ops_alerts(
    df: DataFrame, time: str, millis: str, failed: str, window: str = "1 hour",
    latency_limit: float = c.LATENCY_LIMIT_MS, error_limit: float = c.ERROR_RATE_LIMIT,
) -> DataFrame:
    """Windows whose mean latency or error rate is above its limit."""
    return (
        df.groupBy(F.window(time, window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(millis).alias("latency_mean"),
            (F.count_if(failed) / F.count(F.lit(1))).alias("error_rate"),
        )
        .select(
            F.col("w.start").alias("window_start"), "n", "latency_mean", "error_rate",
            (F.col("latency_mean") > latency_limit).alias("latency_alert"),
            (F.col("error_rate") > error_limit).alias("error_alert"),
        )
        .filter("latency_alert or error_alert")
    )


def fallback_score(p: Column, fallback: float = c.FALLBACK_SCORE) -> Column:
    """The score, or the fallback when scoring gave nothing usable."""
    return F.when(p.isNull() | F.isnan(p), F.lit(fallback)).otherwise(p)


def mask_identifiers(
    df: DataFrame, hashed: Sequence[str], dropped: Sequence[str], salt: str
) -> DataFrame:
    """Identifiers as salted hashes, names dropped."""
    return df.drop(*dropped).withColumns(
        {
            h: F.sha2(F.concat(F.lit(salt), F.col(h).cast("string")), 256)
            for h in hashed
        }
    )


def within_retention(
    time: Column, as_of: Column, days: int = c.RETENTION_DAYS, years: int = 0
) -> Column:
    """Whether a row is young enough to keep: 90 days for predictions, 7 years for records."""
    return time >= as_of - F.expr(f"interval {years} years") - F.expr(f"interval {days} days")
