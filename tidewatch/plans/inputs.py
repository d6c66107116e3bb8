"""The given tables in the roles the operators need, in Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import StepRule
from tidewatch.operators.buckets import day_bucket, hour_bucket, pivot_mean
from tidewatch.sources.tables import read_table

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
TYPES = ("signup", "error", "view", "click", "purchase")
RULES = (
    StepRule("error", "above", (50, 80, 120, 200)),
    StepRule("click", "below", (30, 20, 10, 5)),
    StepRule("view", "above", (60, 150)),
)
ONSET, HORIZON = 4, 72

# a linear model over the 64 embedding numbers, from a rule
WIDTH = 64
WEIGHTS = [((37 * j) % 11 - 5) / 10 for j in range(WIDTH)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, f"{sf_dir}/events.parquet", EVENTS)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(spark: SparkSession, sf_dir: str, types: Sequence[str] = TYPES) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("hour", hour_bucket(F.col("ts")))
    return pivot_mean(rows, ["user_id", "hour"], "event_type", "value", types)


def daily(spark: SparkSession, sf_dir: str, types: Sequence[str] = TYPES) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", day_bucket(F.col("ts")))
    return pivot_mean(rows, ["user_id", "day"], "event_type", "value", types)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a prediction log: risk, latency and entity."""
    return events(spark, sf_dir).select(
        "event_id", "user_id", "ts", "event_type", "value",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("p"),
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stays of three days in the month of the events."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    key = F.col("o_orderkey")
    begin = start + F.make_dt_interval(key % 25, key % 24)
    return table(spark, sf_dir, "orders").select(
        key.alias("stay_id"),
        F.col("o_custkey").alias("user_id"),
        begin.alias("intime"),
        (begin + F.expr("interval 3 days")).alias("outtime"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as targets with two scores: ``p`` in 11 steps, ``q`` in 50."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        (F.col("l_quantity") / 51).alias("q"),
        F.col("l_linestatus").alias("part"),
    )


def finished(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Times without zone, as the tables have them; doubles rounded if asked."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "timestamp":
            c = c.cast("timestamp_ntz")
        elif f.dataType.typeName() == "double" and digits is not None:
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def type_means(types: Sequence[str] = TYPES) -> str:
    return ", ".join(
        f"avg(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in types
    )


def type_list(types: Sequence[str]) -> str:
    return ", ".join(f"'{t}'" for t in types)


def hourly_sql(types: Sequence[str] = TYPES, name: str = "hourly") -> str:
    return (
        f"{name} AS (SELECT user_id, date_trunc('hour', ts) AS hour, {type_means(types)} "
        f"FROM events WHERE event_type IN ({type_list(types)}) GROUP BY 1, 2)"
    )


def daily_sql(types: Sequence[str] = TYPES) -> str:
    return (
        f"daily AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, "
        f"{type_means(types)} "
        f"FROM events WHERE event_type IN ({type_list(types)}) GROUP BY 1, 2)"
    )


STAYS_SQL = (
    "stays AS (SELECT o_orderkey AS stay_id, o_custkey AS user_id, "
    "TIMESTAMP '2024-01-01' + to_days((o_orderkey % 25)::INT) + to_hours((o_orderkey % 24)::INT)"
    " AS intime, TIMESTAMP '2024-01-01' + to_days((o_orderkey % 25)::INT + 3) "
    "+ to_hours((o_orderkey % 24)::INT) AS outtime FROM orders)"
)
PREDICTIONS_SQL = (
    "predictions AS (SELECT event_id, user_id, ts, event_type, value, "
    "least(value / 100, 1.0) AS p FROM events)"
)
SCORES_SQL = (
    "scores AS (SELECT l_orderkey AS id, (l_returnflag = 'R')::INT AS y, l_discount * 10 AS p, "
    "l_quantity / 51 AS q, l_linestatus AS part FROM lineitem)"
)
SCORE_SQL = (
    "(CASE WHEN error > 200 THEN 4 WHEN error > 120 THEN 3 WHEN error > 80 THEN 2 "
    "WHEN error > 50 THEN 1 ELSE 0 END + CASE WHEN click < 5 THEN 4 WHEN click < 10 THEN 3 "
    "WHEN click < 20 THEN 2 WHEN click < 30 THEN 1 ELSE 0 END + CASE WHEN view > 150 THEN 2 "
    "WHEN view > 60 THEN 1 ELSE 0 END)"
)
TIER_SQL = (
    "CASE WHEN p < 0.2 THEN 'low' WHEN p < 0.5 THEN 'medium' WHEN p < 0.8 THEN 'high' "
    "ELSE 'critical' END"
)
VECTOR_SQL = "[" + ", ".join(repr(w) for w in WEIGHTS) + "]::DOUBLE[]"
LOGIT_SQL = f"list_dot_product(embedding::DOUBLE[], {VECTOR_SQL})"
