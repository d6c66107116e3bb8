"""Scaling, splits, weights, input rules and vector assembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidewatch.functions import catalog as c
from tidewatch.functions import expressions as x
from tidewatch.operators import attribution, quality, scaling, scoring, sequences, splits
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import query
from tidewatch.session import work_folder
from tidewatch.sources import tables

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def _lines(spark, d):
    return i.table(spark, d, "lineitem").select(*KEYS, *COLUMNS)


def _scaled_sql(formula: str, stats: str) -> str:
    out = ", ".join(f"round({formula.format(c=n)}, 8) + 0.0 AS {n}_norm" for n in COLUMNS)
    return (
        f"WITH s AS (SELECT {', '.join(stats.format(c=n) for n in COLUMNS)} FROM lineitem) "
        f"SELECT {', '.join(KEYS)}, {out} FROM lineitem CROSS JOIN s"
    )


@query(
    "normalize_min_max",
    _scaled_sql("({c} - lo_{c}) / (hi_{c} - lo_{c})", "min({c}) AS lo_{c}, max({c}) AS hi_{c}"),
)
def normalize_min_max(spark, d):
    scaled, _ = scaling.fit_min_max(_lines(spark, d), COLUMNS)
    return i.finished(scaled.drop(*COLUMNS), 8)


@query(
    "normalize_z_score",
    _scaled_sql(
        "({c} - m_{c}) / (s_{c} + 1e-8)", "avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}"
    ),
)
def normalize_z_score(spark, d):
    rows = _lines(spark, d)
    stats = scaling.stats_table(rows, COLUMNS, robust=False)
    scaled = scaling.apply_scaling(rows, stats, COLUMNS, "z_score")
    return i.finished(scaled.drop(*COLUMNS), 8)


MEDIANS_SQL = (
    "WITH m AS (SELECT " + ", ".join(f"quantile_disc({n}, 0.5) AS m_{n}" for n in COLUMNS)
    + " FROM lineitem), v AS (SELECT "
    + ", ".join(f"quantile_disc(abs({n} - m_{n}), 0.5) AS d_{n}" for n in COLUMNS)
    + " FROM lineitem CROSS JOIN m)"
)


@query(
    "normalize_robust",
    f"{MEDIANS_SQL} SELECT {', '.join(KEYS)}, "
    + ", ".join(f"round(({n} - m_{n}) / (d_{n} + 1e-8), 6) + 0.0 AS {n}_norm" for n in COLUMNS)
    + " FROM lineitem CROSS JOIN m CROSS JOIN v",
)
def normalize_robust(spark, d):
    rows = _lines(spark, d)
    stats = scaling.medians(rows, COLUMNS)
    scaled = scaling.apply_scaling(rows, stats, COLUMNS, "robust")
    return i.finished(scaled.drop(*COLUMNS), 6)


@query(
    "normalization_stats",
    f"{MEDIANS_SQL} " + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", min({n}) AS min, max({n}) AS max, round(avg({n}), 4) AS mean, "
        f"round(stddev_samp({n}), 4) AS std, round(any_value(m_{n}), 4) AS median, "
        f"round(any_value(d_{n}), 4) AS mad FROM lineitem CROSS JOIN m CROSS JOIN v"
        for n in COLUMNS
    ),
)
def normalization_stats(spark, d):
    folder = work_folder(spark, "stats")
    stats = i.finished(scaling.stats_table(_lines(spark, d), COLUMNS), 4)
    tables.write_json(stats, folder)
    return tables.read_table(
        spark, folder,
        "column string, min double, max double, mean double, std double, median double, mad double",
        "json",
    )


HASH_SQL = "(('0x' || substr(md5('42|' || ({id})::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"
SPLIT_SQL = (
    "CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < {b!r} THEN 'val' ELSE 'test' END"
)


def _split_sql(id_: str) -> str:
    return SPLIT_SQL.format(u=HASH_SQL.format(id=id_), b=0.7 + 0.15)


@query(
    "apply_normalization",
    "WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events "
    f"WHERE {_split_sql('user_id')} = 'train') SELECT event_id, "
    "round((value - lo) / (hi - lo + 1e-8), 8) AS value_norm FROM events CROSS JOIN s "
    f"WHERE {_split_sql('user_id')} <> 'train'",
)
def apply_normalization(spark, d):
    rows = i.events(spark, d).select(
        "event_id", "value", splits.split_of(F.col("user_id")).alias("split")
    )
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    stats = scaling.stats_table(train, ["value"], robust=False)
    scaled = scaling.apply_scaling(rest, stats, ["value"], "min_max")
    return i.finished(scaled.select("event_id", "value_norm"), 8)


@query("split_hash", f"SELECT o_orderkey, {_split_sql('o_orderkey')} AS split FROM orders")
def split_hash(spark, d):
    return i.table(spark, d, "orders").select(
        "o_orderkey", splits.split_of(F.col("o_orderkey")).alias("split")
    )


@query("split_grouped", f"SELECT event_id, {_split_sql('user_id')} AS split FROM events")
def split_grouped(spark, d):
    return i.events(spark, d).select(
        "event_id", splits.split_of(F.col("user_id")).alias("split")
    )


@query(
    "split_exact",
    f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {HASH_SQL.format(id='o_orderkey')},"
    " o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, "
    "CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.7::DOUBLE * n) "
    "+ floor(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r",
)
def split_exact(spark, d):
    return splits.split_exact(i.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_leakage",
    f"WITH e AS (SELECT DISTINCT user_id, {_split_sql('event_id')} AS split FROM events), "
    "p(left_split, right_split) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) "
    "SELECT left_split, right_split, (SELECT count(*) FROM e a JOIN e b ON a.user_id = b.user_id "
    "WHERE a.split = left_split AND b.split = right_split) AS n_shared FROM p",
)
def split_leakage(spark, d):
    rows = i.events(spark, d).select(
        "user_id", splits.split_of(F.col("event_id")).alias("split")
    )
    parts = {n: rows.filter(F.col("split") == n) for n, _ in splits.SPLITS}
    return splits.leaked_ids(parts, "user_id")


@query(
    "split_sinks",
    f"SELECT o_orderkey, o_totalprice, {_split_sql('o_orderkey')} AS split FROM orders",
)
def split_sinks(spark, d):
    folder = work_folder(spark, "splits")
    rows = i.table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", splits.split_of(F.col("o_orderkey")).alias("split")
    )
    tables.write_table(rows, folder, partition_by=["split"])
    return tables.read_table(
        spark, folder, "o_orderkey bigint, o_totalprice double, split string"
    )


@query(
    "class_weights",
    "WITH n AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class, "
    "count(*) AS n_class FROM lineitem GROUP BY 1), k(class) AS (VALUES (0), (1), (2), (3)) "
    "SELECT k.class, coalesce(n_class, 0) AS n_class, "
    "round((SELECT sum(n_class) FROM n) / ((SELECT count(*) FROM n) * coalesce(n_class, 1)), 8) "
    "AS weight FROM k LEFT JOIN n ON k.class = n.class",
)
def class_weights(spark, d):
    flag = F.col("l_returnflag")
    rows = i.table(spark, d, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("class")
    )
    return i.finished(splits.class_weights(rows, "class", (0, 1, 2, 3)), 8)


@query(
    "split_stats",
    f"WITH {i.SCORES_SQL} SELECT {_split_sql('id')} AS split, count(*) AS n, "
    "round(avg(y), 8) AS positive_rate FROM scores GROUP BY 1",
)
def split_stats(spark, d):
    rows = i.scores(spark, d).withColumn("split", splits.split_of(F.col("id")))
    return i.finished(splits.split_stats(rows, "split", "y"), 8)


# hourly means stand in for vital signs
FIELDS = {
    "heart_rate": "error * 3", "systolic_bp": "view", "spo2": "click",
    "respiratory_rate": "purchase", "temperature": "signup + 60",
}


def _rule_sql() -> str:
    cases = []
    for name, source in FIELDS.items():
        low, high = c.VITAL_RANGES[name]
        cases.append(f"CASE WHEN NOT ({source}) BETWEEN {low} AND {high} THEN '{name}' END")
    return f"concat_ws(',', {', '.join(cases)})"


@query(
    "dq_range_rules",
    f"WITH {i.hourly_sql()} SELECT user_id, hour, {_rule_sql()} AS broken FROM hourly",
)
def dq_range_rules(spark, d):
    rows = i.hourly(spark, d).select(
        "user_id", "hour", *[F.expr(e).alias(n) for n, e in FIELDS.items()]
    )
    rules = quality.range_rules({n: c.VITAL_RANGES[n] for n in FIELDS})
    broken = F.array_join(quality.broken_rules(rules), ",")
    return i.finished(rows.select("user_id", "hour", broken.alias("broken")))


@query(
    "dq_required_regex",
    "WITH r AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'M' "
    "WHEN 'MACHINERY' THEN 'F' ELSE c_mktsegment END AS gender, "
    "nullif(c_mktsegment, 'FURNITURE') AS admission_type FROM customer) "
    "SELECT c_custkey, regexp_matches(gender, '^(M|F)$') AS gender_ok, "
    "admission_type IS NOT NULL AS admission_ok FROM r",
)
def dq_required_regex(spark, d):
    segment = F.col("c_mktsegment")
    gender = F.when(segment == "BUILDING", "M").when(segment == "MACHINERY", "F")
    return i.table(spark, d, "customer").select(
        "c_custkey",
        quality.matches(gender.otherwise(segment), c.GENDER_PATTERN).alias("gender_ok"),
        F.nullif(segment, F.lit("FURNITURE")).isNotNull().alias("admission_ok"),
    )


@query(
    "dq_sequence_length",
    f"WITH {i.hourly_sql()}, n AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN "
    "(day(hour) - 1) // 8 ELSE -1 END AS span, count(*) AS n_steps FROM hourly GROUP BY 1, 2) "
    "SELECT user_id, span, n_steps, n_steps BETWEEN 24 AND 72 AS ok FROM n",
)
def dq_sequence_length(spark, d):
    """Lengths of whole sequences: of eight days for every third entity, of the month for others."""
    eight_days = F.floor((F.dayofmonth("hour") - 1) / 8)
    span = F.when(F.col("user_id") % 3 == 0, eight_days).otherwise(F.lit(-1))
    rows = i.hourly(spark, d).groupBy("user_id", span.alias("span")).agg(
        F.count(F.lit(1)).alias("n_steps")
    )
    return rows.select("*", quality.count_ok(F.col("n_steps")).alias("ok"))


@query(
    "dq_vector_shape",
    "SELECT vec_id, len(embedding) = 64 AS flat_ok, false AS short_ok, "
    "len(embedding) = 64 AS any_ok FROM embeddings",
)
def dq_vector_shape(spark, d):
    vector = F.col("embedding")
    pairs = F.transform(vector, lambda v: F.array(v, v))
    return i.table(spark, d, "embeddings").select(
        "vec_id",
        quality.shape_ok(vector, [64]).alias("flat_ok"),
        quality.shape_ok(vector, [32]).alias("short_ok"),
        quality.shape_ok(pairs, [-1, 2]).alias("any_ok"),
    )


RECORD = "event_id bigint, user_id bigint, event_type string, value double, k int"


def _documents(spark, d):
    """Events as JSON records; a few are cut short, as a broken sender would."""
    tag = F.get_json_object("props", "$.k").cast("int")
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value", tag.alias("k")))
    cut = F.expr("substring(record, 1, length(record) - 5)")
    return i.events(spark, d).withColumn("record", record).select(
        "event_id", F.when(tag == 13, cut).otherwise(F.col("record")).alias("record")
    )


@query(
    "dead_letter_split",
    "WITH r AS (SELECT event_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INT) "
    "AS k FROM events), t AS (SELECT event_id, CASE WHEN k = 13 THEN 'parsed' ELSE concat_ws(',', "
    "CASE WHEN NOT value BETWEEN 0.5 AND 150 THEN 'value' END, "
    "CASE WHEN event_type = 'signup' THEN 'event_type' END) END AS broken FROM r) "
    "SELECT event_id, CASE WHEN broken = '' THEN 'good' ELSE 'dead_letter' END AS route, broken "
    "FROM t",
)
def dead_letter_split(spark, d):
    parsed = _documents(spark, d).withColumn("r", F.from_json("record", RECORD))
    known = F.col("r.event_id").isNotNull() & F.col("r.k").isNotNull()
    rules = {
        "value": quality.in_range(F.col("r.value"), 0.5, 150, required=True),
        "event_type": F.coalesce(F.col("r.event_type") != "signup", F.lit(False)),
    }
    violations = F.when(~known, F.array(F.lit("parsed"))).otherwise(quality.broken_rules(rules))
    return parsed.withColumn("violations", violations).select(
        "event_id",
        quality.route(F.col("violations")).alias("route"),
        F.array_join("violations", ",").alias("broken"),
    )


REQUEST = (
    "entity bigint, span bigint, person struct<segment: string, balance: double>, "
    "vitals array<struct<hour: string, error: double, view: double>>"
)


@query(
    "parse_requests",
    f"WITH {i.hourly_sql()}, r AS (SELECT user_id, hour, error, view, (day(hour) - 1) // 3 AS span "
    "FROM hourly) SELECT user_id AS entity, span, c_mktsegment AS segment, "
    "round(c_acctbal, 8) AS balance, (row_number() OVER (PARTITION BY user_id, span "
    "ORDER BY hour) - 1)::INT AS pos, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, "
    "round(error, 8) AS error, round(view, 8) AS view FROM r JOIN customer ON user_id = c_custkey",
)
def parse_requests(spark, d):
    """One request per entity and three days, so all hours are in one and none has over 72."""
    hours = i.hourly(spark, d).withColumn("span", F.floor((F.dayofmonth("hour") - 1) / 3))
    hours = hours.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))
    vitals = hours.groupBy("user_id", "span").agg(
        F.array_sort(F.collect_list(F.struct("hour", "error", "view"))).alias("sequence")
    )
    people = i.table(spark, d, "customer")
    requests = vitals.join(people, vitals.user_id == people.c_custkey).select(
        F.to_json(
            F.struct(
                F.col("user_id").alias("entity"),
                "span",
                F.struct(
                    F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
                ).alias("person"),
                F.col("sequence").alias("vitals"),
            )
        ).alias("text")
    )
    parsed = requests.select(F.from_json("text", REQUEST).alias("r")).select("r.*")
    steps = parsed.select(
        "entity", "span", "person.segment", "person.balance",
        F.posexplode("vitals").alias("pos", "s"),
    )
    return i.finished(
        steps.select("entity", "span", "segment", "balance", "pos", "s.hour", "s.error", "s.view"), 8
    )


@query(
    "risk_tier",
    f"WITH {i.PREDICTIONS_SQL} SELECT event_id, {i.TIER_SQL} AS tier FROM predictions",
)
def risk_tier(spark, d):
    return i.predictions(spark, d).select("event_id", x.risk_tier(F.col("p")).alias("tier"))


@query(
    "confidence",
    f"WITH {i.PREDICTIONS_SQL} SELECT event_id, least(2 * greatest(p, 1 - p), 1.0) AS confidence, "
    "round(abs(2 * p - 1), 8) AS certainty FROM predictions",
)
def confidence(spark, d):
    p = F.col("p")
    return i.predictions(spark, d).select(
        "event_id", x.confidence(p).alias("confidence"),
        F.round(x.certainty(p), 8).alias("certainty"),
    )


@query(
    "impute_defaults",
    "WITH r AS (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL "
    "WHEN event_type = 'view' THEN 0.0 ELSE value END AS v FROM events) "
    "SELECT event_id, coalesce(v, 98.6) AS filled, coalesce(nullif(v, 0), 98.6) AS zero_filled "
    "FROM r",
)
def impute_defaults(spark, d):
    kind = F.col("event_type")
    value = F.when(kind == "click", F.lit(None)).when(kind == "view", 0.0).otherwise(F.col("value"))
    rows = i.events(spark, d).select("event_id", value.cast("double").alias("v"))
    return rows.select(
        "event_id",
        x.default_for(F.col("v"), 98.6).alias("filled"),
        x.default_for(F.col("v"), 98.6, zero_is_missing=True).alias("zero_filled"),
    )


@query(
    "vector_math",
    f"WITH v AS (SELECT vec_id, {i.LOGIT_SQL} AS z FROM embeddings) SELECT vec_id, "
    "round(z, 6) + 0.0 AS dot, round(1 / (1 + exp(-z)), 8) AS sigmoid, "
    "round(CASE WHEN z > 0 THEN z ELSE 0.2 * z END, 6) + 0.0 AS leaky_relu FROM v",
)
def vector_math(spark, d):
    z = scoring.linear_logit(F.col("embedding"), i.WEIGHTS)
    return i.table(spark, d, "embeddings").select(
        "vec_id",
        (F.round(z, 6) + F.lit(0.0)).alias("dot"),
        F.round(x.sigmoid(z), 8).alias("sigmoid"),
        (F.round(x.leaky_relu(z), 6) + F.lit(0.0)).alias("leaky_relu"),
    )


@query(
    "format_ids",
    "SELECT event_id, printf('PATIENT_%06d', user_id) AS entity_id, "
    "'pred_' || (epoch_us(ts) // 1000)::VARCHAR AS prediction_id FROM events",
)
def format_ids(spark, d):
    return i.events(spark, d).select(
        "event_id",
        x.padded_id("PATIENT", F.col("user_id")).alias("entity_id"),
        x.millis_id("pred", F.col("ts")).alias("prediction_id"),
    )


STEP_DEFAULTS = {"error": 80.0, "view": 120.0, "click": 80.0, "purchase": 16.0, "signup": 98.6}
LAB_DEFAULTS = {"error": 7.0, "view": 12.0, "click": 250.0}
WAVE_DEFAULTS = {"signup": 80.0, "purchase": 120.0}


def _entity_sequences(spark, d):
    rows = sequences.last_sequence(
        i.hourly(spark, d), ["user_id"], ["hour"], list(STEP_DEFAULTS), c.SEQUENCE_STEPS
    )
    people = i.table(spark, d, "customer")
    return rows.join(people, rows.user_id == people.c_custkey)


def _last_sql(defaults: dict[str, float]) -> str:
    values = ", ".join(f"coalesce({n}, {v})" for n, v in defaults.items())
    return (
        f"{i.hourly_sql()}, r AS (SELECT user_id, hour, [{values}] AS v, row_number() OVER "
        "(PARTITION BY user_id ORDER BY hour DESC) AS rn FROM hourly), "
        "s AS (SELECT user_id, list(v ORDER BY hour) AS steps FROM r WHERE rn <= 72 "
        "GROUP BY user_id), padded AS (SELECT user_id, list_concat(steps, list_transform("
        "range(72 - len(steps)), lambda k: steps[len(steps)])) AS steps FROM s)"
    )


@query(
    "assemble_vector",
    f"WITH {_last_sql(STEP_DEFAULTS)}, f AS (SELECT user_id, list_concat([c_nationkey::DOUBLE, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END, c_acctbal, 170.0], "
    "flatten(steps)[109:360]) AS v FROM padded JOIN customer ON user_id = c_custkey) "
    "SELECT user_id, unnest(range(256))::INT AS pos, round(unnest(v), 8) AS x FROM f",
)
def assemble_vector(spark, d):
    static = F.array(
        F.col("c_nationkey").cast("double"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0),
        x.default_for(F.col("c_acctbal"), c.PERSON_DEFAULTS["weight"]),
        F.lit(c.PERSON_DEFAULTS["height"]),
    )
    vector = sequences.assemble_vector(
        static, sequences.impute_steps(F.col("sequence"), STEP_DEFAULTS), c.SEQUENCE_STEPS,
        len(STEP_DEFAULTS), c.SERIES_CUT, c.VECTOR_WIDTH,
    )
    rows = _entity_sequences(spark, d).select("user_id", F.posexplode(vector).alias("pos", "x"))
    return i.finished(rows, 8)


RISK_WEIGHTS = [((37 * j) % 11 - 5) / 5000 for j in range(c.VECTOR_WIDTH)]


@query(
    "score_requests",
    f"WITH {_last_sql(STEP_DEFAULTS)}, n AS (SELECT user_id, count(*) AS n_steps FROM r GROUP BY 1), "
    "f AS (SELECT user_id, list_dot_product(list_concat([c_nationkey::DOUBLE, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END, c_acctbal / 100, 170.0], "
    f"flatten(steps)[109:360]), {RISK_WEIGHTS}::DOUBLE[]) AS z "
    "FROM padded JOIN customer ON user_id = c_custkey), "
    "scored AS (SELECT user_id, n_steps, CASE WHEN n_steps BETWEEN 24 AND 72 THEN 1 / (1 + exp(-z)) "
    "ELSE 0.1 END AS p FROM f JOIN n USING (user_id)) "
    "SELECT printf('PATIENT_%06d', user_id) AS entity_id, n_steps::INT AS n_steps, "
    f"round(p, 8) AS p, {i.TIER_SQL} AS tier, round(least(2 * greatest(p, 1 - p), 1.0), 8) "
    "AS confidence FROM scored",
)
def score_requests(spark, d):
    """From an entity's steps to a checked, assembled, scored and tiered record.

    All steps are counted; a request with more than 72 is refused like one with too few.
    """
    steps = F.col("sequence")
    static = F.array(
        F.col("c_nationkey").cast("double"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0),
        x.default_for(F.col("c_acctbal") / 100, c.PERSON_DEFAULTS["weight"]),
        F.lit(c.PERSON_DEFAULTS["height"]),
    )
    vector = sequences.assemble_vector(
        static, sequences.impute_steps(steps, STEP_DEFAULTS), c.SEQUENCE_STEPS,
        len(STEP_DEFAULTS), c.SERIES_CUT, c.VECTOR_WIDTH,
    )
    counts = i.hourly(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n_steps"))
    rows = _entity_sequences(spark, d).join(counts, "user_id").select(
        x.padded_id("PATIENT", F.col("user_id")).alias("entity_id"),
        "n_steps",
        F.when(quality.count_ok(F.col("n_steps")), scoring.linear_score(vector, RISK_WEIGHTS))
        .otherwise(c.FALLBACK_SCORE).alias("p"),
    )
    p = F.col("p")
    return i.finished(
        rows.select("*", x.risk_tier(p).alias("tier"), x.confidence(p).alias("confidence")), 8
    )


def _means_sql(defaults: dict[str, float], name: str) -> str:
    return (
        f"{_last_sql(defaults)} SELECT user_id, pos, avg(x) AS x FROM (SELECT user_id, "
        "unnest(range(len(step))) AS pos, unnest(step) AS x FROM "
        f"(SELECT user_id, unnest(steps) AS step FROM padded)) GROUP BY user_id, pos"
    )


@query(
    "assemble_pooled",
    f"WITH labs AS (WITH {_means_sql(LAB_DEFAULTS, 'labs')}), "
    f"waves AS (WITH {_means_sql(WAVE_DEFAULTS, 'waves')}), "
    "known AS (SELECT user_id, pos, x FROM labs UNION ALL SELECT user_id, pos + 3, x FROM waves), "
    "grid AS (SELECT user_id, unnest(range(64)) AS pos FROM (SELECT DISTINCT user_id FROM known)) "
    "SELECT g.user_id, g.pos::INT AS pos, round(coalesce(k.x, 0), 8) AS x FROM grid g "
    "LEFT JOIN known k ON g.user_id = k.user_id AND g.pos = k.pos",
)
def assemble_pooled(spark, d):
    steps = F.col("sequence")
    vector = sequences.assemble_pooled(
        [
            (sequences.impute_steps(steps, LAB_DEFAULTS), len(LAB_DEFAULTS)),
            (sequences.impute_steps(steps, WAVE_DEFAULTS), len(WAVE_DEFAULTS)),
        ],
        c.SEQUENCE_STEPS,
        c.POOLED_WIDTH,
    )
    rows = _entity_sequences(spark, d).select("user_id", F.posexplode(vector).alias("pos", "x"))
    return i.finished(rows, 8)


def _noise_sql(position: int) -> str:
    u = HASH_SQL.format(id=f"'{2 * position}|' || event_id")
    v = HASH_SQL.format(id=f"'{2 * position + 1}|' || event_id")
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


@query(
    "noise_perturb",
    f"SELECT event_id, round(value + 0.1 * {_noise_sql(0)}, 8) AS value, "
    f"round(least(value / 100, 1.0) + 0.1 * {_noise_sql(1)}, 8) AS p FROM events",
)
def noise_perturb(spark, d):
    rows = i.predictions(spark, d).select("event_id", "value", "p")
    return i.finished(attribution.noise_perturb(rows, "event_id", ["value", "p"], 0.1), 8)


@query(
    "udf_transform",
    "SELECT event_id, round(value * 1.8 + 32, 8) AS fahrenheit FROM events",
)
def udf_transform(spark, d):
    @F.pandas_udf("double")
    def to_fahrenheit(v: pd.Series) -> pd.Series:
        return v * 1.8 + 32

    def convert(df):
        return df.select("event_id", F.round(to_fahrenheit("value"), 8).alias("fahrenheit"))

    return i.events(spark, d).transform(convert)


@query(
    "map_batches",
    "SELECT event_id, value >= 50 AS above, length(event_type)::BIGINT AS letters FROM events",
)
def map_batches(spark, d):
    def describe(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "event_id": frame["event_id"],
                "above": frame["value"] >= 50,
                "letters": frame["event_type"].str.len(),
            }
        )

    rows = i.events(spark, d).select("event_id", "value", "event_type")
    return scoring.map_batches(rows, describe, "event_id long, above boolean, letters long", 4096)
