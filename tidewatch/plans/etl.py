"""Scans, filters, joins, buckets, labels, sequences and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import catalog as c
from tidewatch.functions.expressions import hours_between, step_score
from tidewatch.operators import buckets, cohort, labels, scaling, sequences, splits
from tidewatch.operators.ordered import running_sums
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import query
from tidewatch.session import work_folder
from tidewatch.sources import tables

LABS, VITALS = ("signup", "error", "view"), ("click", "purchase")
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


@query("scan_measurements", "SELECT event_id, user_id, ts, event_type, value FROM events")
def scan_measurements(spark, d):
    rows = i.events(spark, d).select("event_id", "user_id", "ts", "event_type", "value")
    return i.finished(rows)


@query("scan_csv_roundtrip", "SELECT * FROM orders")
def scan_csv_roundtrip(spark, d):
    folder = work_folder(spark, "orders-csv")
    rows = i.table(spark, d, "orders")
    tables.write_manifest(rows, folder, rows.columns, compression="gzip")
    return tables.read_gzip_csv(spark, folder, ORDERS)


@query(
    "sink_partitioned_roundtrip",
    "SELECT event_id, user_id, value, event_type FROM events",
)
def sink_partitioned_roundtrip(spark, d):
    folder = work_folder(spark, "events-by-type")
    rows = i.events(spark, d).select("event_id", "user_id", "value", "event_type")
    tables.write_table(rows, folder, partition_by=["event_type"])
    schema = "event_id bigint, user_id bigint, value double, event_type string"
    return tables.read_table(spark, folder, schema)


@query(
    "filter_signals",
    "SELECT event_id, ts, event_type, value FROM events "
    "WHERE CAST(json_extract_string(props, '$.k') AS INT) = 1 "
    "AND event_type IN ('error', 'view', 'click')",
)
def filter_signals(spark, d):
    tag = F.get_json_object("props", "$.k").cast("int")
    rows = i.events(spark, d).filter(
        (tag == 1) & F.col("event_type").isin("error", "view", "click")
    )
    return i.finished(rows.select("event_id", "ts", "event_type", "value"))


@query(
    "filter_items",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem "
    "WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')",
)
def filter_items(spark, d):
    wanted = i.table(spark, d, "part").filter("p_type = 'ECONOMY'").select("p_partkey")
    rows = i.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    return rows.join(wanted, rows.l_partkey == wanted.p_partkey, "left_semi")


@query(
    "cohort_join",
    "SELECT o_orderkey AS stay_id, o_custkey AS hadm_id, c_nationkey AS subject_id, "
    "o_orderdate AS intime, o_orderdate + INTERVAL 30 DAY AS outtime, c_mktsegment AS segment, "
    "n_name AS region FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey",
)
def cohort_join(spark, d):
    orders, customer = i.table(spark, d, "orders"), i.table(spark, d, "customer")
    stays = orders.select(
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_custkey").alias("hadm_id"),
        F.col("o_orderdate").alias("intime"),
        (F.col("o_orderdate") + F.expr("interval 30 days")).alias("outtime"),
    )
    admissions = customer.select(
        F.col("c_custkey").alias("hadm_id"),
        F.col("c_nationkey").alias("subject_id"),
        F.col("c_mktsegment").alias("segment"),
    )
    patients = i.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("subject_id"), F.col("n_name").alias("region")
    )
    joined = cohort.join_entities(stays, admissions, patients, "hadm_id", "subject_id")
    return i.finished(joined)


@query(
    "join_left_aligned",
    f"WITH {i.hourly_sql(LABS, 'labs')}, {i.hourly_sql(VITALS, 'vitals')}, {i.STAYS_SQL}, "
    "both_sides AS (SELECT user_id, hour, signup, error, view, click, purchase "
    "FROM labs FULL JOIN vitals USING (user_id, hour)) "
    "SELECT s.stay_id, s.user_id, b.hour, round(signup, 8) AS signup, round(error, 8) AS error, "
    "round(view, 8) AS view, round(click, 8) AS click, round(purchase, 8) AS purchase "
    "FROM stays s LEFT JOIN both_sides b ON s.user_id = b.user_id "
    "AND b.hour BETWEEN date_trunc('hour', s.intime) AND s.outtime",
)
def join_left_aligned(spark, d):
    both = cohort.align_tables(
        i.hourly(spark, d, LABS), i.hourly(spark, d, VITALS), ["user_id", "hour"]
    )
    rows = cohort.within_stay(
        i.stays(spark, d), both, "user_id", "stay_id", "intime", "outtime", "hour"
    )
    return i.finished(rows.select("stay_id", "user_id", "hour", *LABS, *VITALS), 8)


@query(
    "join_left_fanout",
    f"WITH {i.hourly_sql(LABS, 'labs')}, {i.hourly_sql(VITALS, 'vitals')}, {i.STAYS_SQL} "
    "SELECT s.user_id, count(*) AS n_rows FROM stays s LEFT JOIN labs l ON s.user_id = l.user_id "
    "LEFT JOIN vitals v ON s.user_id = v.user_id GROUP BY s.user_id",
)
def join_left_fanout(spark, d):
    return cohort.fanout_rows(
        i.stays(spark, d), i.hourly(spark, d, LABS), i.hourly(spark, d, VITALS), "user_id"
    )


@query(
    "join_three_key",
    f"WITH {i.hourly_sql(LABS, 'labs')}, "
    "waves AS (SELECT user_id, (day(ts) - 1) // 10 AS stay_id, date_trunc('hour', ts) AS hour, "
    "count(*) AS n_points, max(value) AS max_value FROM events "
    "WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2, 3) "
    "SELECT l.user_id, w.stay_id, l.hour, round(l.error, 8) AS error, w.n_points, w.max_value "
    f"FROM labs l JOIN waves w ON l.user_id = w.user_id AND l.hour = w.hour "
    "AND (day(l.hour) - 1) // 10 = w.stay_id",
)
def join_three_key(spark, d):
    def stay(c):
        return F.floor((F.dayofmonth(c) - 1) / 10)

    labs = i.hourly(spark, d, LABS).withColumn("stay_id", stay("hour"))
    waves = (
        i.events(spark, d)
        .filter(F.col("event_type").isin(*VITALS))
        .withColumn("window_start", buckets.hour_bucket(F.col("ts")))
        .groupBy("user_id", stay("ts").alias("stay_id"), "window_start")
        .agg(F.count(F.lit(1)).alias("n_points"), F.max("value").alias("max_value"))
        .withColumnRenamed("window_start", "hour")
    )
    rows = labs.join(waves, ["user_id", "stay_id", "hour"])
    return i.finished(
        rows.select("user_id", "stay_id", "hour", F.round("error", 8).alias("error"),
                    "n_points", "max_value")
    )


@query(
    "align_scores",
    f"WITH {i.PREDICTIONS_SQL} SELECT event_id, (value > 50)::INT AS y, p, "
    "(p > 0.5)::INT AS predicted FROM predictions",
)
def align_scores(spark, d):
    log = i.predictions(spark, d)
    batches = [log.filter(F.col("event_type") == t).select("event_id", "p") for t in i.TYPES]
    joined = batches[0]
    for batch in batches[1:]:
        joined = joined.unionByName(batch)
    targets = i.events(spark, d).select("event_id", (F.col("value") > 50).cast("int").alias("y"))
    return targets.join(joined, "event_id").select(
        "event_id", "y", "p", (F.col("p") > 0.5).cast("int").alias("predicted")
    )


@query(
    "bucket_half_hour",
    "SELECT event_id, date_trunc('hour', ts) + to_minutes(30 * (minute(ts) // 30)) "
    "AS window_start FROM events",
)
def bucket_half_hour(spark, d):
    rows = i.events(spark, d).select("event_id", buckets.bucket(F.col("ts")).alias("window_start"))
    return i.finished(rows)


@query("bucket_hour", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def bucket_hour(spark, d):
    rows = i.events(spark, d).select("event_id", buckets.hour_bucket(F.col("ts")).alias("hour"))
    return i.finished(rows)


def _profile_sql() -> str:
    out = []
    for t in i.TYPES:
        f = f"FILTER (WHERE event_type = '{t}')"
        out += [
            f"round(avg(value) {f}, 8) AS {t}_mean",
            f"round(stddev_samp(value) {f}, 8) AS {t}_std",
            f"min(value) {f} AS {t}_min",
            f"max(value) {f} AS {t}_max",
            f"nullif(count(value) {f}, 0)::DOUBLE AS {t}_count",
        ]
    return ", ".join(out)


@query(
    "pivot_multi_agg",
    "SELECT user_id, date_trunc('hour', ts) + to_minutes(30 * (minute(ts) // 30)) "
    f"AS window_start, {_profile_sql()} FROM events GROUP BY 1, 2",
)
def pivot_multi_agg(spark, d):
    rows = i.events(spark, d).withColumn("window_start", buckets.bucket(F.col("ts")))
    wide = buckets.pivot_profile(
        rows, ["user_id", "window_start"], "event_type", "value", i.TYPES
    )
    counts = {f"{t}_count": F.col(f"{t}_count").cast("double") for t in i.TYPES}
    return i.finished(wide.withColumns(counts), 8)


@query(
    "pivot_item_hour",
    f"WITH {i.hourly_sql(LABS)} SELECT user_id, hour, round(signup, 8) AS signup, "
    "round(error, 8) AS error, round(view, 8) AS view FROM hourly",
)
def pivot_item_hour(spark, d):
    return i.finished(i.hourly(spark, d, LABS), 8)


@query(
    "pivot_vital_hour",
    f"WITH {i.hourly_sql(VITALS)} SELECT user_id, hour, round(click, 8) AS click, "
    "round(purchase, 8) AS purchase FROM hourly",
)
def pivot_vital_hour(spark, d):
    return i.finished(i.hourly(spark, d, VITALS), 8)


@query(
    "severity_score",
    f"WITH {i.daily_sql()} SELECT user_id, day, {i.SCORE_SQL} AS score FROM daily",
)
def severity_score(spark, d):
    rows = i.daily(spark, d).select("user_id", "day", step_score(i.RULES).alias("score"))
    return i.finished(rows)


@query(
    "severity_score_flat",
    f"WITH {i.daily_sql()} SELECT user_id, day, (coalesce(error > 50, false)::INT "
    "+ coalesce(click < 30, false)::INT + coalesce(view > 60, false)::INT) AS score FROM daily",
)
def severity_score_flat(spark, d):
    score = step_score(i.RULES, severest_first=False)
    return i.finished(i.daily(spark, d).select("user_id", "day", score.alias("score")))


def _onsets(spark, d):
    scored = i.daily(spark, d).withColumn("score", step_score(i.RULES))
    return scored.select(
        "user_id", "day", "score",
        labels.onset_flag(F.col("score"), F.col("day"), i.ONSET).alias("onset"),
    )


ONSETS_SQL = (
    f"WITH {i.daily_sql()}, scored AS (SELECT *, {i.SCORE_SQL} AS score FROM daily), "
    f"onsets AS (SELECT user_id, day, score, CASE WHEN score >= {i.ONSET} THEN day END AS onset "
    "FROM scored), firsts AS (SELECT *, min(onset) OVER (PARTITION BY user_id) AS onset_time "
    "FROM onsets)"
)


@query(
    "first_event_running",
    f"{ONSETS_SQL} SELECT user_id, day, min(onset) OVER (PARTITION BY user_id ORDER BY day) "
    "AS onset_so_far FROM onsets",
)
def first_event_running(spark, d):
    rows = labels.running_onset(_onsets(spark, d), ["user_id"], "day", "onset")
    return i.finished(rows.select("user_id", "day", "onset_so_far"))


@query("first_event_time", f"{ONSETS_SQL} SELECT user_id, day, onset_time FROM firsts")
def first_event_time(spark, d):
    rows = labels.onset_time(_onsets(spark, d), ["user_id"], "onset")
    return i.finished(rows.select("user_id", "day", "onset_time"))


@query(
    "hours_to_event",
    f"{ONSETS_SQL} SELECT user_id, day, (epoch(onset_time) - epoch(day)) / 3600.0 "
    "AS hours_to_event FROM firsts",
)
def hours_to_event(spark, d):
    rows = labels.onset_time(_onsets(spark, d), ["user_id"], "onset")
    return i.finished(
        rows.select(
            "user_id", "day",
            hours_between(F.col("onset_time"), F.col("day")).alias("hours_to_event"),
        )
    )


LABELLED_SQL = (
    f"{ONSETS_SQL}, labelled AS (SELECT user_id, day, score, onset_time, "
    "(epoch(onset_time) - epoch(day)) / 3600.0 AS hours_to_event FROM firsts)"
)
LABEL_SQL = (
    f"CASE WHEN hours_to_event >= 0 AND hours_to_event <= {i.HORIZON} THEN 1 ELSE 0 END"
)


def labelled(spark, d):
    return labels.labelled(
        i.daily(spark, d), ["user_id"], "day", step_score(i.RULES), i.ONSET, i.HORIZON
    )


@query(
    "horizon_label",
    f"{LABELLED_SQL} SELECT user_id, day, score, onset_time, hours_to_event, "
    f"{LABEL_SQL} AS label FROM labelled",
)
def horizon_label(spark, d):
    rows = labelled(spark, d).select(
        "user_id", "day", "score", "onset_time", "hours_to_event", "label"
    )
    return i.finished(rows)


@query("label_manifest", f"{LABELLED_SQL} SELECT user_id, day, {LABEL_SQL} AS label FROM labelled")
def label_manifest(spark, d):
    folder = work_folder(spark, "labels")
    rows = i.finished(labelled(spark, d))
    tables.write_manifest(rows, folder, ["user_id", "day", "label"])
    return tables.read_table(
        spark, folder, "user_id bigint, day timestamp_ntz, label int", "csv"
    )


@query(
    "lead_time_recall",
    f"{LABELLED_SQL}, marked AS (SELECT hours_to_event, {LABEL_SQL} AS label, "
    "(score >= 2)::INT AS predicted FROM labelled), w(hours_before) AS "
    "(VALUES (12), (24), (36), (48), (60), (72)), counts AS (SELECT hours_before, "
    "count(*) FILTER (WHERE label = 1 AND hours_to_event BETWEEN 0 AND hours_before) AS n_events, "
    "count(*) FILTER (WHERE label = 1 AND hours_to_event BETWEEN 0 AND hours_before "
    "AND predicted = 1) AS n_found FROM marked CROSS JOIN w GROUP BY hours_before) "
    "SELECT hours_before, n_events, n_found, round(coalesce(n_found / nullif(n_events, 0), 0), 8) "
    "AS recall FROM counts",
)
def lead_time_recall(spark, d):
    rows = labelled(spark, d).withColumn("predicted", (F.col("score") >= 2).cast("int"))
    return i.finished(
        labels.lead_time_recall(
            rows, "hours_to_event", "label", "predicted", (12, 24, 36, 48, 60, 72)
        ),
        8,
    )


def _organ_columns(spark, d):
    """Daily values under the item numbers of the full severity map."""
    whole = F.floor
    invasive, cuff = (str(item) for item in c.MAP_ITEMS)
    pressors = dict(
        zip(c.VASOPRESSOR_ITEMS, (("purchase", 90), ("signup", 95), None, ("view", 140)))
    )
    eye, verbal, motor = (str(item) for item in c.GCS_ITEMS)
    wide = i.daily(spark, d).select(
        "user_id", "day", "error", "view",
        F.when(F.dayofmonth("day") % 2 == 0, F.col("click")).alias(invasive),
        (F.col("click") + 5).alias(cuff),
        *[
            (F.lit(None).cast("double") if rule is None
             else F.when(F.col(rule[0]) > rule[1], F.col(rule[0]))).alias(name)
            for name, rule in pressors.items()
        ],
        whole(F.col("signup") / 10).alias(str(c.GCS_TOTAL_ITEM)),
        whole(F.col("error") / 30).alias(eye),
        whole(F.col("view") / 30).alias(verbal),
        whole(F.col("click") / 30).alias(motor),
        (F.col("purchase") * 10).alias(str(c.URINE_ITEM)),
    )
    return buckets.coalesced_items(wide, {"pressure": [invasive, cuff]})


@query(
    "severity_score_full",
    f"WITH {i.daily_sql()}, organ AS (SELECT *, "
    "coalesce(purchase > 90, false) OR coalesce(signup > 95, false) OR coalesce(view > 140, false) "
    "AS pressor, coalesce(CASE WHEN day(day) % 2 = 0 THEN click END, click + 5) AS pressure, "
    "coalesce(floor(signup / 10), floor(error / 30) + floor(view / 30) "
    "+ floor(click / 30)) AS coma, purchase * 10 AS urine FROM daily) "
    "SELECT user_id, day, greatest(CASE WHEN pressure < 30 THEN 1 ELSE 0 END, "
    "CASE WHEN pressor THEN 2 ELSE 0 END) "
    "+ CASE WHEN error > 200 THEN 4 WHEN error > 120 THEN 3 WHEN error > 80 THEN 2 "
    "WHEN error > 50 THEN 1 ELSE 0 END "
    "+ CASE WHEN coma < 6 THEN 4 WHEN coma < 10 THEN 3 WHEN coma < 13 THEN 2 "
    "WHEN coma < 15 THEN 1 ELSE 0 END "
    "+ greatest(CASE WHEN view > 150 THEN 2 WHEN view > 60 THEN 1 ELSE 0 END, "
    "CASE WHEN urine < 200 THEN 4 WHEN urine < 500 THEN 3 ELSE 0 END) AS score FROM organ",
)
def severity_score_full(spark, d):
    error, _, view = i.RULES
    pressure = type(error)("pressure", "below", (30,))
    score = labels.full_severity(
        (pressure, error, view), list(c.VASOPRESSOR_ITEMS),
        [str(item) for item in c.GCS_ITEMS], str(c.GCS_TOTAL_ITEM), str(c.URINE_ITEM),
    )
    rows = _organ_columns(spark, d).select("user_id", "day", score.alias("score"))
    return i.finished(rows)


@query(
    "screening_score",
    f"WITH {i.hourly_sql()} SELECT user_id, hour, coalesce(error >= 22, false)::INT "
    "+ coalesce(view <= 100, false)::INT + coalesce(click <= 13, false)::INT AS score FROM hourly",
)
def screening_score(spark, d):
    score = labels.screening_score(F.col("error"), F.col("view"), F.col("click"))
    return i.finished(i.hourly(spark, d).select("user_id", "hour", score.alias("score")))


@query(
    "infection_flags",
    f"WITH {i.daily_sql()}, f AS (SELECT day, coalesce(signup > 0, false) AS a, "
    "coalesce(purchase > 0, false) AS b, coalesce(click / 5 < 4 OR click / 5 > 12, false) AS c, "
    "coalesce(30 + view / 10 < 36 OR 30 + view / 10 > 38, false) AS t FROM daily) "
    "SELECT day, count(*) FILTER (WHERE a) AS antibiotic_sign, count(*) FILTER (WHERE b) "
    "AS culture_sign, count(*) FILTER (WHERE c) AS wbc_sign, count(*) FILTER (WHERE t) "
    "AS temperature_sign, count(*) FILTER (WHERE (a OR b) AND (c OR t)) AS suspected "
    "FROM f GROUP BY day",
)
def infection_flags(spark, d):
    signs = labels.infection_signs(
        F.col("signup"), F.col("purchase"), F.col("click") / 5, 30 + F.col("view") / 10
    )
    rows = i.daily(spark, d).select("day", *[c.alias(n) for n, c in signs.items()])
    treated = F.col("antibiotic_sign") | F.col("culture_sign")
    ill = F.col("wbc_sign") | F.col("temperature_sign")
    return i.finished(
        rows.groupBy("day").agg(
            *[F.count_if(n).alias(n) for n in signs], F.count_if(treated & ill).alias("suspected")
        )
    )


@query(
    "row_number_per_entity",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) "
    "AS row_num FROM events",
)
def row_number_per_entity(spark, d):
    rows = i.events(spark, d).select("event_id", "user_id", "ts")
    numbered = sequences.row_numbers(rows, ["user_id"], ["ts", "event_id"])
    return numbered.select("event_id", "user_id", "row_num")


def _lags_sql(n: int) -> str:
    return ", ".join(f"lag(event_id, {k}) OVER w AS window_{k}" for k in range(n))


@query(
    "lag_matrix",
    f"SELECT * FROM (SELECT event_id, {_lags_sql(72)} FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE window_71 IS NOT NULL",
)
def lag_matrix(spark, d):
    rows = i.events(spark, d).select("event_id", "user_id", "ts")
    lags = sequences.lag_matrix(rows, ["user_id"], ["ts", "event_id"], "event_id", 72)
    return lags.filter(F.col("window_71").isNotNull()).drop("user_id", "ts")


@query(
    "sliding_sequences",
    f"WITH {i.hourly_sql()}, numbered AS (SELECT user_id, hour, error, view, "
    "row_number() OVER (PARTITION BY user_id ORDER BY hour) AS rn FROM hourly) "
    "SELECT a.user_id, a.hour, (b.rn - a.rn + 71)::INT AS pos, b.hour AS step_hour, "
    "round(b.error, 8) AS error, round(b.view, 8) AS view FROM numbered a JOIN numbered b "
    "ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 71 AND a.rn WHERE a.rn >= 72",
)
def sliding_sequences(spark, d):
    rows = sequences.sliding_sequences(
        i.hourly(spark, d), ["user_id"], ["hour"], ["error", "view"], 72, limit=None
    )
    steps = rows.select("user_id", "hour", F.posexplode("sequence").alias("pos", "s"))
    return i.finished(
        steps.select("user_id", "hour", "pos", F.col("s.hour").alias("step_hour"),
                     "s.error", "s.view"),
        8,
    )


@query(
    "history_last_n",
    "SELECT event_id, user_id, value, recency FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS recency FROM events) "
    "WHERE recency <= 100",
)
def history_last_n(spark, d):
    rows = sequences.last_rows(i.events(spark, d), ["user_id"], ["ts", "event_id"], 100)
    return rows.select("event_id", "user_id", "value", "recency")


@query(
    "fill_forward",
    f"WITH {i.hourly_sql()} SELECT user_id, hour, round(last_value(error IGNORE NULLS) OVER "
    "(PARTITION BY user_id ORDER BY hour), 8) AS error_filled FROM hourly",
)
def fill_forward(spark, d):
    rows = sequences.fill_forward(
        i.hourly(spark, d), ["user_id"], ["hour"], {"error_filled": "error"}, limit=None
    )
    return i.finished(rows.select("user_id", "hour", "error_filled"), 8)


@query(
    "fill_linear",
    f"WITH {i.hourly_sql()}, known AS (SELECT user_id, hour, error, "
    "last_value(CASE WHEN error IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS bt, "
    "last_value(error IGNORE NULLS) OVER b AS bv, "
    "first_value(CASE WHEN error IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS nt, "
    "first_value(error IGNORE NULLS) OVER a AS nv FROM hourly "
    "WINDOW b AS (PARTITION BY user_id ORDER BY hour), "
    "a AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT user_id, hour, round(coalesce(error, bv + (nv - bv) * (epoch(hour) - epoch(bt)) "
    "/ (epoch(nt) - epoch(bt))), 10) AS error_linear FROM known",
)
def fill_linear(spark, d):
    rows = sequences.fill_linear(i.hourly(spark, d), ["user_id"], "hour", ["error"], limit=None)
    return i.finished(rows.select("user_id", "hour", "error_linear"), 10)


@query(
    "fill_zero",
    f"WITH {i.hourly_sql()} SELECT user_id, hour, round(coalesce(error, 0), 8) AS error, "
    "round(coalesce(view, 0), 8) AS view FROM hourly",
)
def fill_zero(spark, d):
    rows = sequences.fill_zero(i.hourly(spark, d), ["error", "view"])
    return i.finished(rows.select("user_id", "hour", "error", "view"), 8)


@query(
    "min_points_filter",
    "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(value) AS n_points, "
    "round(avg(value), 8) AS mean_value FROM events GROUP BY 1, 2 HAVING count(value) >= 5",
)
def min_points_filter(spark, d):
    rows = i.events(spark, d).withColumn("day", buckets.day_bucket(F.col("ts")))
    return i.finished(buckets.with_min_points(rows, ["user_id", "day"], "value", 5), 8)


@query(
    "missing_ratio_filter",
    f"WITH {i.daily_sql()}, m AS (SELECT user_id, day, ((signup IS NULL)::INT "
    "+ (error IS NULL)::INT + (view IS NULL)::INT + (click IS NULL)::INT "
    "+ (purchase IS NULL)::INT) / 5.0 AS missing_ratio FROM daily) "
    "SELECT user_id, day, missing_ratio::DOUBLE AS missing_ratio FROM m "
    "WHERE missing_ratio <= 0.3",
)
def missing_ratio_filter(spark, d):
    rows = buckets.with_few_missing(i.daily(spark, d), i.TYPES, 0.3)
    return i.finished(rows.select("user_id", "day", "missing_ratio"))


@query(
    "seq_mean_vector",
    f"WITH {i.hourly_sql()}, v AS (SELECT user_id, unnest([0, 1]) AS pos, "
    "unnest([coalesce(error, 80.0), coalesce(view, 120.0)]) AS x FROM hourly) "
    "SELECT user_id, pos::INT AS pos, round(avg(x), 8) AS mean FROM v GROUP BY 1, 2",
)
def seq_mean_vector(spark, d):
    """Means over all steps of an entity; each day's steps are one sequence."""
    days = i.hourly(spark, d).groupBy("user_id", F.to_date("hour").alias("day")).agg(
        F.collect_list(F.struct("hour", "error", "view")).alias("sequence")
    )
    vectors = days.select(
        "user_id",
        sequences.impute_steps(F.col("sequence"), {"error": 80.0, "view": 120.0}).alias("v"),
    )
    return i.finished(sequences.mean_vector(vectors, ["user_id"], "v"), 8)


@query(
    "pool_last",
    f"WITH {i.hourly_sql()} SELECT user_id, round(arg_max(coalesce(error, 0), hour), 8) AS error, "
    "round(arg_max(coalesce(view, 0), hour), 8) AS view FROM hourly GROUP BY user_id",
)
def pool_last(spark, d):
    rows = sequences.fill_zero(i.hourly(spark, d), ["error", "view"])
    return i.finished(sequences.pool(rows, ["user_id"], ["hour"], ["error", "view"], "last"), 8)


@query(
    "pool_mean",
    f"WITH {i.hourly_sql()} SELECT user_id, round(avg(error), 8) AS error, "
    "round(avg(view), 8) AS view FROM hourly GROUP BY user_id",
)
def pool_mean(spark, d):
    rows = i.hourly(spark, d)
    return i.finished(sequences.pool(rows, ["user_id"], ["hour"], ["error", "view"], "mean"), 8)


@query(
    "pool_max",
    f"WITH {i.hourly_sql()} SELECT user_id, round(max(error), 8) AS error, "
    "round(max(view), 8) AS view FROM hourly GROUP BY user_id",
)
def pool_max(spark, d):
    rows = i.hourly(spark, d)
    return i.finished(sequences.pool(rows, ["user_id"], ["hour"], ["error", "view"], "max"), 8)


@query(
    "pool_softmax",
    "WITH s AS (SELECT user_id, value, value / 25 AS score, "
    "max(value / 25) OVER (PARTITION BY user_id) AS top FROM events) "
    "SELECT user_id, round(sum(exp(score - top) * value) / sum(exp(score - top)), 8) AS value "
    "FROM s GROUP BY user_id",
)
def pool_softmax(spark, d):
    rows = i.events(spark, d).withColumn("score", F.col("value") / 25)
    return i.finished(sequences.pool_softmax(rows, ["user_id"], "score", ["value"]), 8)


@query(
    "session_sequences",
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END "
    "AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT "
    "AS session FROM g) SELECT user_id, session, min(ts) AS session_start, max(ts) AS session_end, "
    "count(*) AS n, round(avg(value), 8) AS mean_value FROM s GROUP BY 1, 2",
)
def session_sequences(spark, d):
    rows = i.events(spark, d).select("event_id", "user_id", "ts", "value")
    marked = sequences.sessions(rows, ["user_id"], "ts", "event_id", 1800)
    return i.finished(
        marked.groupBy("user_id", "session").agg(
            F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
            F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"),
        ),
        8,
    )


FEATURES = ("error", "view", "purchase_mean")


@query(
    "training_data",
    f"{LABELLED_SQL}, waves AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, "
    "avg(value) AS purchase_mean FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), "
    "j AS (SELECT l.user_id, (day(l.day) - 1) // 10 AS stay_id, l.day, error, view, purchase_mean, "
    f"{LABEL_SQL} AS label FROM labelled l JOIN daily d ON l.user_id = d.user_id "
    "AND l.day = d.day JOIN waves w ON l.user_id = w.user_id AND l.day = w.day), "
    "m AS (SELECT min(error) AS e0, max(error) AS e1, min(view) AS v0, max(view) AS v1, "
    "min(purchase_mean) AS p0, max(purchase_mean) AS p1 FROM j WHERE ('0x' || substr(md5('42|' || "
    "user_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.7), n AS (SELECT user_id, stay_id, day, "
    "label, (error - e0) / (e1 - e0 + 1e-8) AS error, (view - v0) / (v1 - v0 + 1e-8) AS view, "
    "(purchase_mean - p0) / (p1 - p0 + 1e-8) AS purchase_mean, row_number() OVER "
    "(PARTITION BY user_id, stay_id ORDER BY day) AS rn FROM j CROSS JOIN m) "
    "SELECT a.user_id, a.stay_id, a.day, a.label, (b.rn - a.rn + 1)::INT AS pos, "
    "round(b.error, 8) AS error, round(b.view, 8) AS view, "
    "round(b.purchase_mean, 8) AS purchase_mean FROM n a JOIN n b ON a.user_id = b.user_id "
    "AND a.stay_id = b.stay_id AND b.rn BETWEEN a.rn - 1 AND a.rn WHERE a.rn >= 2",
)
def training_data(spark, d):
    """Labelled days with waveform features, scaled by the train split, as sequences in a table."""
    keys = ["user_id", "stay_id", "day"]

    def stay(c):
        return F.floor((F.dayofmonth(c) - 1) / 10)

    rows = labelled(spark, d).select(
        "user_id", stay("day").alias("stay_id"), "day", "error", "view", "label"
    )
    waves = buckets.pivot_profile(
        i.events(spark, d).withColumn("day", buckets.day_bucket(F.col("ts"))),
        ["user_id", "day"], "event_type", "value", ["purchase"],
    ).select("user_id", stay("day").alias("stay_id"), "day", "purchase_mean")
    joined = rows.join(waves, keys)
    train = joined.filter(splits.split_of(F.col("user_id")) == "train")
    stats = scaling.stats_table(train, FEATURES, robust=False)
    scaled = scaling.apply_scaling(joined, stats, FEATURES, "min_max").drop(*FEATURES)
    windows = sequences.sliding_sequences(
        scaled, ["user_id", "stay_id"], ["day"], [f"{f}_norm" for f in FEATURES], 2, limit=None
    )
    folder = work_folder(spark, "training")
    kept = tables.hash_bucket(windows.select(*keys, "label", "sequence"), "user_id", 8)
    tables.write_table(kept, folder, partition_by=["bucket"])
    steps = spark.read.schema(kept.schema).parquet(folder).select(
        *keys, "label", F.posexplode("sequence").alias("pos", "s")
    )
    return i.finished(
        steps.select(*keys, "label", "pos", *[F.col(f"s.{f}_norm").alias(f) for f in FEATURES]), 8
    )


@query(
    "first_event_time_null_key",
    "SELECT event_id, min(ts) OVER (PARTITION BY nullif(event_type, 'view'), nullif(user_id % 7, 3)) "
    "AS first_time FROM events",
)
def first_event_time_null_key(spark, d):
    """Both keys have null groups, which are groups like any other."""
    rows = i.events(spark, d).select(
        "event_id", "ts", F.nullif("event_type", F.lit("view")).alias("kind"),
        F.nullif(F.col("user_id") % 7, F.lit(3)).alias("part"),
    )
    found = labels.onset_time(rows, ["kind", "part"], "ts", "first_time")
    return i.finished(found.select("event_id", "first_time"))


@query(
    "running_totals_nullable",
    "SELECT event_id, CAST(sum(CASE WHEN value <= 20 THEN CAST(floor(value) AS BIGINT) END) OVER "
    "(PARTITION BY nullif(event_type, 'view') ORDER BY ts, event_id) AS DOUBLE) AS total, "
    "row_number() OVER (PARTITION BY nullif(event_type, 'view') ORDER BY ts, event_id) AS place "
    "FROM events",
)
def running_totals_nullable(spark, d):
    """A running sum over mostly missing values, with a null group."""
    rows = i.events(spark, d).select(
        "event_id", "ts", F.nullif("event_type", F.lit("view")).alias("kind"),
        F.when(F.col("value") <= 20, F.floor("value")).alias("total"),
        F.lit(1).cast("long").alias("place"),
    )
    found = running_sums(rows, ["kind"], ["ts", "event_id"], ["total", "place"])
    return found.select("event_id", F.col("total").cast("double").alias("total"), "place")
