"""Streaming queries over the events; each runs to the end of the input and is read back."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tidewatch.functions import catalog as c
from tidewatch.functions.expressions import risk_tier
from tidewatch.operators import monitor, quality
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import query
from tidewatch.session import Folder, work_folder
from tidewatch.sources import record_log
from tidewatch.streaming import stateful as sf
from tidewatch.streaming import streams as st


BATCHES = 4


def event_stream(spark, d, part=None):
    """The events as a stream of one batch per part of the month, in order, each of several files.

    One job writes all files: the part and a salt name the task that writes a row. The files
    then get times in the order of their names, which is the order in which the source takes them.
    """
    rows = i.events(spark, d)
    if part is None:
        part = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(BATCHES - 1))
    for files in (max(2, spark.sparkContext.defaultParallelism // BATCHES), 1):
        folder = work_folder(spark, "event-files")
        salt = F.pmod(F.xxhash64("event_id"), F.lit(files))
        dealt = rows.repartitionById(BATCHES * files, (part * files + salt).cast("int"))
        dealt.write.parquet(folder)
        written = Folder(spark, folder)
        # part-<task>-...; few rows may leave a salt without a file, then parts get one file each
        tasks = {n: int(n.split("-")[1]) for n in written.names() if n.startswith("part-")}
        if set(Counter(task // files for task in tasks.values()).values()) <= {files}:
            break
    for name, task in tasks.items():
        written.set_time(name, 1_000_000_000_000 + 1000 * task)
    return st.file_stream(spark, folder, rows.schema, files_per_trigger=files)


def kept(spark, stream, folder, name, keys, order=(), mode="append"):
    """Run a stream to its end into a keyed table and read it."""
    table = st.KeyedTable(f"{folder}/{name}", stream.schema, keys, order)
    st.finish(st.batches_to(stream, folder, table.write, mode))
    return table.read(spark)


def risk_stream(spark, d):
    return event_stream(spark, d).select(
        "event_id", "user_id", "ts", F.least(F.col("value") / 100, F.lit(1.0)).alias("p")
    )


RECORD = "event_id bigint, user_id bigint, value double, k int"


def _sent_records(spark, d):
    """The events as JSON texts, some of them broken."""
    tag = F.get_json_object("props", "$.k").cast("int")
    text = F.to_json(F.struct("event_id", "user_id", "value", tag.alias("k")))
    return event_stream(spark, d).select(
        F.col("event_id").alias("sent_id"),
        F.when(tag == 13, F.lit("{broken")).otherwise(text).alias("record"),
    )


@query(
    "stream_score",
    "WITH r AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k "
    "FROM events), v AS (SELECT event_id, value, k <> 13 AND value BETWEEN 0.5 AND 150 AS valid "
    "FROM r) SELECT event_id AS sent_id, valid, CASE WHEN valid THEN least(value / 100, 1.0) "
    "ELSE 0.1 END AS p FROM v",
)
def stream_score(spark, d):
    folder = work_folder(spark, "stream-score")
    parsed = st.parse_records(_sent_records(spark, d), "record", RECORD)
    valid = ~F.col("_bad") & quality.in_range(F.col("value"), 0.5, 150, required=True)
    scored = st.scored(
        parsed, F.least(F.col("value") / 100, F.lit(1.0)), valid, c.FALLBACK_SCORE
    ).select("sent_id", "valid", "p")
    st.finish(st.append_to_table(scored, folder))
    return spark.read.schema(scored.schema).parquet(f"{folder}/rows")


@query(
    "stream_latest",
    "SELECT user_id, event_id, ts, least(value / 100, 1.0) AS p FROM events QUALIFY row_number() "
    "OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_latest(spark, d):
    folder = work_folder(spark, "stream-latest")
    latest = st.latest_stream(risk_stream(spark, d), "user_id", ["ts", "event_id"])
    return i.finished(kept(spark, latest, folder, "latest", ["user_id"], mode="update"))


@query(
    "stream_history",
    "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, "
    "event_id DESC) AS rn, least(count(*) OVER (PARTITION BY user_id), 100) AS n FROM events) "
    "SELECT user_id AS entity, (n - rn)::INT AS pos, value FROM r WHERE rn <= 100",
)
def stream_history(spark, d):
    folder = work_folder(spark, "stream-history")
    points = st.history_stream(event_stream(spark, d), "user_id", "ts", "value", "event_id", 100)
    rows = kept(spark, points, folder, "history", ["entity"], mode="update")
    return rows.select("entity", F.posexplode("values").alias("pos", "value"))


@query(
    "stream_alerts",
    f"WITH {i.PREDICTIONS_SQL}, t AS (SELECT event_id, user_id, p, {i.TIER_SQL} AS tier "
    "FROM predictions) SELECT *, 2 AS n_sinks FROM t WHERE tier IN ('high', 'critical')",
)
def stream_alerts(spark, d):
    folder = work_folder(spark, "stream-alerts")
    alerts = monitor.alerts(risk_stream(spark, d), "p").select("event_id", "user_id", "p", "tier")
    sinks = st.fan_out(st.appended(folder, "alerts"), st.appended(folder, "dashboard"))
    st.finish(st.batches_to(alerts, folder, sinks))
    names = alerts.columns
    both = [spark.read.parquet(f"{folder}/{sink}").select(*names) for sink in ("alerts", "dashboard")]
    return both[0].unionAll(both[1]).groupBy(*names).agg(F.count(F.lit(1)).cast("int").alias("n_sinks"))


@query(
    "stream_summary",
    "WITH latest AS (SELECT user_id, least(value / 100, 1.0) AS p FROM events QUALIFY "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), "
    "now AS (SELECT max(ts) AS ts FROM events) SELECT count(*) AS total_entities, "
    "count(*) FILTER (WHERE p >= 0.5) AS high_risk_entities, round(avg(p), 8) AS average_risk, "
    "(SELECT count(*) FROM events, now WHERE value / 100 >= 0.5 "
    "AND events.ts > now.ts - INTERVAL 1 HOUR) AS active_alerts FROM latest",
)
def stream_summary(spark, d):
    folder = work_folder(spark, "stream-summary")
    risks = risk_stream(spark, d)

    def write_alerts(batch, epoch):
        st.appended(folder, "alerts")(monitor.alerts(batch, "p"), epoch)

    table = st.KeyedTable(f"{folder}/state", risks.schema, ["user_id"], ["ts", "event_id"])
    st.finish(st.batches_to(risks, folder, st.fan_out(table.write, write_alerts)))
    state = table.read(spark)
    alerts = spark.read.parquet(f"{folder}/alerts")
    rows = monitor.risk_summary(state, "p", alerts, "ts", state.agg(F.max("ts")).scalar())
    return i.finished(rows, 8)


@query(
    "stream_subscription",
    "SELECT event_id, user_id, least(value / 100, 1.0) AS p FROM events WHERE user_id IN "
    "(SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
def stream_subscription(spark, d):
    folder = work_folder(spark, "stream-subscription")

    def wanted(session):
        customers = session.read.parquet(f"{d}/customer.parquet").filter("c_acctbal > 5000")
        return customers.select(F.col("c_custkey").alias("user_id"))

    rows = risk_stream(spark, d).select("event_id", "user_id", "p")
    sink = st.subscribed_sink(wanted, "user_id", st.appended(folder, "rows"))
    st.finish(st.batches_to(rows, folder, sink))
    return spark.read.parquet(f"{folder}/rows").drop("epoch")


@query(
    "stream_dead_letters",
    "WITH r AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k "
    "FROM events) SELECT event_id AS sent_id, CASE WHEN k = 13 THEN 'parsed' WHEN value BETWEEN "
    "0.5 AND 150 THEN '' ELSE 'value' END AS broken, CASE WHEN k <> 13 AND value BETWEEN 0.5 AND 150 "
    "THEN 'good' ELSE 'dead_letter' END AS sink FROM r",
)
def stream_dead_letters(spark, d):
    """Records that keep all rules and the others, each from the sink it was sent to."""
    folder = work_folder(spark, "stream-dead-letters")
    parsed = st.parse_records(_sent_records(spark, d), "record", RECORD)
    rules = {"value": quality.in_range(F.col("value"), 0.5, 150, required=True)}
    broken = F.when(F.col("_bad"), F.array(F.lit("parsed"))).otherwise(quality.broken_rules(rules))
    rows = parsed.select("sent_id", broken.alias("violations"))
    sinks = [st.appended(folder, name) for name in ("good", "dead_letter")]
    st.finish(st.batches_to(rows, folder, st.routed_sink("violations", *sinks)))
    good, dead = (
        spark.read.parquet(f"{folder}/{name}").select(
            "sent_id", F.array_join("violations", ",").alias("broken"), F.lit(name).alias("sink")
        )
        for name in ("good", "dead_letter")
    )
    return good.unionAll(dead)


@query(
    "stream_sessions",
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END "
    "AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session "
    "FROM g), t AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE "
    "AS session_end, count(*) AS n, round(avg(value), 8) AS mean_value FROM s "
    "GROUP BY user_id, session) SELECT * FROM t WHERE session_end <= "
    "date_trunc('millisecond', (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)",
)
def stream_sessions(spark, d):
    folder = work_folder(spark, "stream-sessions")
    rows = st.session_totals(event_stream(spark, d), "user_id", "ts", "value")
    st.finish(st.append_to_table(rows, folder))
    return i.finished(spark.read.schema(rows.schema).parquet(f"{folder}/rows"), 8)


@query(
    "sliding_window_agg",
    "WITH s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS window_start, "
    "value FROM events CROSS JOIN (VALUES (0), (1)) AS v(k)) SELECT window_start, "
    "window_start + INTERVAL 30 MINUTE AS window_end, count(*) AS n, "
    "round(avg(value), 8) AS mean_value FROM s GROUP BY window_start",
)
def sliding_window_agg(spark, d):
    folder = work_folder(spark, "stream-windows")
    rows = st.sliding_totals(event_stream(spark, d), "ts", "value")
    return i.finished(kept(spark, rows, folder, "windows", ["window_start"], mode="update"), 8)


@query(
    "stream_tiers",
    f"WITH {i.PREDICTIONS_SQL}, t AS (SELECT {i.TIER_SQL} AS tier FROM predictions) "
    "SELECT tier, count(*) AS n FROM t GROUP BY tier",
)
def stream_tiers(spark, d):
    folder = work_folder(spark, "stream-tiers")
    counts = (
        risk_stream(spark, d).groupBy(risk_tier(F.col("p")).alias("tier")).count()
        .withColumnRenamed("count", "n")
    )
    return kept(spark, counts, folder, "tiers", ["tier"], mode="update")


DELAY = "epoch_ms(max(ts)) - 600000"
TAG = "CAST(json_extract_string(props, '$.k') AS INT)"
IDLE_HOURS = 6


def _tag():
    return F.get_json_object("props", "$.k").cast("int")


def _ran(spark, rows, folder):
    """Run a query with state in the RocksDB store to its end, a state partition per core; its rows."""
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(shuffles, spark.sparkContext.defaultParallelism)
    st.finish(sf.stateful(lambda: st.append_to_table(rows, folder), spark, tasks))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query(
    "stream_ended_sequences",
    f"WITH w AS (SELECT {DELAY} AS wm FROM events), r AS (SELECT user_id, event_id, epoch_us(ts) AS us, "
    f"value, CASE WHEN {TAG} < 3 THEN 'start' WHEN {TAG} >= 97 THEN 'end' ELSE '' END AS flag "
    "FROM events, w WHERE epoch_ms(ts) < wm), "
    "p AS (SELECT *, lag(us) OVER o AS prev_at, lag(flag) OVER o AS prev_flag FROM r "
    "WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)), "
    "s AS (SELECT *, sum(CASE WHEN prev_at IS NULL OR us - prev_at >= 3600000000 * "
    f"{IDLE_HOURS} OR flag = 'start' OR prev_flag = 'end' THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY user_id ORDER BY us, event_id) AS seq FROM p), "
    "g AS (SELECT user_id, seq, min(us) AS started_at, max(us) AS last_at, count(*) AS n, "
    "list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY us, event_id)), "
    "lambda a, x: a / 2 + x) AS carried, arg_max(flag, (us, event_id)) AS last_flag FROM s "
    "GROUP BY 1, 2), n AS (SELECT *, lead(started_at) OVER (PARTITION BY user_id ORDER BY seq) "
    "AS next_at FROM g), e AS (SELECT user_id AS entity, started_at, last_at, n, round(carried, 6) "
    "AS carried, CASE WHEN last_flag = 'end' THEN 'end' WHEN next_at - last_at >= 3600000000 * "
    f"{IDLE_HOURS} THEN 'idle' WHEN next_at IS NOT NULL THEN 'start' WHEN (last_at + 3600000000 * "
    f"{IDLE_HOURS}) // 1000 < wm THEN 'idle' END AS ended_by FROM n, w) "
    "SELECT * FROM e WHERE ended_by IS NOT NULL",
)
def stream_ended_sequences(spark, d):
    """Sequences that a flag, a new start or six idle hours ended; those still open are left out."""
    folder = work_folder(spark, "stream-sequences")
    flag = F.when(_tag() < 3, sf.START).when(_tag() >= 97, sf.END)
    rows = sf.ended_sequences(
        event_stream(spark, d), "user_id", "ts", "event_id", "value", flag, IDLE_HOURS * 3600
    )
    return i.finished(_ran(spark, rows, folder), 6)


SHARDS, BUFFER, BUFFER_HOURS = 4, 20, 6


@query(
    "stream_buffers",
    f"WITH RECURSIVE w AS (SELECT {DELAY} AS wm FROM events), r AS (SELECT event_id % {SHARDS} AS shard, "
    "event_id, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY event_id % "
    f"{SHARDS} ORDER BY epoch_us(ts), event_id) AS k FROM events, w WHERE epoch_ms(ts) < wm), "
    "e AS (SELECT *, max(k) OVER (PARTITION BY shard ORDER BY us RANGE BETWEEN CURRENT ROW AND "
    f"{3_600_000_000 * BUFFER_HOURS - 1} FOLLOWING) AS fresh FROM r), "
    f"f AS (SELECT shard, k, us, least(k + {BUFFER - 1}, fresh) AS last FROM e), "
    "b AS (SELECT shard, k, us, last FROM f WHERE k = 1 UNION ALL SELECT f.shard, f.k, f.us, f.last "
    "FROM b JOIN f ON f.shard = b.shard AND f.k = b.last + 1), "
    "c AS (SELECT b.*, (SELECT max(k) FROM r WHERE r.shard = b.shard) AS top FROM b), "
    f"d AS (SELECT shard, k, us AS first_at, last, CASE WHEN last = k + {BUFFER - 1} THEN 'size' "
    f"WHEN last < top OR (us + {3_600_000_000 * BUFFER_HOURS}) // 1000 < wm THEN 'age' END AS cause "
    "FROM c, w) SELECT d.shard, first_at, cause, count(*) AS n, min(event_id) AS low_id, "
    "max(event_id) AS high_id, round(sum(value), 6) AS total FROM d JOIN r ON r.shard = d.shard "
    "AND r.k BETWEEN d.k AND d.last WHERE cause IS NOT NULL GROUP BY 1, 2, 3",
)
def stream_buffers(spark, d):
    """Buffers of 20 records, flushed when full or when the first is six hours old."""
    folder = work_folder(spark, "stream-buffers")
    rows = sf.flushed_buffers(
        event_stream(spark, d), SHARDS, "ts", "event_id", "value", BUFFER, BUFFER_HOURS * 3600
    )
    flushes = _ran(spark, rows, folder).groupBy("shard", "first_at", "cause").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("low_id"), F.max("id").alias("high_id"),
        F.sum("value").alias("total"),
    )
    return i.finished(flushes, 6)


@query(
    "stream_delivered",
    f"WITH w AS (SELECT {DELAY} AS wm FROM events), e AS (SELECT *, epoch_us(ts) AS us, "
    f"'c' || ({TAG} % 3) AS client FROM events, w WHERE epoch_ms(ts) < wm), "
    "c AS (SELECT user_id, client, us, bool_or(event_type = 'signup') AS active FROM e "
    "WHERE event_type IN ('signup', 'error') GROUP BY 1, 2, 3), "
    "s AS (SELECT *, lead(us) OVER (PARTITION BY user_id, client ORDER BY us) AS until FROM c) "
    "SELECT s.client, s.user_id AS entity, e.event_id AS id, e.value FROM s JOIN e "
    "ON e.user_id = s.user_id AND e.us >= s.us AND (s.until IS NULL OR e.us < s.until) "
    "WHERE s.active AND e.event_type NOT IN ('signup', 'error')",
)
def stream_delivered(spark, d):
    """Records to the clients subscribed at their time; signups subscribe and errors unsubscribe."""
    folder = work_folder(spark, "stream-delivered")
    stream = event_stream(spark, d).withColumnsRenamed({"ts": "seen_at", "user_id": "entity"})
    told = F.col("event_type").isin("signup", "error")
    client = F.concat(F.lit("c"), (_tag() % 3).cast("string"))
    controls = stream.where(told).select(
        "seen_at", "entity", client.alias("client"), (F.col("event_type") == "signup").alias("subscribe")
    )
    records = stream.where(~told).withColumnRenamed("event_id", "id")
    return _ran(spark, sf.delivered(controls, records, salts=2), folder)


PART_SQL = (
    "least(least((day(ts) - 1) // 8, 3) + CASE WHEN " + TAG + " = 7 THEN 1 ELSE 0 END, 3)"
)


@query(
    "stream_late_rows",
    f"WITH p AS (SELECT event_id, ts, {PART_SQL} AS part FROM events), m AS (SELECT part, max(ts) AS top "
    "FROM p GROUP BY part), b AS (SELECT p.event_id, p.ts, (SELECT max(top) FROM m "
    "WHERE m.part < p.part) AS before FROM p), s AS (SELECT event_id, coalesce(ts < before - "
    "INTERVAL 10 MINUTE, false) AS late FROM b) SELECT event_id, late, (SELECT count(*) FROM s "
    "WHERE late) AS n_late FROM s",
)
def stream_late_rows(spark, d):
    """Events, some sent a part too late, in the sink for late rows or the one for the others."""
    folder = work_folder(spark, "stream-late")
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(BATCHES - 1))
    held_back = F.when(_tag() == 7, 1).otherwise(0)
    stream = event_stream(spark, d, F.least(part + held_back, F.lit(BATCHES - 1)))
    sinks = [st.appended(folder, name) for name in ("on_time", "late")]
    st.finish(st.batches_to(stream, folder, st.late_and_on_time(folder, "ts", 600, *sinks)))
    both = [
        spark.read.parquet(f"{folder}/{name}").select("event_id", F.lit(name == "late").alias("late"))
        for name in ("on_time", "late")
    ]
    n_late = st.counted(folder, spark)[1]
    return both[0].unionAll(both[1]).withColumn("n_late", F.lit(n_late).cast("long"))


@query(
    "stream_record_log",
    "WITH r AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k "
    "FROM events) SELECT event_id AS sent_id, k <> 13 AND value BETWEEN 0.5 AND 150 AS valid, "
    "CASE WHEN k <> 13 AND value BETWEEN 0.5 AND 150 THEN least(value / 100, 1.0) ELSE 0.1 END AS p "
    "FROM r",
)
def stream_record_log(spark, d):
    """The requests from a log with offsets; the stream stops and goes on where it was."""
    folder = work_folder(spark, "stream-record-log")
    rows = i.events(spark, d)
    text = F.to_json(F.struct("event_id", "user_id", "value", _tag().alias("k")))
    sent = rows.select(
        F.col("event_id").alias("key"),
        F.concat(F.col("event_id").cast("string"), F.lit(" "),
                 F.when(_tag() == 13, F.lit("{broken")).otherwise(text)).alias("value"),
    )
    second = F.col("key") % 2 == 1
    for half in (sent.where(~second), sent.where(second)):
        record_log.append_records(half, f"{folder}/log", "key", "value", 3)
        stream = record_log.log_stream(spark, f"{folder}/log")
        cut = F.split("value", " ", 2)
        parsed = st.parse_records(
            stream.select(cut[0].cast("long").alias("sent_id"), cut[1].alias("record")), "record", RECORD
        )
        valid = ~F.col("_bad") & quality.in_range(F.col("value"), 0.5, 150, required=True)
        scored = st.scored(
            parsed, F.least(F.col("value") / 100, F.lit(1.0)), valid, c.FALLBACK_SCORE
        ).select("sent_id", "valid", "p")
        st.finish(st.append_to_table(scored, folder))
    return spark.read.schema(scored.schema).parquet(f"{folder}/rows")
