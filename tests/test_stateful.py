"""State with timers, late rows and the record log: over several batches and after restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.session import Folder, work_folder
from tidewatch.sources import record_log
from tidewatch.streaming import stateful as sf
from tidewatch.streaming import streams as st

HOUR = 3_600_000_000
SCHEMA = "entity long, ts timestamp, id long, value double, flag string, client string"


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Every task of a batch starts a Python worker with its own state."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def send(spark, folder, rows):
    """One more file: (entity, hours, id, value, flag or client)."""
    frame = spark.createDataFrame(
        [(e, float(h), i, float(v), f) for e, h, i, v, f in rows],
        "entity long, hours double, id long, value double, flag string",
    )
    at = F.timestamp_micros((F.col("hours") * HOUR).cast("long") + 1_700_000_000_000_000)
    frame.select("entity", at.alias("ts"), "id", "value", "flag", F.col("flag").alias("client")).coalesce(
        1
    ).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, build):
    """Go on with the query over what was sent so far; all rows it has given."""
    stream = st.file_stream(spark, f"{folder}/in", SCHEMA, files_per_trigger=1)
    rows = build(stream)
    st.finish(sf.stateful(lambda: st.append_to_table(rows, folder), spark))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows").collect()


def hours(us):
    return (us - 1_700_000_000_000_000) / HOUR


def test_sequences_over_batches_and_restarts(spark):
    folder = work_folder(spark, "sequences")
    batches = [
        [(1, 0, 1, 1, None), (2, 0, 2, 5, "start"), (3, 0, 3, 1, None)],
        # rows of 1 arrive in the wrong order; 2 ends by its flag
        [(1, 2, 5, 3, None), (1, 1, 4, 2, None), (2, 1, 6, 7, "end")],
        # a start closes the open sequence of 3
        [(3, 2, 7, 9, "start"), (9, 4, 8, 0, None)],
        [(1, 9, 9, 4, None), (9, 9, 10, 0, None)],  # 1 was idle from 2 to 9
        [(9, 9.5, 11, 0, None), (3, 9.6, 12, 1, None)],
    ]

    def build(stream):
        return sf.ended_sequences(stream, "entity", "ts", "id", "value", F.col("flag"), 5 * 3600, "3 hours")

    for k, batch in enumerate(batches):
        send(spark, folder, batch)
        if k in (1, 3, 4):  # the query is started three times
            rows = run(spark, folder, build)
    got = {
        (r.entity, hours(r.started_at), hours(r.last_at), r.n, r.carried, r.ended_by) for r in rows
    }
    # the watermark ends at 6.6: sequence 1 is over only at 7, that of 9 is open
    assert got == {
        (2, 0.0, 1.0, 2, 9.5, "end"), (3, 0.0, 0.0, 1, 1.0, "start"),
    } and len(rows) == 2
    send(spark, folder, [(9, 40, 13, 0, None)])
    rows = run(spark, folder, build)
    got = {(r.entity, hours(r.started_at), hours(r.last_at), r.n, r.carried, r.ended_by) for r in rows}
    assert {(1, 0.0, 2.0, 3, 4.25, "idle"), (1, 9.0, 9.0, 1, 4.0, "idle")} <= got
    assert {(9, 4.0, 4.0, 1, 0.0, "idle"), (9, 9.0, 9.5, 2, 0.0, "idle")} <= got
    assert not any(e == 9 and last == 40.0 for e, _, last, *_ in got)


def buffers_by_hand(rows, size, age):
    out, held = [], []
    for at, i in sorted(rows):
        if held and at - held[0][0] >= age:
            out.append(("age", [x for _, x in held]))
            held = []
        held.append((at, i))
        if len(held) == size:
            out.append(("size", [x for _, x in held]))
            held = []
    return out, held


def test_buffers_lose_and_repeat_nothing(spark):
    folder = work_folder(spark, "buffers")
    rnd = random.Random(5)
    sent = []
    for k in range(5):
        # bursts and pauses, each batch a little out of order
        times = [10 * k + rnd.choice([0, 0.1, 0.2, 4, 8]) + rnd.random() / 10 for _ in range(30)]
        batch = [(0, t, 100 * k + j, 1, None) for j, t in enumerate(times)]
        send(spark, folder, batch)
        sent += [(round(t * HOUR), i) for _, t, i, _, _ in batch]
        if k in (2, 4):
            rows = run(
                spark, folder,
                lambda s: sf.flushed_buffers(s, 1, "ts", "id", "value", 7, 3600, "1 hour"),
            )
    got = {}
    for r in rows:
        got.setdefault((r.first_at, r.cause), []).append(r.id)
    flushed, held = buffers_by_hand(sent, 7, HOUR)
    want = sorted((c, sorted(ids)) for c, ids in flushed)
    have = sorted((c, sorted(ids)) for (_, c), ids in got.items())
    assert {c for c, _ in have} == {"age", "size"}
    assert len({r.id for r in rows}) == len(rows)
    # what the watermark has not passed yet is still held
    assert all(h in want for h in have) and len(want) - len(have) <= 3


def test_buffers_by_arrival(spark):
    folder = work_folder(spark, "arrivals")
    send(spark, folder, [(0, k, k, 1, None) for k in range(10)])
    stream = st.file_stream(spark, f"{folder}/in", SCHEMA)
    rows = sf.flushed_buffers(stream, 1, "ts", "id", "value", 4, 1.0, arrival=True)
    seen = []
    query = sf.stateful(
        lambda: st.batches_to(rows, folder, lambda b, e: seen.extend(b.collect()), "update", "1 second"), spark
    )
    try:
        for _ in range(60):
            if len(seen) == 10:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert sorted(r.id for r in seen) == list(range(10))
    assert sorted(r.cause for r in seen) == ["age"] * 2 + ["size"] * 8


@pytest.mark.parametrize("salts", [1, 3])
def test_deliveries_follow_the_controls(spark, salts):
    folder = work_folder(spark, "deliveries")
    controls = [(1, 1, 0, 1, "a"), (1, 3, 0, 0, "a"), (1, 2, 0, 1, "b"), (2, 0, 0, 1, "a"), (1, 5, 0, 0, "b"),
                (1, 5, 0, 1, "b")]
    records = [(1, h, 10 + k, 9, None) for k, h in enumerate([0.5, 1, 2.5, 3, 4, 5, 6])] + [(2, 1, 20, 9, None)]
    # the stream brings them mixed and late
    send(spark, folder, controls[:2] + records[4:])
    send(spark, folder, controls[2:] + records[:4] + [(7, 30, 99, 9, None)])

    def build(stream):
        told = stream.where("client IS NOT NULL").select(
            F.col("ts").alias("seen_at"), "entity", "client", (F.col("value") == 1).alias("subscribe")
        )
        rows = stream.where("client IS NULL").select(F.col("ts").alias("seen_at"), "entity", "id", "value")
        return sf.delivered(told, rows, "10 hours", salts)

    got = sorted((r.client, r.entity, r.id) for r in run(spark, folder, build))
    assert got == [
        ("a", 1, 11), ("a", 1, 12), ("a", 2, 20),
        ("b", 1, 12), ("b", 1, 13), ("b", 1, 14), ("b", 1, 15), ("b", 1, 16),
    ]


def test_late_rows_go_aside_and_a_repeated_batch_is_split_alike(spark):
    folder = work_folder(spark, "late-rows")
    out = {"on_time": {}, "late": {}}
    sinks = [
        lambda b, e, n=n: out[n].__setitem__(e, sorted(r.id for r in b.collect()))
        for n in ("on_time", "late")
    ]
    write = st.late_and_on_time(folder, "ts", 3600, *sinks)

    def batch(*rows):
        frame = spark.createDataFrame(rows, "id long, hours double")
        at = F.timestamp_micros((F.col("hours") * HOUR).cast("long"))
        return frame.select("id", at.alias("ts"))

    write(batch((1, 10.0), (2, 1.0)), 0)  # nothing is late in the first batch
    for _ in range(2):
        write(batch((3, 9.5), (4, 8.9), (5, 20.0), (6, None)), 1)
    write(batch((7, 18.0)), 2)
    write(batch(), 3)
    assert out["on_time"] == {0: [1, 2], 1: [3, 5], 2: [], 3: []}
    assert out["late"] == {0: [], 1: [4, 6], 2: [7], 3: []}
    assert st.counted(folder, spark) == (7, 3)


def test_listener_counts_dropped_and_observed_rows(spark):
    folder = work_folder(spark, "listened")
    send(spark, folder, [(1, 10, 1, 1, None)])
    listener = st.DropCounts()
    spark.streams.addListener(listener)
    try:
        for extra in ([], [(1, 1, 2, 1, None)]):
            if extra:
                send(spark, folder, extra)
            rows = st.file_stream(spark, f"{folder}/in", SCHEMA, files_per_trigger=1).observe(
                "seen", F.count(F.lit(1)).alias("n")
            )
            totals = st.sliding_totals(rows, "ts", "value")
            query = st.finish(st.batches_to(totals, folder, st.appended(folder, "t"), "update"))
        for _ in range(50):
            if listener.dropped.get(str(query.id)):
                break
            spark.range(1).count()
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped[str(query.id)] == 2  # the row belongs to two windows
    assert sum(r["n"] for _, r in listener.observed[str(query.id)]) == 2


def test_record_log(spark):
    folder = work_folder(spark, "log")
    log = f"{folder}/log"
    for k, n in enumerate((50, 0, 30)):
        rows = spark.range(100 * k, 100 * k + n).selectExpr("id AS key", "concat('r', id) AS value")
        assert record_log.append_records(rows, log, "key", "value", 3) == k
    records = spark.read.schema(record_log.RECORDS).parquet(f"{log}/records").collect()
    for p in range(3):
        mine = sorted(r.offset for r in records if r.log_partition == p)
        assert mine == list(range(len(mine))) and mine
    reader = record_log.LogReader(log)
    end = reader.latestOffset()
    assert sum(end.values()) == 80

    def read(start, end):
        return [v for span in reader.partitions(start, end) for b in reader.read(span) for v in b["value"].to_pylist()]

    everything = read({}, end)
    assert sorted(everything) == sorted(r.value for r in records) and read({}, end) == everything
    middle = {k: v // 2 for k, v in end.items()}
    assert sorted(read({}, middle) + read(middle, end)) == sorted(everything)


def test_record_log_goes_on_from_its_offsets(spark):
    folder = work_folder(spark, "log-restart")
    for k in range(3):
        rows = spark.range(40 * k, 40 * k + 40).selectExpr("id AS key", "string(id) AS value")
        record_log.append_records(rows, f"{folder}/log", "key", "value", 2)
        if k == 1:  # a segment that was not finished is not there
            Folder(spark, f"{folder}/log").remove("ends/segment=1")
            record_log.append_records(rows, f"{folder}/log", "key", "value", 2)
        stream = record_log.log_stream(spark, f"{folder}/log").select("value")
        st.finish(st.append_to_table(stream, folder))
        got = spark.read.schema("value string").parquet(f"{folder}/rows").collect()
        assert sorted(int(r.value) for r in got) == list(range(40 * k + 40))
