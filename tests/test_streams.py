"""Streams over several files give what batch operators give on the same rows."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import monitor, sequences
from tidewatch.plans import inputs
from tidewatch.session import Folder, work_folder
from tidewatch.streaming import streams as st

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def split_events(spark, sf_dir):
    folder = work_folder(spark, "split-events")
    rows = inputs.events(spark, sf_dir)
    rows.repartitionByRange(4, "ts").write.parquet(folder)
    return folder, spark.read.schema(SCHEMA).parquet(folder)


def stream(spark, folder):
    return st.file_stream(spark, folder, SCHEMA, files_per_trigger=1)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_latest(spark, split_events):
    folder, rows = split_events
    out = work_folder(spark, "latest")
    latest = st.latest_stream(
        stream(spark, folder).select("user_id", "event_id", "ts", "value"),
        "user_id", ["ts", "event_id"],
    )
    table = st.KeyedTable(f"{out}/t", latest.schema, ["user_id"])
    done = st.finish(st.batches_to(latest, out, table.write, "update"))
    assert done.lastProgress["batchId"] >= 3
    got = table.read(spark)
    want = monitor.latest_per_entity(rows, "user_id", ["ts", "event_id"])
    assert rows_of(got, "user_id", "event_id") == rows_of(want, "user_id", "event_id")


def test_history_over_batches(spark, split_events):
    folder, rows = split_events
    out = work_folder(spark, "history")
    kept = st.history_stream(stream(spark, folder), "user_id", "ts", "value", "event_id", 5)
    table = st.KeyedTable(f"{out}/t", kept.schema, ["entity"])
    st.finish(st.batches_to(kept, out, table.write, "update"))
    got = table.read(spark).select("entity", F.explode("values").alias("value"))
    want = sequences.last_rows(rows, ["user_id"], ["ts", "event_id"], 5)
    assert rows_of(got, "entity", "value") == rows_of(want, "user_id", "value")


def test_state_table_over_batches(spark, split_events):
    folder, rows = split_events
    out = work_folder(spark, "state")
    slim = ["user_id", "event_id", "ts", "value"]
    frame = stream(spark, folder).select(*slim)
    table = st.KeyedTable(f"{out}/t", frame.schema, ["user_id"], ["ts", "event_id"], fan=2)
    st.finish(st.batches_to(frame, out, table.write))
    got = table.read(spark)
    # fewer runs than batches are left to merge
    assert len(table.runs(spark)) < 4
    want = monitor.latest_per_entity(rows.select(*slim), "user_id", ["ts", "event_id"])
    assert rows_of(got, *slim) == rows_of(want, *slim)


def test_sliding_windows_over_batches(spark, split_events):
    folder, rows = split_events
    out = work_folder(spark, "windows")
    totals = st.sliding_totals(stream(spark, folder), "ts", "value", late="60 days")
    table = st.KeyedTable(f"{out}/t", totals.schema, ["window_start"])
    st.finish(st.batches_to(totals, out, table.write, "update"))
    got = table.read(spark)
    want = rows.groupBy(F.window("ts", "30 minutes", "15 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    )
    assert rows_of(got, "window_start", "n") == rows_of(want, "w.start", "n")


def test_late_rows_are_dropped_and_counted(spark):
    folder = work_folder(spark, "late")
    first = "SELECT timestamp'2024-01-01 10:00:00' AS ts, 1.0D AS value"
    late = "SELECT timestamp'2024-01-01 03:00:00' AS ts, 1.0D AS value"
    spark.sql(first).coalesce(1).write.parquet(f"{folder}/in")
    out = f"{folder}/out"

    def run():
        rows = st.file_stream(spark, f"{folder}/in", "ts timestamp, value double")
        return st.finish(
            st.batches_to(
                st.sliding_totals(rows, "ts", "value"), out, st.appended(out, "t"), "update"
            )
        )

    run()
    spark.sql(late).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    progress = run().recentProgress
    dropped = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    assert dropped > 0
    starts = spark.read.parquet(f"{out}/t").select(F.min("window_start")).first()[0]
    assert starts.hour == 9


def test_keyed_table_repeats_batches_safely(spark):
    out = work_folder(spark, "keyed")
    schema = spark.createDataFrame([], "k long, at long, v string").schema
    table = st.KeyedTable(out, schema, ["k"], ["at"], fan=2)
    assert table.read(spark).count() == 0

    def batch(*rows):
        return spark.createDataFrame(rows, schema)

    steps = [
        (0, batch((1, 1, "a"), (2, 1, "a"), (None, 1, "n"))), (1, batch((1, 3, "b"))),
        (1, batch((1, 3, "b"))), (2, batch((2, 0, "old"), (3, 1, "c"))), (3, batch()),
        (4, batch((1, 2, "late"), (None, 2, "m"))), (4, batch((1, 2, "late"), (None, 2, "m"))),
    ]
    for epoch, rows in steps:
        table.write(rows, epoch)
    got = {r["k"]: r["v"] for r in table.read(spark).collect()}
    assert got == {1: "b", 2: "a", 3: "c", None: "m"}


def test_keyed_table_costs_what_a_batch_changes(spark):
    out = work_folder(spark, "keyed-cost")
    schema = spark.createDataFrame([], "k long, at long, v string").schema
    table = st.KeyedTable(out, schema, ["k"], ["at"], fan=4)
    folder = Folder(spark, out)
    sizes, merged = [], []
    for epoch in range(17):  # every batch brings as many new keys
        rows = spark.range(epoch * 500, (epoch + 1) * 500, 1, 2)
        table.write(rows.selectExpr("id AS k", "id AS at", "hex(id) AS v"), epoch)
        sizes.append(folder.bytes(f"level=0/run={epoch}"))
        merged.append(len(table.runs(spark)))
    assert max(sizes) < 1.3 * min(sizes)
    assert max(merged) <= 3 + 3 + 1
    assert table.read(spark).count() == 17 * 500
    assert folder.names("level=0") == [f"run={k}" for k in (12, 13, 14, 15, 16)]
    some = table.read(spark, where=F.col("k") == 4321).collect()
    assert [(r.k, r.v) for r in some] == [(4321, "10E1")]
    again = spark.range(8000, 8500).selectExpr("id AS k", "id AS at", "hex(id) AS v")
    table.write(again, 16)
    assert table.read(spark).count() == 17 * 500


def test_a_merge_can_be_repeated(spark):
    out = work_folder(spark, "keyed-merge")
    schema = spark.createDataFrame([], "k long, v string").schema
    table = st.KeyedTable(out, schema, ["k"], fan=2)
    for epoch in range(4):
        table.write(spark.createDataFrame([(1, f"v{epoch}"), (epoch + 10, "x")], schema), epoch)
    before = sorted(map(tuple, table.read(spark).collect()))
    # a crash left the merge of the last batch without its mark
    Folder(spark, out).remove("level=2/run=0/_SUCCESS")
    assert sorted(map(tuple, table.read(spark).collect())) == before
    table.write(spark.createDataFrame([(1, "v3"), (13, "x")], schema), 3)
    assert sorted(map(tuple, table.read(spark).collect())) == before
    assert table.runs(spark) == [(2, 0)]


def test_subscriptions_are_read_for_each_batch(spark, split_events):
    folder, rows = split_events
    out = work_folder(spark, "subscriptions")
    users = [r[0] for r in rows.select("user_id").distinct().orderBy("user_id").limit(2).collect()]
    spark.createDataFrame([(users[0],)], "user_id long").write.parquet(f"{out}/who")
    seen = []

    def sink(batch, epoch):
        seen.append((epoch, {r[0] for r in batch.select("user_id").distinct().collect()}))
        if epoch == 1:  # a second entity is added while the stream runs
            spark.createDataFrame([(users[1],)], "user_id long").write.mode("append").parquet(f"{out}/who")

    wanted = lambda session: session.read.parquet(f"{out}/who")
    live = st.subscribed_sink(wanted, "user_id", sink)
    st.finish(st.batches_to(stream(spark, folder), out, live))
    early = set().union(*(s for e, s in seen if e <= 1))
    late = set().union(*(s for e, s in seen if e > 1))
    assert early <= {users[0]} and users[1] in late


def test_routed_records(spark):
    out = work_folder(spark, "routed")
    got = {}
    sink = st.routed_sink(
        "bad", lambda b, e: got.update(good=b.count()), lambda b, e: got.update(dead=b.count())
    )
    sink(spark.createDataFrame([([],), (["x"],), (["y", "z"],)], "bad array<string>"), 0)
    assert got == {"good": 1, "dead": 2} and out


def test_processing_time_trigger(spark, split_events):
    folder, rows = split_events
    out = work_folder(spark, "interval")
    frame = stream(spark, folder).select("event_id")
    query = st.append_to_table(frame, out, interval="200 milliseconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(f"{out}/rows").count() == rows.count()


def test_restart_does_not_repeat_rows(spark, split_events):
    folder, rows = split_events
    out = work_folder(spark, "restart")
    for _ in range(2):
        st.finish(st.append_to_table(stream(spark, folder).select("event_id", "value"), out))
    assert spark.read.parquet(f"{out}/rows").count() == rows.count()


def test_broken_records_are_marked(spark):
    frame = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("[]",), ('{"b": 2}',)], "record string")
    got = st.parse_records(frame, "record", "a int").collect()
    assert [r["_bad"] for r in got][:2] == [False, True]
    assert [r["a"] for r in got] == [1, None, None, None]
