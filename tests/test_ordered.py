"""Windows over large groups give what plain windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import graph, labels, metrics, ordered, sequences, splits

LIMIT = 40


@pytest.fixture(scope="module")
def rows(spark):
    """One entity holds most rows, many of them at the same time; values have gaps."""
    rng = random.Random(5)
    data = []
    for n in range(1200):
        entity = 1 if n % 3 else rng.randrange(2, 12)
        at = 500 if entity == 1 and n % 2 else rng.randrange(1000)
        value = None if rng.random() < 0.6 else float(rng.randrange(50))
        data.append((n, entity, at, value))
    frame = spark.createDataFrame(data, "id int, entity int, at int, value double")
    return frame.repartition(6).cache()


ORDER = ["at", "id"]


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Adaptive execution would join ranges as small as these."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ranges_cut_a_large_group(rows):
    parts = ordered.in_ranges(rows, ["entity"], ORDER)
    sizes = parts.groupBy("_range").count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 500
    spans = parts.groupBy("entity").agg(F.count_distinct("_range").alias("n")).filter("entity = 1")
    assert spans.first()["n"] > 3


def with_null_keys(spark):
    """Many entities, none small against the ranges, one of them null; values are often null."""
    rng = random.Random(9)
    data = [
        (n, rng.choice([None, *range(30)]), rng.choice([None, 1, 2]), rng.randrange(10_000),
         None if rng.random() < 0.7 else rng.randrange(50))
        for n in range(3000)
    ]
    schema = "id int, entity int, part int, at int, value long"
    return spark.createDataFrame(data, schema).repartition(5)


def test_null_keys_and_null_values(spark):
    frame = with_null_keys(spark)
    keys = ["entity", "part"]
    spec = Window.partitionBy(*keys).orderBy(*ORDER)
    upto = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nulls = [F.coalesce("a", F.lit(-1)), F.coalesce("b", F.lit(-1))]

    got = ordered.running_sums(frame.withColumn("a", F.col("value")), keys, ORDER, ["a"])
    got = ordered.fill_forward(got, keys, ORDER, {"b": "value"})
    want = frame.withColumn("a", F.sum("value").over(upto)).withColumn(
        "b", F.last("value", ignorenulls=True).over(spec)
    )
    assert collected(got, "id", *nulls) == collected(want, "id", *nulls)
    assert got.filter("a is null").count() > 0 and got.count() == 3000

    lags = sequences.lag_matrix(frame, keys, ORDER, "id", 3, limit=10)
    plain = sequences.lag_matrix(frame, keys, ORDER, "id", 3, limit=None)
    names = ["id", *[F.coalesce(f"window_{i}", F.lit(-1)) for i in range(3)]]
    assert collected(lags, *names) == collected(plain, *names)


def test_nulls_that_start_a_range(spark):
    frame = spark.range(400).select(
        "id", F.lit(None).cast("int").alias("k"),
        F.when(F.col("id") == 0, F.lit(5)).cast("long").alias("v"),
    )
    got = ordered.running_sums(frame, ["k"], ["id"], ["v"])
    assert {r["v"] for r in got.collect()} == {5}


def test_group_values_with_null_keys(spark):
    frame = with_null_keys(spark)
    tops = frame.groupBy("entity", "part").agg(F.max("at").alias("top"))
    got = ordered.join_group_values(frame, tops, ["entity", "part"])
    want = frame.withColumn("top", F.max("at").over(Window.partitionBy("entity", "part")))
    assert got.columns == [*frame.columns, "top"]
    assert collected(got, "id", "top") == collected(want, "id", "top") and got.count() == 3000


def test_onsets_with_null_keys(spark):
    flagged = with_null_keys(spark).withColumn("onset", F.when(F.col("value") > 40, F.col("at")))
    got = labels.onset_time(flagged, ["entity", "part"], "onset", "o")
    want = flagged.withColumn("o", F.min("onset").over(Window.partitionBy("entity", "part")))
    key = F.coalesce("o", F.lit(-1))
    assert collected(got, "id", key) == collected(want, "id", key) and got.count() == 3000


def test_null_groups_in_pooling_and_metrics(spark):
    frame = spark.createDataFrame(
        [(g, y, p) for g in (None, "a") for y, p in ((1, 0.9), (0, 0.2), (0, 0.7), (1, 0.4))]
        + [(None, 1, 0.1), (None, None, 0.3), (None, None, 0.4)],
        "g string, y int, p double",
    )
    assert {r["g"] for r in sequences.pool_softmax(frame, ["g"], "p", ["p"]).collect()} == {None, "a"}
    assert {r["g"] for r in metrics.metrics_by(frame, "y", "p", ["g"]).collect()} == {None, "a"}
    gaps = metrics.fairness_gaps(frame, "y", "p", "g").first()
    assert gaps["n_groups"] == 2 and gaps["demographic_parity_gap"] > 0
    assert None in {r["class"] for r in metrics.score_histogram(frame, "y", "p", 5).collect()}


def test_row_numbers(rows):
    got = ordered.row_numbers(rows, ["entity"], ORDER, limit=LIMIT)
    spec = Window.partitionBy("entity").orderBy(*ORDER)
    want = rows.withColumn("row_num", F.row_number().over(spec))
    assert collected(got, "id", "row_num") == collected(want, "id", "row_num")


def test_row_numbers_without_keys(rows):
    got = ordered.row_numbers(rows, [], ORDER, limit=LIMIT)
    want = rows.withColumn("row_num", F.row_number().over(Window.orderBy(*ORDER)))
    assert collected(got, "id", "row_num") == collected(want, "id", "row_num")


def test_running_sums(rows):
    whole = rows.fillna(0.0)
    got = ordered.running_sums(whole, ["entity"], ORDER, ["value"], limit=LIMIT)
    spec = Window.partitionBy("entity").orderBy(*ORDER).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    want = whole.withColumn("value", F.sum("value").over(spec))
    assert collected(got, "id", "value") == collected(want, "id", "value")


def test_fill_forward(rows):
    got = ordered.fill_forward(rows, ["entity"], ORDER, {"filled": "value"}, LIMIT)
    spec = Window.partitionBy("entity").orderBy(*ORDER)
    want = rows.withColumn("filled", F.last("value", ignorenulls=True).over(spec))
    key = F.coalesce("filled", F.lit(-1.0))
    assert collected(got, "id", key) == collected(want, "id", key)


@pytest.mark.parametrize("n", [2, 7])
def test_lags(rows, n):
    got = sequences.lag_matrix(rows, ["entity"], ORDER, "id", n, limit=LIMIT)
    want = sequences.lag_matrix(rows, ["entity"], ORDER, "id", n)
    names = ["id", *[F.coalesce(f"window_{i}", F.lit(-1)) for i in range(n)]]
    assert collected(got, *names) == collected(want, *names)


def test_sliding_sequences_keep_missing_values(rows):
    got = sequences.sliding_sequences(rows, ["entity"], ORDER, ["value"], 9, limit=LIMIT)
    want = sequences.sliding_sequences(rows, ["entity"], ORDER, ["value"], 9)
    text = F.to_json("sequence")
    assert collected(got, "id", text) == collected(want, "id", text)
    assert got.filter(F.size("sequence") != 9).count() == 0


def test_block_must_be_longer_than_the_look_back(rows):
    with pytest.raises(ValueError):
        sequences.lag_matrix(rows, ["entity"], ORDER, "id", 50, limit=LIMIT)


def test_sessions(rows):
    timed = rows.withColumn("ts", F.timestamp_seconds("at"))
    got = sequences.sessions(timed, ["entity"], "ts", "id", 3, limit=LIMIT)
    want = sequences.sessions(timed, ["entity"], "ts", "id", 3)
    assert collected(got, "id", "session") == collected(want, "id", "session")
    assert want.agg(F.max("session")).first()[0] > 3


def test_fill_linear(rows):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("at") + F.col("id") / 10000))
    got = sequences.fill_linear(timed, ["entity"], "ts", ["value"], limit=LIMIT)
    want = sequences.fill_linear(timed, ["entity"], "ts", ["value"])
    key = F.coalesce(F.round("value_linear", 9), F.lit(-1.0))
    assert collected(got, "id", key) == collected(want, "id", key)


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_exact_quantiles(rows, q):
    known = sorted(r[0] for r in rows.filter("value is not null").select("value").collect())
    want = next(v for i, v in enumerate(known, 1) if i >= q * len(known))
    for limit, accuracy in ((None, 10_000), (LIMIT, 20)):
        got = ordered.exact_quantiles(
            rows, {"v": F.col("value"), "none": F.lit(None)}, q, limit, accuracy
        )
        assert got == {"v": want, "none": None}


def test_quantile_of_distinct_values(spark):
    frame = spark.range(10_000).select((F.col("id") * 7919 % 10_007).cast("double").alias("x"))
    known = sorted(r[0] for r in frame.collect())
    for accuracy in (20, 200, 10_000):
        got = ordered.exact_quantiles(frame, {"x": F.col("x")}, 0.5, 300, accuracy)
        assert got["x"] == known[4999]


def test_exact_split_sizes(rows):
    got = splits.split_exact(rows, "id", limit=LIMIT).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 840, "val": 180, "test": 180}


def test_areas_do_not_depend_on_chunks(spark):
    scored = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, 0.25).otherwise((F.col("id") * 37 % 1009) / 1009).alias("p"),
        (F.col("id") % 7 < 2).cast("int").alias("y"),
        (F.col("id") % 2).alias("part"),
    )
    for by in ([], ["part"]):
        plain = metrics.areas(scored, "y", "p", by).collect()
        cut = metrics.areas(scored, "y", "p", by, limit=LIMIT).collect()
        values = [
            sorted((r["n_pos"], round(r["auroc"], 12), round(r["average_precision"], 12)) for r in x)
            for x in (plain, cut)
        ]
        assert values[0] == values[1]


def test_group_values_reach_every_row_of_a_large_group(rows):
    tops = rows.groupBy("entity").agg(F.max("at").alias("top"))
    got = ordered.join_group_values(rows, tops, ["entity"])
    want = rows.join(tops, "entity")
    key = F.coalesce("value", F.lit(-1.0))
    assert collected(got, "id", "top", key) == collected(want, "id", "top", key)


def test_attention_at_a_node_with_many_in_edges(spark):
    edges = spark.range(600).select(
        F.lit("e").alias("edge_type"), F.lit("s").alias("src_type"),
        F.col("id").cast("string").alias("src"), F.lit("d").alias("dst_type"),
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).cast("string").alias("dst"),
    )
    sources = spark.range(600).select(
        F.lit("s").alias("node_type"), F.col("id").cast("string").alias("node"),
        F.sin("id").alias("x"),
    )
    targets = spark.range(50).select(
        F.lit("d").alias("node_type"), F.col("id").cast("string").alias("node"),
        F.cos("id").alias("x"),
    )
    nodes = sources.unionByName(targets)
    for scope in ("destination", "all"):
        got = graph.neighbor_attention(nodes, edges, ["x"], "x", "x", scope=scope)
        rule = F.expr("(s.x + d.x) * if(s.x + d.x > 0, 1, 0.2)")
        one = edges.join(sources.alias("s"), F.col("src") == F.col("s.node")).join(
            targets.alias("d"), F.col("dst") == F.col("d.node")
        ).select("dst", F.col("s.x").alias("x"), F.exp(rule).alias("w"))
        total = one.agg(F.sum("w")).first()[0]
        mass = F.sum("w") if scope == "destination" else F.lit(total)
        want = one.groupBy(F.col("dst").alias("node")).agg(
            F.count("*").alias("n_in"), (F.sum(F.col("w") * F.col("x")) / mass).alias("x")
        )
        x = F.round("x", 9)
        assert collected(got, "node", "n_in", x) == collected(want, "node", "n_in", x)
        assert got.agg(F.max("n_in")).first()[0] > 400


def test_range_count_follows_the_rows():
    assert ordered.range_count(0, 8) is None
    assert ordered.range_count(8 * ordered.ROWS_PER_TASK, 8) is None
    assert ordered.range_count(8 * ordered.ROWS_PER_TASK + 1, 8) == 9


def test_only_border_groups_are_carried(spark):
    frame = with_null_keys(spark)
    parts = ordered.in_ranges(frame, ["entity", "part"], ORDER).cache()
    edges = ordered._border_groups(parts, ["entity", "part"])
    per_range = edges.select("_range", "entity", "part").distinct().groupBy("_range").count()
    assert {r["count"] for r in per_range.collect()} <= {1, 2}
    spec = Window.partitionBy("_range").orderBy("entity", "part", *ORDER)
    first = parts.withColumn("_k", F.row_number().over(spec)).filter("_k = 1")
    assert first.join(edges, ["_range", "id"], "left_anti").count() == 0


def test_long_ranges_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 100)
    frame = with_null_keys(spark)
    parts = ordered.in_ranges(frame, ["entity", "part"], ORDER)
    assert parts.select("_range").distinct().count() > 20 and parts.count() == 3000
    got = ordered.row_numbers(frame, ["entity"], ORDER)
    spec = Window.partitionBy("entity").orderBy(*ORDER)
    want = frame.withColumn("row_num", F.row_number().over(spec))
    assert collected(got, "id", "row_num") == collected(want, "id", "row_num")
