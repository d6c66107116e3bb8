"""Edge cases on small hand-made frames."""

import math
import os
import pathlib
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import catalog as c
from tidewatch.functions import expressions as x
from tidewatch.operators import (
    attribution,
    buckets,
    cohort,
    drift,
    graph,
    labels,
    metrics,
    monitor,
    quality,
    scaling,
    scoring,
    sequences,
    splits,
)
from tidewatch.session import work_folder
from tidewatch.sources import tables


def one(df):
    return df.first().asDict()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# expressions


@pytest.mark.parametrize(
    ("p", "tier"),
    [(0.0, "low"), (0.2, "medium"), (0.5, "high"), (0.8, "critical"), (1.0, "critical")],
)
def test_risk_tier(spark, p, tier):
    assert value(spark, x.risk_tier(F.lit(p))) == tier


def test_missing_risk_has_no_tier(spark):
    assert value(spark, x.risk_tier(F.lit(None).cast("double"))) is None


def test_confidence_is_one_and_certainty_is_not(spark):
    assert value(spark, x.confidence(F.lit(0.5))) == 1.0
    assert value(spark, x.confidence(F.lit(0.01))) == 1.0
    assert value(spark, x.certainty(F.lit(0.5))) == 0.0
    assert value(spark, x.certainty(F.lit(1.0))) == 1.0


def test_true_zero_is_kept_unless_asked(spark):
    assert value(spark, x.default_for(F.lit(0.0), 70.0)) == 0.0
    assert value(spark, x.default_for(F.lit(0.0), 70.0, zero_is_missing=True)) == 70.0
    assert value(spark, x.default_for(F.lit(None).cast("double"), 70.0)) == 70.0


def test_cross_entropy_does_not_overflow(spark):
    assert value(spark, x.binary_cross_entropy(F.lit(800.0), F.lit(0))) == 800.0
    assert value(spark, x.binary_cross_entropy(F.lit(-800.0), F.lit(0))) == 0.0


@pytest.mark.parametrize(("logit", "y"), [(0.3, 1), (0.3, 0), (-2.0, 1)])
def test_focal_loss(spark, logit, y):
    p = 1 / (1 + math.exp(-logit))
    hit, side = (p, 0.25) if y else (1 - p, 0.75)
    want = side * (1 - hit) ** 2 * -math.log(hit)
    assert value(spark, x.focal_loss(F.lit(logit), F.lit(y))) == pytest.approx(want)


def test_organ_rules_severest_first(spark):
    frame = spark.createDataFrame(
        [(90.0, 60.0, 13.0, 10.0, None)],
        "`50821` double, `220052` double, `50885` double, `51265` double, `50912` double",
    )
    score = frame.select(
        x.step_score(c.ORGAN_RULES).alias("steps"),
        x.step_score(c.ORGAN_RULES, severest_first=False).alias("flat"),
    )
    assert one(score) == {"steps": 4 + 1 + 4 + 4, "flat": 4}


# labels


@pytest.fixture(scope="module")
def course(spark):
    rows = [(1, h, s) for h, s in enumerate([0, 1, 2, 0, 3])] + [(2, 0, 1), (2, 1, 0)]
    return spark.createDataFrame(rows, "who int, h int, score int").withColumn(
        "ts", F.timestamp_seconds(F.col("h") * 3600)
    )


def test_labels_look_ahead(course):
    rows = labels.labelled(course, ["who"], "ts", F.col("score"), 2, 1).orderBy("who", "h")
    got = [(r["who"], r["h"], r["hours_to_event"], r["label"]) for r in rows.collect()]
    assert got == [
        (1, 0, 2.0, 0), (1, 1, 1.0, 1), (1, 2, 0.0, 1), (1, 3, -1.0, 0), (1, 4, -2.0, 0),
        (2, 0, None, 0), (2, 1, None, 0),
    ]


def test_running_onset_is_unknown_before_the_event(course):
    flagged = course.withColumn("onset", labels.onset_flag(F.col("score"), F.col("ts")))
    rows = labels.running_onset(flagged, ["who"], "ts", "onset").filter("who = 1").orderBy("h")
    assert [r["onset_so_far"] is not None for r in rows.collect()] == [
        False, False, True, True, True,
    ]


def test_full_severity(spark):
    frame = spark.createDataFrame(
        [(65.0, 1.0, 1.3, 3, 3, None, 9, 150.0), (80.0, None, 6.0, 4, 5, 6, None, 900.0)],
        "map double, nor double, creat double, eye int, verbal int, motor int, total int, "
        "urine double",
    )
    rules = (x.StepRule("map", "below", (70,)), x.StepRule("creat", "above", (1.2, 2.0, 3.5, 5.0)))
    score = labels.full_severity(rules, ["nor"], ["eye", "verbal", "motor"], "total", "urine")
    assert [r[0] for r in frame.select(score).collect()] == [2 + 3 + 4, 0 + 0 + 4]


def test_screening_score_counts_missing_as_zero(spark):
    none = F.lit(None).cast("double")
    assert value(spark, labels.screening_score(F.lit(22.0), F.lit(100.0), F.lit(13.0))) == 3
    assert value(spark, labels.screening_score(none, F.lit(101.0), F.lit(14.0))) == 0


# buckets and joins


def test_profile_of_single_points_and_absent_items(spark):
    frame = spark.createDataFrame(
        [(1, "a", 2.0), (1, "b", 1.0), (1, "b", 3.0), (2, "z", 9.0)], "k int, item string, v double"
    )
    rows = buckets.pivot_profile(frame, ["k"], "item", "v", ["a", "b", "c"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["a_mean"], r["a_std"], r["a_count"]) == (2.0, None, 1)
    assert (r["b_mean"], r["b_min"], r["b_max"], r["b_count"]) == (2.0, 1.0, 3.0, 2)
    assert r["c_count"] is None


def test_shared_columns_are_kept_once(spark):
    stays = spark.createDataFrame([(1, 10, 5)], "stay int, hadm int, subject int")
    admissions = spark.createDataFrame([(10, 5, "E")], "hadm int, subject int, kind string")
    patients = spark.createDataFrame([(5, "M")], "subject int, gender string")
    joined = cohort.join_entities(stays, admissions, patients, "hadm", "subject")
    assert sorted(joined.columns) == ["gender", "hadm", "kind", "stay", "subject"]
    assert joined.count() == 1


def test_stays_without_rows_are_kept(spark):
    stays = spark.sql(
        "SELECT * FROM VALUES (1, 7, timestamp'2024-01-01 10:30:00', timestamp'2024-01-03 01:00:00'),"
        " (2, 8, timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 05:00:00') "
        "AS t(stay, who, b, e)"
    )
    rows = spark.sql(
        "SELECT * FROM VALUES (7, timestamp'2024-01-01 10:00:00', 1.0), "
        "(7, timestamp'2024-01-02 09:00:00', 2.0), (7, timestamp'2024-01-03 01:00:00', 3.0), "
        "(7, timestamp'2024-01-03 02:00:00', 4.0), (9, timestamp'2024-01-01 00:00:00', 5.0) "
        "AS t(who, t, v)"
    )
    got = cohort.within_stay(stays, rows, "who", "stay", "b", "e", "t")
    assert sorted((r["stay"], r["v"] or 0) for r in got.collect()) == [
        (1, 1.0), (1, 2.0), (1, 3.0), (2, 0),
    ]


def test_fanout_is_the_product_of_the_counts(spark):
    stays = spark.createDataFrame([(1,), (1,), (2,)], "who int")
    left = spark.createDataFrame([(1, 0)] * 3, "who int, a int")
    right = spark.createDataFrame([(1, 0)] * 4 + [(2, 0)], "who int, b int")
    rows = cohort.fanout_rows(stays, left, right, "who")
    assert {r["who"]: r["n_rows"] for r in rows.collect()} == {1: 24, 2: 1}
    assert stays.join(left, "who", "left").join(right, "who", "left").count() == 25


# quality


def test_rules(spark):
    frame = spark.createDataFrame([(301.0, None, "M"), (80.0, 20.0, "X")], "hr double, rr double, g string")
    rules = quality.range_rules({"hr": (0, 300), "rr": (5, 60)}, required=["rr"])
    rules["g"] = quality.matches(F.col("g"), c.GENDER_PATTERN)
    got = [r[0] for r in frame.select(quality.broken_rules(rules)).collect()]
    assert got == [["hr", "rr"], ["g"]]
    routes = frame.select(quality.route(quality.broken_rules(rules)))
    assert {r[0] for r in routes.collect()} == {"dead_letter"}


@pytest.mark.parametrize(("n", "ok"), [(0, False), (23, False), (24, True), (72, True), (73, False)])
def test_length_rule(spark, n, ok):
    assert value(spark, quality.length_ok(F.array_repeat(F.lit(1), n))) is ok


def test_missing_array_breaks_length_and_shape(spark):
    none = F.lit(None).cast("array<double>")
    assert value(spark, quality.length_ok(none)) is False
    assert value(spark, quality.shape_ok(none, [3])) is False


def test_shape_of_nested_arrays(spark):
    ragged = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))
    assert value(spark, quality.shape_ok(ragged, [-1, 2])) is False
    assert value(spark, quality.shape_ok(ragged, [2, -1])) is True


# metrics


@pytest.fixture(scope="module")
def tied(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.5), (1, 0.1), (0, 0.0)]
    return spark.createDataFrame(rows, "y int, p double")


def test_areas_with_ties(tied):
    got = one(metrics.areas(tied, "y", "p"))
    assert got["auroc"] == pytest.approx((3 + 2 * 0.5 + 1 + 1) / 9)
    assert got["average_precision"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 4 + 1 / 3 * 3 / 5)


@pytest.mark.parametrize("y", [0, 1])
def test_one_class_gives_zero_areas(spark, y):
    frame = spark.createDataFrame([(y, 0.2), (y, 0.7)], "y int, p double")
    got = one(metrics.areas(frame, "y", "p"))
    assert (got["auroc"], got["average_precision"]) == (0.0, 0.0)


def test_decision_is_strict(tied):
    got = one(metrics.confusion(tied, "y", "p", 0.5))
    assert got == {"tp": 1, "fp": 0, "tn": 3, "fn": 2}


def test_rates_without_positives(spark):
    frame = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    got = one(metrics.with_rates(metrics.confusion(frame, "y", "p", 0.5)))
    assert (got["precision"], got["recall"], got["f1"]) == (0.0, 0.0, 0.0)
    assert (got["accuracy"], got["specificity"], got["npv"]) == (1.0, 1.0, 1.0)


def test_lowest_threshold_wins_a_tie(spark):
    frame = spark.createDataFrame([(1, 0.95), (0, 0.05)], "y int, p double")
    assert one(metrics.optimal_threshold(metrics.threshold_sweep(frame, "y", "p"))) == {
        "optimal_threshold": 0.1, "optimal_f1": 1.0,
    }


def test_calibration_edges(spark):
    frame = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 1.0)], "y int, p double")
    bins = metrics.calibration_bins(frame, "y", "p")
    got = {r["bin"]: (r["n"], r["accuracy"], r["confidence"]) for r in bins.collect()}
    assert got[0] == (1, 1.0, 0.1)
    assert got[9] == (1, 1.0, 1.0)
    assert got[5] == (0, 0.0, 0.0)
    assert sum(n for n, *_ in got.values()) == 2
    assert one(metrics.calibration_error(bins))["ece"] == pytest.approx(0.9 / 3)


def test_curve_ends(tied):
    last = metrics.roc_points(tied, "y", "p").orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_histogram_of_one_value(spark):
    frame = spark.createDataFrame([(1, 0.4), (1, 0.4)], "y int, p double")
    got = one(metrics.score_histogram(frame, "y", "p", 5))
    assert (got["bin"], got["n"], got["density"]) == (2, 2, 5.0)


def test_histogram_density_sums_to_one(spark):
    frame = spark.range(100).select(F.lit(1).alias("y"), (F.col("id") / 99).alias("p"))
    got = metrics.score_histogram(frame, "y", "p", 10)
    assert one(got.agg(F.sum("density").alias("d")))["d"] == pytest.approx(10)
    assert one(got.agg(F.sum("n").alias("n")))["n"] == 100


def test_composite_loss_is_the_weighted_sum(tied):
    a, b = F.col("p") * 3 - 1, F.col("p") - 0.5
    y = F.col("y")
    got = one(
        tied.agg(
            metrics.composite_loss(a, [b, -b], y, 0.3).alias("all"),
            F.avg(x.focal_loss(a, y)).alias("m"),
            F.avg(x.focal_loss(b, y)).alias("s"),
            F.avg(x.focal_loss(-b, y)).alias("t"),
        )
    )
    assert got["all"] == pytest.approx(got["m"] + 0.3 * got["s"] + 0.3 * got["t"])


def test_bootstrap_interval_holds_the_value(spark):
    frame = spark.range(4000).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 7 % 100) / 100).alias("p")
    )
    rows = {r["metric"]: r for r in metrics.bootstrap_ci(frame, "y", "p").collect()}
    accuracy = rows["accuracy"]
    assert accuracy["low"] < accuracy["value"] < accuracy["high"]
    assert 0.02 < accuracy["high"] - accuracy["low"] < 0.05  # about 4 standard errors


def test_no_drift_between_equal_halves(spark):
    frame = spark.range(2000).select(
        (F.floor(F.col("id") / 2) % 97).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("c")
    )
    assert one(drift.ks_statistic(frame, "v", "c"))["ks"] == 0.0
    counts = drift.binned_counts(frame, "v", "c", [20, 50])
    assert one(drift.psi_statistic(counts))["psi"] == 0.0
    assert one(drift.chi2_statistic(counts))["drift"] is False


def test_drift_is_flagged(spark):
    frame = spark.range(2000).select(
        (F.col("id") % 100 + F.when(F.col("id") % 2 == 0, 30).otherwise(0)).cast("double").alias("v"),
        (F.col("id") % 2 == 0).alias("c"),
    )
    assert one(drift.ks_statistic(frame, "v", "c"))["drift"] is True
    counts = drift.binned_counts(frame, "v", "c", [20, 50, 100])
    assert one(drift.psi_statistic(counts))["drift"] is True
    assert one(drift.chi2_statistic(counts))["drift"] is True


# scaling and splits


def test_constant_and_empty_columns_are_skipped(spark):
    frame = spark.createDataFrame(
        [(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, n double"
    )
    scaled, stats = scaling.fit_min_max(frame, ["a", "b", "n"])
    assert list(stats) == ["a"]
    assert sorted(r["a_norm"] for r in scaled.collect()) == [0.0, 1.0]
    assert "b_norm" not in scaled.columns


def test_lower_median(spark):
    frame = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 100.0)], "v double")
    got = one(scaling.medians(frame, ["v"]))
    assert (got["median"], got["mad"]) == (2.0, 1.0)


def test_unknown_method(spark):
    frame = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        scaling.apply_scaling(frame, scaling.stats_table(frame, ["v"]), ["v"], "rank")


def test_split_shares_must_sum_to_one():
    with pytest.raises(ValueError):
        splits.split_of(F.lit(1), shares=(("a", 0.5), ("b", 0.4)))


def test_grouped_split_does_not_leak(spark):
    rows = spark.range(500).select((F.col("id") % 50).alias("who"))
    named = rows.withColumn("split", splits.split_of(F.col("who")))
    parts = {n: named.filter(F.col("split") == n) for n, _ in splits.SPLITS}
    assert {r["n_shared"] for r in splits.leaked_ids(parts, "who").collect()} == {0}


def test_class_weights_of_an_unseen_class(spark):
    frame = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    got = {r["class"]: r["weight"] for r in splits.class_weights(frame, "y", (0, 1, 2)).collect()}
    assert got == {0: 4 / 6, 1: 2.0, 2: 2.0}


# sequences


def test_padding_repeats_the_last_step(spark):
    steps = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    assert value(spark, sequences.pad_steps(steps, 4, 2)) == [[1, 2], [3, 4], [3, 4], [3, 4]]
    empty = F.array().cast("array<array<double>>")
    assert value(spark, sequences.pad_steps(empty, 2, 2)) == [[0, 0], [0, 0]]


def test_assembly_cut(spark):
    steps = F.array(*[F.array(F.lit(float(k))) for k in range(5)])
    static = F.array(F.lit(9.0))
    last = sequences.assemble_vector(static, steps, 5, 1, 3, 6)
    first = sequences.assemble_vector(static, steps, 5, 1, 3, 6, keep="first")
    assert value(spark, last) == [9, 2, 3, 4, 0, 0]
    assert value(spark, first) == [9, 0, 1, 2, 0, 0]


def test_softmax_pooling_does_not_overflow(spark):
    frame = spark.createDataFrame([(1, 1000.0, 2.0), (1, 1000.0, 4.0), (1, 0.0, 50.0)], "k int, s double, v double")
    assert one(sequences.pool_softmax(frame, ["k"], "s", ["v"]))["v"] == 3.0


def test_unknown_pooling(spark):
    with pytest.raises(ValueError):
        sequences.pool(spark.range(1), ["id"], ["id"], ["id"], "median")


# graph


@pytest.fixture(scope="module")
def tiny_graph(spark):
    nodes = spark.createDataFrame(
        [("p", "1", 2.0), ("s", "1", -3.0), ("s", "2", 5.0), ("s", "3", 7.0)],
        "node_type string, node string, x double",
    )
    edges = spark.createDataFrame(
        [("has", "p", "1", "s", "1"), ("has", "p", "1", "s", "2")],
        "edge_type string, src_type string, src string, dst_type string, dst string",
    )
    return nodes, edges


def test_nodes_without_in_edges_keep_their_value(tiny_graph):
    nodes, edges = tiny_graph
    got = {(r[0], r[1]): r["x"] for r in graph.neighbor_sum(nodes, edges, ["x"]).collect()}
    assert got == {("p", "1"): 2.0, ("s", "1"): 2.0, ("s", "2"): 2.0, ("s", "3"): 7.0}


def test_no_edges_keep_all_nodes(tiny_graph):
    nodes, edges = tiny_graph
    got = graph.neighbor_sum(nodes, edges.limit(0), ["x"], steps=1)
    assert sorted(r["x"] for r in got.collect()) == [-3.0, 2.0, 5.0, 7.0]


def test_both_ways_of_reversing_agree(tiny_graph):
    _, edges = tiny_graph
    both = graph.with_reverse(edges)
    want = edges.unionByName(graph.reverse_edges(edges))
    assert sorted(both.collect()) == sorted(want.select(both.columns).collect())


def test_attention_weights_sum_to_one(tiny_graph):
    nodes, edges = tiny_graph
    ones = nodes.withColumn("one", F.lit(1.0))
    for scope, total in (("destination", 1.0), ("all", None)):
        rows = graph.neighbor_attention(
            ones, graph.with_reverse(edges), ["one"], "x", "x", scope=scope
        ).collect()
        if total:
            assert all(r["one"] == pytest.approx(1.0) for r in rows)
        else:
            assert sum(r["one"] for r in rows) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def wide_graph(spark):
    """A cycle of 400 nodes with chords, a node with 200 in-edges, and nodes without any."""
    nodes = [("n", str(k), math.sin(k), 1.0 + k % 3) for k in range(420)]
    ends = [(k, (k + 1) % 400) for k in range(400)] + [(k, 7 * k % 400) for k in range(0, 400, 3)]
    ends += [(k, 5) for k in range(200)]
    edges = [("e", "n", str(a), "n", str(b)) for a, b in ends]
    return (
        spark.createDataFrame(nodes, "node_type string, node string, x double, y double"),
        spark.createDataFrame(edges, ", ".join(f"{c} string" for c in graph.EDGE)),
        {int(k): (x, y) for _, k, x, y in nodes}, ends,
    )


def left_on_disk(spark, work):
    """What ``work`` returns, the shuffles that still have files, and rows by kind of written table."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")

    def shuffles():
        files = disk.getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n.split("_")[1] for n in names if n.startswith("shuffle_")}

    shuffles_before, tables_before = shuffles(), set(os.listdir(root))
    out = work()
    for _ in range(40):
        if not shuffles() - shuffles_before:
            break
        time.sleep(0.25)
    rows = {}
    for table in set(os.listdir(root)) - tables_before:
        kind = table.rsplit("-", 1)[0]
        files = [f for f in pathlib.Path(root, table).rglob("*.parquet")]
        rows[kind] = rows.get(kind, 0) + sum(pq.read_metadata(f).num_rows for f in files)
    return out, shuffles() - shuffles_before, {kind: n for kind, n in rows.items() if n}


def attention(nodes, ends, whole):
    """In-degree and weighted mean of x and y per destination, edge by edge."""
    into = {}
    for a, b in ends:
        score = nodes[a][0] + nodes[b][0]
        into.setdefault(b, []).append((math.exp(score if score > 0 else 0.2 * score), *nodes[a]))
    total = sum(w for rows in into.values() for w, _, _ in rows)
    return {
        str(b): (len(rows), *[
            sum(r[0] * r[i] for r in rows) / (total if whole else sum(r[0] for r in rows))
            for i in (1, 2)
        ])
        for b, rows in into.items()
    }


def test_attention_over_all_edges_in_slices_leaves_only_its_result(spark, wide_graph, monkeypatch):
    nodes, edges, values, ends = wide_graph
    monkeypatch.setattr(graph, "ROWS_PER_SLICE", 100, raising=False)
    got, shuffles, tables = left_on_disk(
        spark, lambda: graph.neighbor_attention(nodes, edges, ["x", "y"], "x", "x", scope="all")
    )
    want = attention(values, ends, whole=True)
    rows = {r["node"]: (r["n_in"], r["x"], r["y"]) for r in got.collect()}
    assert rows.keys() == want.keys() and max(n for n, _, _ in rows.values()) > 200
    assert all(rows[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert not shuffles and tables == {"graph-attention": 400}


def test_attention_over_all_edges_with_endless_scores(spark, monkeypatch):
    low = float("-inf")
    nodes = spark.createDataFrame(
        [("n", "1", 0.0), ("n", "2", low), ("n", "3", 1.0), ("n", "4", None)],
        "node_type string, node string, x double",
    ).withColumn("one", F.lit(1.0))
    edges = spark.createDataFrame(
        [("e", "n", a, "n", b) for a, b in (("1", "2"), ("1", "3"), ("3", "1"), ("1", "4"), ("4", "1"))],
        ", ".join(f"{c} string" for c in graph.EDGE),
    )
    for rows_per_slice in (100, 1):
        monkeypatch.setattr(graph, "ROWS_PER_SLICE", rows_per_slice, raising=False)
        rows = graph.neighbor_attention(nodes, edges, ["one"], "x", "x", scope="all").collect()
        got = {r["node"]: (r["n_in"], r["one"]) for r in rows}
        assert got == {"1": (2, 0.5), "2": (1, 0.0), "3": (1, 0.5), "4": (1, None)}


def test_attention_per_destination_in_slices_leaves_only_its_result(spark, wide_graph, monkeypatch):
    nodes, edges, values, ends = wide_graph
    monkeypatch.setattr(graph, "ROWS_PER_SLICE", 100, raising=False)
    got, shuffles, tables = left_on_disk(
        spark, lambda: graph.neighbor_attention(nodes, edges, ["x", "y"], "x", "x")
    )
    want = attention(values, ends, whole=False)
    rows = {r["node"]: (r["n_in"], r["x"], r["y"]) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)
    assert not shuffles and tables == {"graph-attention": 400}


def test_two_steps_in_slices_leave_only_their_result(spark, wide_graph, monkeypatch):
    nodes, edges, values, ends = wide_graph
    monkeypatch.setattr(graph, "ROWS_PER_SLICE", 100, raising=False)
    got, shuffles, tables = left_on_disk(
        spark, lambda: graph.neighbor_sum(nodes, edges, ["x", "y"], steps=2)
    )
    want = values
    for step in range(2):
        into = {}
        for a, b in ends:
            into.setdefault(b, []).append(want[a])
        want = {k: tuple(map(math.fsum, zip(*into[k]))) if k in into else want[k] for k in want}
        if step == 0:
            want = {k: tuple(max(v, 0.0) + v for v in row) for k, row in want.items()}
    rows = {int(r["node"]): (r["x"], r["y"]) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    assert not shuffles and tables == {"graph-sums": 420}


# attribution


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [(1, [1.0, -2.0, 0.5]), (2, [0.0, 1.0, 3.0])], "id int, v array<double>"
    ).cache()


W = [0.7, -0.4, 0.2]


def make_model():
    def make():
        import numpy as np

        return lambda m: 1 / (1 + np.exp(-(np.asarray(m) @ np.array([0.7, -0.4, 0.2]))))

    return make


def test_integrated_gradients_add_up(points):
    base = [0.1, 0.2, 0.3]
    total = attribution.integrated_gradients(F.col("v"), W, base, n_steps=200)
    rows = points.select(
        F.aggregate(total, F.lit(0.0), lambda s, a: s + a).alias("sum"),
        scoring.linear_score(F.col("v"), W).alias("p"),
        scoring.linear_score(x.double_array(base), W).alias("p0"),
    ).collect()
    for r in rows:
        assert r["sum"] == pytest.approx(r["p"] - r["p0"], abs=1e-5)


def test_sampled_shapley_adds_up(points):
    mean = attribution.mean_baseline(points, "v")
    assert mean == [0.5, -0.5, 1.75]
    rows = attribution.shapley_sampled(points, "id", "v", make_model(), mean, 6)
    sums = {r["instance"]: r["s"] for r in rows.groupBy("instance").agg(F.sum("value").alias("s")).collect()}
    score = scoring.linear_score(F.col("v"), W) - scoring.linear_score(x.double_array(mean), W)
    for r in points.select("id", score.alias("d")).collect():
        assert sums[r["id"]] == pytest.approx(r["d"])


def test_component_features_outside_get_nothing(points):
    mean = attribution.mean_baseline(points, "v")
    model = attribution.component_predict(make_model(), mean, [0])
    rows = attribution.shapley_sampled(points, "id", "v", model, mean, 3)
    assert rows.filter("feature > 0 and abs(value) > 1e-12").count() == 0
    assert rows.filter("feature = 0 and abs(value) > 1e-3").count() == 2


def test_noise_does_not_change_between_runs(points):
    a, b = (
        attribution.gradient_shap(points, "id", "v", W, n_samples=10).collect() for _ in range(2)
    )
    assert sorted(a) == sorted(b)


def test_stability_without_noise_is_perfect(points):
    got = attribution.attribution_stability(
        points, "id", "v", lambda v: attribution.input_x_gradient(v, W), n_runs=3, sigma=0.0
    ).first()
    assert got["mean_correlation"] == pytest.approx(1.0)
    assert got["mean_std"] == pytest.approx(0.0, abs=1e-12)


def test_importance_of_an_unused_feature_is_zero(spark):
    frame = spark.range(400).select(
        "id",
        F.array((F.col("id") % 2 - 0.5), F.sin("id")).alias("v"),
        (F.col("id") % 2).cast("int").alias("y"),
    )

    def make():
        return lambda m: (m[:, 0] > 0).astype(float)

    rows = attribution.permutation_importance(frame, "id", "v", "y", make, 2, n_repeats=3)
    got = {r["feature"]: r["importance"] for r in rows.collect()}
    assert got[1] == 0.0
    assert 0.3 < got[0] < 0.7


# monitoring


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "who int, p double, ts timestamp")
    got = one(monitor.risk_summary(empty, "p", empty, "ts", F.current_timestamp()))
    assert got == {
        "total_entities": 0, "high_risk_entities": 0, "average_risk": 0.0, "active_alerts": 0,
    }


def test_day_old_alerts_are_not_active(spark):
    log = spark.sql(
        "SELECT timestamp'2024-01-01 12:10:00' AS ts, 0.9D AS p, 1 AS who UNION ALL "
        "SELECT timestamp'2024-01-02 11:50:00', 0.9D, 1"
    )
    now = F.lit("2024-01-02 12:20:00").cast("timestamp")
    assert one(monitor.risk_summary(log, "p", log, "ts", now))["active_alerts"] == 1


def test_empty_tiers_are_listed(spark):
    frame = spark.createDataFrame([(0.1,), (0.9,)], "p double")
    got = {r["tier"]: r["n"] for r in monitor.risk_distribution(frame, "p").collect()}
    assert got == {"low": 1, "medium": 0, "high": 0, "critical": 1}


def test_latest_record_by_time_then_id(spark):
    frame = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 3, "c")], "who int, t int, id int, v string")
    assert one(monitor.latest_per_entity(frame, "who", ["t", "id"]))["v"] == "b"


def test_fallback_for_missing_and_nan(spark):
    assert value(spark, monitor.fallback_score(F.lit(None).cast("double"))) == 0.1
    assert value(spark, monitor.fallback_score(F.lit(float("nan")))) == 0.1
    assert value(spark, monitor.fallback_score(F.lit(0.0))) == 0.0


# models


@pytest.mark.parametrize(("kind", "params"), [("logistic", {}), ("trees", {"maxIter": 3})])
def test_fitted_models_rank_well(spark, kind, params):
    frame = spark.range(300).select(
        F.array(F.sin("id"), F.cos("id")).alias("v"), (F.sin("id") > 0.3).cast("int").alias("y")
    )
    weights = splits.class_weights(frame, "y", (0, 1))
    model = scoring.fit_risk_model(
        scoring.labelled_vectors(frame, "v", "y", weights), kind, **params
    )
    scored = scoring.model_scores(model, scoring.labelled_vectors(frame, "v", "y"))
    assert one(metrics.areas(scored, "label", "p"))["auroc"] > 0.95


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        scoring.fit_risk_model(spark.range(1), "forest")


# sources


def test_schema_is_declared_not_inferred(spark):
    folder = work_folder(spark, "csv")
    spark.sql("SELECT 1 AS subject_id, 2.5D AS valuenum").write.option("header", True).csv(folder)
    rows = tables.read_table(spark, folder, "subject_id string, valuenum double", "csv")
    assert rows.dtypes == [("subject_id", "string"), ("valuenum", "double")]
    assert one(rows) == {"subject_id": "1", "valuenum": 2.5}
    with pytest.raises(ValueError):
        tables.read_table(spark, folder, "a int", "xml")


def test_hash_buckets_keep_the_number_of_folders_down(spark):
    rows = tables.hash_bucket(spark.range(1000), "id", 8)
    folder = work_folder(spark, "buckets")
    tables.write_table(rows, folder, partition_by=["bucket"])
    back = spark.read.parquet(folder)
    assert back.count() == 1000
    assert back.select("bucket").distinct().count() == 8


def test_manifest_in_one_file(spark):
    folder = work_folder(spark, "manifest")
    tables.write_manifest(spark.range(50).repartition(4), folder, ["id"], single_file=True)
    assert spark.read.csv(folder, header=True).select(F.input_file_name()).distinct().count() == 1


class FakeSession:
    def __init__(self, master, root=None):
        self.conf = {"spark.checkpoint.dir": root} if root else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_work_folder_is_in_the_shared_root():
    folder = work_folder(FakeSession("spark://host:7077", "hdfs:///shared/"), "x")
    assert folder.startswith("hdfs:///shared/x-")
    assert folder != work_folder(FakeSession("spark://host:7077", "hdfs:///shared/"), "x")


def test_a_cluster_without_a_shared_root_is_refused():
    with pytest.raises(ValueError):
        work_folder(FakeSession("yarn"), "x")
    assert "tidewatch-" in work_folder(FakeSession("local[2]"), "x")


# the catalogue


def test_limits_apply_to_their_fields(spark):
    names = list(c.LAB_RANGES)
    row = [low - 1.0 if n in ("ph", "lactate") else float(low) for n, (low, _) in c.LAB_RANGES.items()]
    frame = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
    broken = quality.broken_rules(quality.range_rules(c.LAB_RANGES))
    assert sorted(frame.select(broken).first()[0]) == ["lactate", "ph"]


def test_wide_pivot_over_the_item_lists(spark):
    items = [*c.LAB_ITEMS, *c.VITAL_ITEMS]
    assert len(set(items)) == len(items) == 58
    rows = spark.createDataFrame(
        [(1, 220181, 60.0), (1, 220181, 70.0), (1, 50912, 2.5), (1, 7, 1.0)],
        "who int, itemid int, valuenum double",
    )
    wide = buckets.pivot_mean(rows, ["who"], "itemid", "valuenum", items)
    pressure = buckets.coalesced_items(wide, {"map": [str(k) for k in c.MAP_ITEMS]})
    got = one(pressure)
    assert (got["map"], got["220052"], got["50912"]) == (65.0, None, 2.5)
    assert one(wide.select(x.step_score(c.ORGAN_RULES).alias("s")))["s"] == 2


# null groups, reversed stays, empty samples


def test_reversed_stays_are_kept_empty(spark):
    stays = spark.createDataFrame(
        [(1, 9, "2024-01-05", "2024-01-02"), (2, 9, "2024-01-01", "2024-01-03"), (3, 9, None, "2024-01-03")],
        "stay int, who int, b string, e string",
    ).withColumns({"b": F.to_timestamp("b"), "e": F.to_timestamp("e")})
    rows = spark.createDataFrame([(9, "2024-01-02 05:00:00", 1.0)], "who int, t string, v double")
    rows = rows.withColumn("t", F.to_timestamp("t"))
    got = cohort.within_stay(stays, rows, "who", "stay", "b", "e", "t").collect()
    assert {r["stay"]: r["v"] for r in got} == {1: None, 2: 1.0, 3: None}


def test_a_null_stay_with_rows_comes_once(spark):
    day = "timestamp'2024-01-01 0{}:00:00'"
    stays = spark.sql(
        f"SELECT 1 AS who, CAST(NULL AS INT) AS stay, {day.format(1)} AS b, {day.format(5)} AS e"
    )
    rows = spark.sql(f"SELECT 1 AS who, {day.format(2)} AS t, 3.0D AS v")
    got = cohort.within_stay(stays, rows, "who", "stay", "b", "e", "t").collect()
    assert [(r["stay"], r["v"]) for r in got] == [(None, 3.0)]


def test_spans_hold_each_day_of_a_stay_once(spark):
    starts = [-40, -1, 0, 5, 31, 32, 1000, 1023, 1024]
    lengths = [1, 2, 31, 32, 33, 64, 95, 700, 1024, 2048, 2049, 3653]
    frame = spark.createDataFrame(
        [(a, a + n - 1) for a in starts for n in lengths] + [(5, 4), (None, 4)], "a int, b int"
    )
    for used in ((1,), (1, 32), (1, 32, 1024)):
        rows = frame.withColumn("s", cohort._cover(F.col("a"), F.col("b"), used)).collect()
        for r in rows:
            if r["a"] is None or r["a"] > r["b"]:
                assert r["s"] is None
                continue
            days = [d for n, at in r["s"] for d in range(n * at, n * at + n)]
            assert sorted(days) == list(range(r["a"], r["b"] + 1))
            assert used != (1, 32, 1024) or len(r["s"]) < 150


def test_stays_of_hours_and_of_ten_years(spark):
    stays = spark.sql(
        "SELECT who, stay, CAST(b AS TIMESTAMP) AS b, CAST(e AS TIMESTAMP) AS e FROM VALUES "
        "(1, 1, '2014-03-05 07:30:00', '2024-03-04 10:00:00'), "
        "(1, 2, '2020-02-29 10:30:00', '2020-02-29 12:00:00'), "
        "(1, 3, '1965-01-01 00:00:00', '1970-06-01 00:00:00'), "
        "(2, 4, '2014-03-05 00:00:00', '2014-01-01 00:00:00') AS t(who, stay, b, e)"
    )
    rows = spark.sql(
        "SELECT 1 AS who, explode(sequence(timestamp'1964-12-01 07:00:00', "
        "timestamp'2024-04-01 00:00:00', interval 61 hours)) AS t"
    ).withColumn("v", F.unix_timestamp("t"))
    got = cohort.within_stay(stays, rows, "who", "stay", "b", "e", "t")
    want = stays.alias("s").join(
        rows.alias("r"),
        F.expr("s.who = r.who AND r.t BETWEEN date_trunc('hour', s.b) AND s.e"), "left",
    ).select("stay", "v")
    key = ["stay", F.coalesce("v", F.lit(-1)).alias("v")]
    found = sorted(tuple(r) for r in got.select(*key).collect())
    assert found == sorted(tuple(r) for r in want.select(*key).collect()) and len(found) > 2000


def test_drift_with_nothing_to_compare(spark):
    rows = spark.range(50).select(F.col("id").cast("double").alias("v"), F.lit(False).alias("c"))
    got = one(drift.ks_statistic(rows, "v", "c"))
    assert got["ks"] is None and got["critical"] is None and got["drift"] is False
    counts = drift.binned_counts(rows, "v", "c", (10, 20))
    assert one(drift.chi2_statistic(counts))["drift"] is False
    assert isinstance(one(drift.psi_statistic(counts))["drift"], bool)
    both = rows.withColumn("c", F.col("v") % 2 == 0)
    same_bin = drift.binned_counts(both, "v", "c", (1000,))
    got = one(drift.chi2_statistic(same_bin))
    assert got["dof"] == 0 and got["drift"] is False


def test_hash_parts_are_set_apart(spark):
    a, b = (
        value(spark, x.unit_hash(1, F.lit(p), F.lit(q))) for p, q in ((1, 23), (12, 3))
    )
    assert a != b
    assert value(spark, x.unit_hash(4, F.lit(21))) != value(spark, x.unit_hash(42, F.lit(1)))


def test_importance_does_not_depend_on_partitions(spark):
    frame = spark.range(500).select(
        "id", F.array(F.sin("id"), F.cos("id")).alias("v"), (F.sin("id") > 0.2).cast("int").alias("y")
    )

    def make():
        return lambda m: (m[:, 0] > 0).astype(float)

    got = [
        sorted(
            attribution.permutation_importance(
                frame.repartition(n), "id", "v", "y", make, 2, n_repeats=2, block_rows=64
            ).collect()
        )
        for n in (1, 8, 60)
    ]
    assert got[0] == got[1] == got[2]


def test_baselines_by_name(spark):
    frame = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "v array<double>")
    assert attribution.baseline_of(frame, "v", 2) == [0.0, 0.0]
    assert attribution.baseline_of(frame, "v", 2, "mean") == [2.0, 4.0]
    noise = attribution.baseline_of(frame, "v", 2, "gaussian_noise")
    assert noise == attribution.baseline_of(frame, "v", 2, "gaussian_noise") and noise != [0.0, 0.0]
    with pytest.raises(ValueError):
        attribution.baseline_of(frame, "v", 2, "other")


def test_bootstrap_of_areas_over_chunks(spark, monkeypatch):
    frame = spark.range(3000).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        ((F.col("id") * 7919 % 3001) / 3001 * 0.8 + F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.0)).alias("p"),
    )
    whole = {r["metric"]: r for r in metrics.bootstrap_ci(frame, "y", "p", n_resamples=200).collect()}
    monkeypatch.setattr(metrics, "SCORES_PER_TASK", 400)
    cut = {r["metric"]: r for r in metrics.bootstrap_ci(frame, "y", "p", n_resamples=200).collect()}
    for name in ("auroc", "average_precision", "accuracy"):
        for rows in (whole, cut):
            assert rows[name]["low"] < rows[name]["value"] < rows[name]["high"]
        width = [r[name]["high"] - r[name]["low"] for r in (whole, cut)]
        assert 0.6 < width[0] / width[1] < 1.6
