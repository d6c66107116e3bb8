"""Typed graphs over entity, stay and day nodes: edges, messages, pooling.

Nodes are ``(node_type, node, x…)`` rows, edges ``(edge_type, src_type, src,
dst_type, dst)`` rows; node features are plain columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expressions import leaky_relu
from tidewatch.operators.ordered import join_group_values
from tidewatch.session import Slices

EDGE = ["edge_type", "src_type", "src", "dst_type", "dst"]
KEY = ["dst", "dst_type"]  # the id first: it tells rows apart when they are sorted

ROWS_PER_SLICE = 5_000_000
MOST_SLICES = 8


def hierarchy_edges(
    stays: DataFrame, days: DataFrame, patient: str, stay: str, day: str, loops: dict[str, str],
) -> DataFrame:
    """Patient to stay, stay to day, and the day self-loops named in ``loops``.

    ``stays`` has one row per stay and ``days`` one per stay and day, with a
    boolean column for each kind of loop; all edges of a row come from one pass
    and need no duplicate removal.
    """

    upper = stays.select(
        F.lit("patient_to_stay").alias("edge_type"),
        F.lit("patient").alias("src_type"), F.col(patient).cast("string").alias("src"),
        F.lit("stay").alias("dst_type"), F.col(stay).cast("string").alias("dst"),
    )
    of, at = F.col(stay).cast("string"), F.col(day).cast("string")
    rows = [F.lit("stay_to_day"), F.lit("stay"), of, F.lit("day"), at, F.lit(True)]
    for kind, flag in loops.items():
        rows += [F.lit(kind), F.lit("day"), at, F.lit("day"), at, F.col(flag)]
    lower = days.select(F.stack(F.lit(1 + len(loops)), *rows).alias(*EDGE, "kept"))
    edges = upper.unionByName(lower.filter("kept").drop("kept"))
    return edges.filter("src is not null and dst is not null")


def with_reverse(edges: DataFrame) -> DataFrame:
    """The edges and their reverse ones; the edges are computed once."""
    turned = [F.concat(F.lit("rev_"), "edge_type"), "dst_type", "dst", "src_type", "src"]
    both = F.stack(
        F.lit(2), *EDGE, F.lit(True), *turned, F.col("src_type") != F.col("dst_type")
    )
    return edges.select(both.alias(*EDGE, "kept")).filter("kept").drop("kept")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Edges between different node types, turned round."""
    return edges.filter(F.col("src_type") != F.col("dst_type")).select(
        F.concat(F.lit("rev_"), "edge_type").alias("edge_type"),
        F.col("dst_type").alias("src_type"),
        F.col("dst").alias("src"),
        F.col("src_type").alias("dst_type"),
        F.col("src").alias("dst"),
    )


def gather(nodes: DataFrame, edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each edge with the features of its source node."""
    sources = nodes.select(
        F.col("node_type").alias("src_type"), F.col("node").alias("src"), *features
    )
    # explode makes edge lists look smaller to the planner than they are: never broadcast them
    return edges.hint("merge").join(sources, ["src", "src_type"])


def slice_count(rows: int) -> int:
    """How many slices a step over so many edges takes; what it keeps on disk falls with their number."""
    return min(MOST_SLICES, max(1, -(-rows // ROWS_PER_SLICE)))


def _dealt(df: DataFrame, node: str, kind: str, slices: int, purpose: str) -> Slices:
    """The rows in slices by hash of type and id of one of their nodes."""
    dealt = Slices(df.sparkSession, purpose)
    _deal(dealt, df, node, kind, slices)
    return dealt


def _deal(dealt: Slices, df: DataFrame, node: str, kind: str, slices: int) -> None:
    if slices == 1:
        dealt.write(0, df)
    else:
        number = F.xxhash64(F.col(node).cast("string"), F.col(kind).cast("string"))
        dealt.deal(df, F.pmod(number, F.lit(slices)).cast("int"))


def _passed_on(
    nodes: Slices,
    edges: Slices,
    features: Sequence[str],
    slices: int,
    received: Callable[[DataFrame, DataFrame], DataFrame],
    purpose: str,
    last: bool = True,
) -> Slices:
    """Sends the features along the edges; slices of what ``received`` makes of it.

    Messages are made for the sources of one slice after another and written to the slice of
    their destination, so shuffles only ever hold one slice. ``received`` gets the messages and
    the nodes of a slice, which are removed then; the edges are removed in the last step.
    """
    messages, done = Slices(edges.spark, "graph-messages"), Slices(edges.spark, purpose)
    for k in range(slices):
        sent = gather(nodes.read(k), edges.read(k), features).select(*KEY, *features)
        _deal(messages, sent, *KEY, slices)
        if last:
            edges.remove(k)
    for k in range(slices):
        done.write(k, received(messages.read(k), nodes.read(k)))
        messages.remove(k)
        nodes.remove(k)
    return done


def neighbor_sum(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], steps: int = 1
) -> DataFrame:
    """Sum of the neighbours' features over all in-edges; a node without any keeps its own.

    Between steps the features pass ``max(h, 0) + h``. Nodes and edges are read once, dealt to
    slices, and every step works slice by slice. Sums are combined before the shuffle, so a
    node with very many in-edges stays cheap.
    """
    if steps < 1:
        return nodes
    key = ["node_type", "node"]

    def received(messages: DataFrame, own: DataFrame) -> DataFrame:
        summed = messages.groupBy(
            F.col("dst_type").alias("node_type"), F.col("dst").alias("node")
        ).agg(*[F.sum(f).alias(f"_{f}") for f in features])
        return own.join(summed, ["node", "node_type"], "left").select(
            *key, *[F.coalesce(F.col(f"_{f}"), F.col(f)).alias(f) for f in features]
        )

    def between(messages: DataFrame, own: DataFrame) -> DataFrame:
        passed = {f: F.greatest(F.col(f), F.lit(0.0)) + F.col(f) for f in features}
        return received(messages, own).withColumns(passed)

    slices = slice_count(edges.count())
    of = _dealt(nodes.select(*key, *features), "node", "node_type", slices, "graph-nodes")
    along = _dealt(edges.select(*EDGE[1:]), "src", "src_type", slices, "graph-edges")
    for step in range(1, steps):
        of = _passed_on(of, along, features, slices, between, "graph-step", last=False)
    return _passed_on(of, along, features, slices, received, "graph-sums").read(*range(slices))


def neighbor_attention(
    nodes: DataFrame,
    edges: DataFrame,
    features: Sequence[str],
    src_score: str,
    dst_score: str,
    slope: float = 0.2,
    scope: str = "destination",
) -> DataFrame:
    """Weighted message sum per destination node.

    The weight is the softmax of the leaky-ReLU of both score columns, over the
    in-edges of each destination, or over all edges with ``scope="all"``: then weights are
    taken from each destination's best first, and their sums are brought to the best of all.
    Nodes and edges are read once, dealt to slices and worked on slice by slice.
    """
    if scope not in ("destination", "all"):
        raise ValueError(f"unknown scope: {scope}")
    kept = [*features] if src_score in features else [*features, src_score]
    of = nodes.select("node_type", "node", *dict.fromkeys([*kept, dst_score]))

    def received(messages: DataFrame, own: DataFrame) -> DataFrame:
        # the rule rises with the source score, so the best source gives the largest score
        best = messages.groupBy(*KEY).agg(F.max(src_score).alias("_best"))
        targets = own.select(
            F.col("node_type").alias("dst_type"), F.col("node").alias("dst"),
            F.col(dst_score).alias("_to"),
        ).join(best, KEY).withColumn("_top", leaky_relu(F.col("_best") + F.col("_to"), slope))
        if scope == "all":
            # rows of one node may differ in score, and its sums are brought to one value
            targets = targets.withColumn("_top", F.max("_top").over(Window.partitionBy(*KEY)))
        lowest = F.col("_top") == float("-inf")
        base = F.when(lowest, 0.0).otherwise(F.col("_top")) if scope == "all" else F.col("_top")
        score = leaky_relu(F.col(src_score) + F.col("_to"), slope)
        weighed = join_group_values(messages.hint("merge"), targets, KEY).withColumn(
            "_w", F.exp(score - base)
        )
        summed = weighed.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n_in"),
            F.max("_top").alias("_top"),
            F.sum("_w").alias("_mass"),
            *[F.sum(F.col("_w") * F.col(f)).alias(f) for f in features],
        ).withColumnsRenamed({"dst_type": "node_type", "dst": "node"})
        return summed if scope == "all" else shares(summed, F.col("_mass"))

    def shares(summed: DataFrame, mass: Column) -> DataFrame:
        return summed.select(
            "node_type", "node", "n_in", *[(F.col(f) / mass).alias(f) for f in features]
        )

    slices = slice_count(edges.count())
    done = _passed_on(
        _dealt(of, "node", "node_type", slices, "graph-nodes"),
        _dealt(edges.select(*EDGE[1:]), "src", "src_type", slices, "graph-edges"),
        kept, slices, received, "graph-attention",
    )
    summed = done.read(*range(slices))
    if scope == "destination":
        return summed
    part = F.exp(F.col("_top") - summed.agg(F.max("_top")).scalar())
    mass = summed.agg(F.sum(F.col("_mass") * part)).scalar()
    return shares(summed.withColumns({f: F.col(f) * part for f in features}), mass)


def graph_mean_pool(
    nodes: DataFrame, keys: Sequence[str], vector: str
) -> DataFrame:
    """Element-wise mean of the node vectors per graph, one row per element."""
    return (
        nodes.select(*keys, F.posexplode(vector).alias("pos", "x"))
        .groupBy(*keys, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("x").alias("n_nodes"))
    )
