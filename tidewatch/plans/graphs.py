"""Entity, stay and day graphs from customers, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import graph
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import query
from tidewatch.session import Slices


def _days(spark, d):
    """One row per order and shipping day."""
    lines = i.table(spark, d, "lineitem")
    return lines.groupBy("l_orderkey", "l_shipdate").agg(
        F.sum("l_quantity").alias("quantity"),
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_or(F.col("l_returnflag") == "R").alias("lab"),
        F.bool_or(F.col("l_linestatus") == "O").alias("vital"),
    )


def _named(days):
    name = F.concat_ws(
        "@", F.col("l_orderkey").cast("string"), F.to_date("l_shipdate").cast("string")
    )
    return days.withColumn("day", name)


def edges(spark, d, days=None):
    stays = i.table(spark, d, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("l_orderkey")
    )
    return graph.hierarchy_edges(
        stays, _named(_days(spark, d) if days is None else days), "o_custkey", "l_orderkey", "day",
        {"has_lab": "lab", "has_vital": "vital"},
    )


def nodes(spark, d, grouped):
    """Nodes with two features; the first also serves as attention score."""
    def of(kind, node, x0, x1):
        return (F.lit(kind).alias("node_type"), node.cast("string").alias("node"),
                x0.alias("x0"), x1.cast("double").alias("x1"))

    patients = i.table(spark, d, "customer").select(
        *of("patient", F.col("c_custkey"), F.col("c_acctbal") / 10000, F.lit(1))
    )
    stays = i.table(spark, d, "orders").select(
        *of("stay", F.col("o_orderkey"), F.col("o_totalprice") / 500000, F.lit(1))
    )
    days = _named(grouped).select(
        *of("day", F.col("day"), F.col("quantity") / 50, F.col("n_lines"))
    )
    return patients.unionByName(stays).unionByName(days)


DAYS_SQL = (
    "days AS (SELECT *, l_orderkey::VARCHAR || '@' || strftime(l_shipdate, '%Y-%m-%d') AS day "
    "FROM lineitem)"
)
EDGES_SQL = (
    f"WITH {DAYS_SQL}, edges AS (SELECT DISTINCT 'patient_to_stay' AS edge_type, "
    "'patient' AS src_type, o_custkey::VARCHAR AS src, 'stay' AS dst_type, "
    "o_orderkey::VARCHAR AS dst FROM orders "
    "UNION ALL SELECT DISTINCT 'stay_to_day', 'stay', l_orderkey::VARCHAR, 'day', day FROM days "
    "UNION ALL SELECT DISTINCT 'has_lab', 'day', day, 'day', day FROM days "
    "WHERE l_returnflag = 'R' "
    "UNION ALL SELECT DISTINCT 'has_vital', 'day', day, 'day', day FROM days "
    "WHERE l_linestatus = 'O'), rev AS (SELECT 'rev_' || edge_type AS edge_type, "
    "dst_type AS src_type, dst AS src, src_type AS dst_type, src AS dst FROM edges "
    "WHERE src_type <> dst_type), whole AS (SELECT * FROM edges UNION ALL SELECT * FROM rev)"
)
NODES_SQL = (
    f"{EDGES_SQL}, nodes AS (SELECT 'patient' AS node_type, c_custkey::VARCHAR AS node, "
    "c_acctbal / 10000 AS x0, 1.0::DOUBLE AS x1 FROM customer UNION ALL SELECT 'stay', "
    "o_orderkey::VARCHAR, o_totalprice / 500000, 1.0 FROM orders UNION ALL SELECT 'day', day, "
    "sum(l_quantity) / 50, count(*)::DOUBLE FROM days GROUP BY day)"
)


@query("graph_edges", f"{EDGES_SQL} SELECT * FROM edges")
def graph_edges(spark, d):
    return edges(spark, d)


@query("graph_reverse_edges", f"{EDGES_SQL} SELECT * FROM rev")
def graph_reverse_edges(spark, d):
    return graph.reverse_edges(edges(spark, d))


def _graph(spark, d):
    """Nodes and edges with the reverse ones; the line items are read once and their days written."""
    kept = Slices(spark, "graph-days")
    kept.write(0, _days(spark, d))
    days = kept.read(0)
    return nodes(spark, d, days), graph.with_reverse(edges(spark, d, days))


@query(
    "neighbor_sum",
    f"{NODES_SQL}, s AS (SELECT dst_type, dst, sum(x0) AS x0, sum(x1) AS x1 FROM whole "
    "JOIN nodes ON src_type = node_type AND src = node GROUP BY 1, 2) "
    "SELECT node_type, node, round(coalesce(s.x0, n.x0), 9) + 0.0 AS x0, "
    "round(coalesce(s.x1, n.x1), 9) AS x1 FROM nodes n LEFT JOIN s "
    "ON n.node_type = dst_type AND n.node = dst",
)
def neighbor_sum(spark, d):
    rows = graph.neighbor_sum(*_graph(spark, d), ["x0", "x1"])
    return i.finished(rows, 9)


@query(
    "neighbor_sum_two_steps",
    f"{NODES_SQL}, s AS (SELECT dst_type, dst, sum(x0) AS x0, sum(x1) AS x1 FROM whole "
    "JOIN nodes ON src_type = node_type AND src = node GROUP BY 1, 2), "
    "one AS (SELECT node_type, node, coalesce(s.x0, n.x0) AS a, coalesce(s.x1, n.x1) AS b "
    "FROM nodes n LEFT JOIN s ON n.node_type = dst_type AND n.node = dst), "
    "h AS (SELECT node_type, node, greatest(a, 0) + a AS x0, greatest(b, 0) + b AS x1 FROM one), "
    "s2 AS (SELECT dst_type, dst, sum(x0) AS x0, sum(x1) AS x1 FROM whole "
    "JOIN h ON src_type = node_type AND src = node GROUP BY 1, 2) "
    "SELECT node_type, node, round(coalesce(s2.x0, h.x0), 9) + 0.0 AS x0, "
    "round(coalesce(s2.x1, h.x1), 9) AS x1 FROM h LEFT JOIN s2 "
    "ON h.node_type = dst_type AND h.node = dst",
)
def neighbor_sum_two_steps(spark, d):
    rows = graph.neighbor_sum(*_graph(spark, d), ["x0", "x1"], steps=2)
    return i.finished(rows, 9)


ATTENTION_SQL = (
    f"{NODES_SQL}, e AS (SELECT dst_type, dst, a.x0, a.x1, CASE WHEN a.x0 + b.x0 > 0 "
    "THEN a.x0 + b.x0 ELSE 0.2 * (a.x0 + b.x0) END AS score FROM whole "
    "JOIN nodes a ON src_type = a.node_type AND src = a.node "
    "JOIN nodes b ON dst_type = b.node_type AND dst = b.node)"
)


@query(
    "neighbor_attention",
    f"{ATTENTION_SQL}, w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY dst_type, dst)) "
    "AS w FROM e) SELECT dst_type AS node_type, dst AS node, count(*) AS n_in, "
    "round(sum(w * x0) / sum(w), 9) + 0.0 AS x0, round(sum(w * x1) / sum(w), 9) AS x1 FROM w "
    "GROUP BY 1, 2",
)
def neighbor_attention(spark, d):
    rows = graph.neighbor_attention(*_graph(spark, d), ["x0", "x1"], "x0", "x0")
    return i.finished(rows, 9)


@query(
    "neighbor_attention_global",
    f"{ATTENTION_SQL}, w AS (SELECT *, exp(score - max(score) OVER ()) AS w FROM e), "
    "t AS (SELECT sum(w) AS total FROM w) SELECT dst_type AS node_type, dst AS node, "
    "count(*) AS n_in, round(sum(w * x0) / max(total) * 1e6, 4) + 0.0 AS x0, "
    "round(sum(w * x1) / max(total) * 1e6, 4) AS x1 FROM w CROSS JOIN t GROUP BY 1, 2",
)
def neighbor_attention_global(spark, d):
    rows = graph.neighbor_attention(*_graph(spark, d), ["x0", "x1"], "x0", "x0", scope="all")
    return i.finished(
        rows.withColumn("x0", F.col("x0") * 1e6).withColumn("x1", F.col("x1") * 1e6), 4
    )


@query(
    "graph_mean_pool",
    "WITH v AS (SELECT label, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE AS x "
    "FROM embeddings) SELECT label, pos, round(avg(x), 8) + 0.0 AS mean, count(*) AS n_nodes "
    "FROM v GROUP BY 1, 2",
)
def graph_mean_pool(spark, d):
    rows = graph.graph_mean_pool(i.table(spark, d, "embeddings"), ["label"], "embedding")
    return i.finished(rows, 8)
