"""A Merkle manifest of a table: digests of rows, trees per group, one root, and a proof per row.

Every row is a leaf. Within a group leaves are ranked by key, and nodes carry the
interval [lo, hi) of leaf ranks they cover: a node of level L covers ``fanout ** L`` leaves, the
last one of a level fewer. All leaves of a group lie at the same depth, as a last run of
one is digested like any other. The roots of the groups, ordered by group, make one more
tree with the manifest's root.

Levels are handled in bands of ``BAND``. A band's nodes under one node of its top
level are made from one array, so a task holds ``fanout ** BAND`` digests at most. Ancestors
are attached by a containment join per band: an item meets, at each level, the node whose interval
holds its own, found through the bucket its rank falls in at that level. A node's siblings are what
its parent's interval covers without the node's own. Items of the next band are the tops of this one,
so the rows shrink by ``fanout ** BAND`` from band to band and there are as many rounds as bands.

Null fields are written as ``-``; a null group is a group, the first one; rows with a null or
repeated key are leaves like others, ordered by digest where keys tie. An empty table has
no root. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import materialise
from tidewatch.llm.ranks import ranked, same_group

FANOUT = 2
BAND = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP, KEY = "lang", "doc_id"
_STEPS = "array<struct<level: int, left: array<binary>, right: array<binary>>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else byte count, colon and value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        written = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(written, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hex(digests: Column) -> Column:
    """Digests as hex text, one after another."""
    return F.lower(F.array_join(F.transform(digests, F.hex), ""))


def _no_steps() -> Column:
    return F.array().cast(_STEPS)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's hex digest and its siblings."""
    return F.aggregate(
        path, leaf, lambda held, s: F.sha2(F.concat(_hex(s["left"]), held, _hex(s["right"])), 256)
    )


def path_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(_hex(F.flatten(F.transform(path, lambda s: F.concat(s["left"], s["right"])))), 256)


def _depth(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a group of n."""
    powers = F.array(*[F.lit(fanout**k) for k in range(63) if fanout**k < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n))


def _runs_digested(below: Column, fanout: int) -> Column:
    """The digest of every ``fanout`` consecutive hex digests, in order."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
    return F.transform(
        runs, lambda j: F.sha2(F.array_join(F.slice(below, j * fanout + 1, fanout), ""), 256)
    )


def _level(base: int, k: int, fanout: int) -> Column:
    """The nodes of level ``base + k`` from the digests in ``a<k>`` and those below."""
    width = fanout ** (base + k - 1)

    def node(digest: Column, j: Column) -> Column:
        lo = F.col("start") + j * F.lit(width * fanout)
        children = F.transform(F.slice(f"a{k - 1}", j * fanout + 1, fanout), F.unhex)
        return F.struct(
            F.lit(base + k).alias("level"), lo.alias("lo"),
            F.least(lo + width * fanout, F.col("n")).alias("hi"),
            F.lit(width).cast("long").alias("width"), F.unhex(digest).alias("digest"),
            children.alias("children"),
        )

    return F.transform(f"a{k}", node)


def _band_nodes(items: DataFrame, base: int, fanout: int, band: int) -> DataFrame:
    """``g, n, level, lo, hi, width, digest, children`` of the band above level ``base``.

    ``items`` are the nodes of that level: ``g, n, lo, digest``. ``width`` is the number of leaves
    a child covers.
    """
    unit = fanout**base
    block = F.expr(f"lo div {unit * fanout**band}L")
    run = F.array_sort(F.collect_list(F.struct("lo", "digest")))
    blocks = items.groupBy("g", "n", block.alias("block")).agg(run.alias("run")).select(
        "g", "n", _depth(F.col("n"), fanout).alias("depth"),
        (F.col("block") * (unit * fanout**band)).alias("start"),
        F.transform("run", lambda r: F.lower(F.hex(r["digest"]))).alias("a0"),
    )
    for k in range(1, band + 1):
        above = _runs_digested(F.col(f"a{k - 1}"), fanout)
        blocks = blocks.withColumn(f"a{k}", F.when(F.col("depth") >= base + k, above))
    levels = [_level(base, k, fanout) for k in range(1, band + 1)]
    nodes = F.explode(F.flatten(F.array_compact(F.array(*levels))))
    return blocks.select("g", "n", nodes.alias("v")).select("g", "n", "v.*")


def _paths(items: DataFrame, nodes: DataFrame, base: int, fanout: int, band: int) -> DataFrame:
    """``g, lo, path``: per item of level ``base`` its siblings at each level of the band.

    The containment join. Buckets make it an equal join on group, level and the place of the
    rank at that level; a bucket has one node.
    """
    def bucket(lo: str, level: str) -> Column:
        spans = F.array(*[F.lit(fanout ** (base + k)).cast("long") for k in range(1, band + 1)])
        return F.floor(F.col(lo) / F.element_at(spans, F.col(level) - base)).cast("long")

    highest = F.least(F.lit(base + band), _depth(F.col("n"), fanout))
    wanted = (
        items.where(highest > base)
        .select("g", "lo", F.explode(F.sequence(F.lit(base + 1), highest)).alias("level"))
        .withColumn("bucket", bucket("lo", "level")).alias("l")
    )
    held = nodes.withColumn("bucket", bucket("lo", "level")).alias("r")
    contained = (F.col("r.lo") <= F.col("l.lo")) & (F.col("l.lo") < F.col("r.hi"))
    joined = wanted.join(held, same_group("l", "r", ["g", "level", "bucket"]) & contained)

    def siblings(outside) -> Column:
        """Children whose part of the parent's interval lies outside the item's own."""
        return F.filter(
            "r.children",
            lambda c, t: outside(F.col("r.lo") + t * F.col("r.width"), F.col("r.width")),
        )

    step = F.struct(
        F.col("l.level"),
        siblings(lambda lo, width: lo + width <= F.col("l.lo")).alias("left"),
        siblings(lambda lo, width: lo > F.col("l.lo")).alias("right"),
    )
    found = joined.select(F.col("l.g").alias("g"), F.col("l.lo").alias("lo"), step.alias("step"))
    path = F.array_sort(F.collect_list("step"))
    return found.groupBy("g", "lo").agg(path.alias("path"))


@dataclass
class Forest:
    """``nodes`` above the leaves, per band; ``roots``: ``g, digest``; ``paths``: the leaves with
    their siblings from the leaf level up to the group's root."""

    nodes: list[DataFrame]
    roots: DataFrame
    paths: DataFrame


def forest(leaves: DataFrame, fanout: int = FANOUT, band: int = BAND) -> Forest:
    """Trees over ``leaves`` (``g, n, lo, digest`` and more columns), one per group."""
    highest = leaves.agg(F.max("n")).first()[0] or 0
    depth = next(k for k in range(64) if fanout**k >= highest)
    bands, items, found = [], [leaves.select("g", "n", "lo", "digest")], []
    for base in range(0, depth, band):
        nodes = materialise(_band_nodes(items[-1], base, fanout, band), "merkle-nodes")
        bands.append(base)
        found.append(nodes)
        more = (F.col("level") == base + band) & (_depth(F.col("n"), fanout) > base + band)
        items.append(nodes.where(more).select("g", "n", "lo", "digest"))
    roots = leaves.where("n = 1").select("g", "digest")
    for nodes in found:
        tops = nodes.where(F.col("level") == _depth(F.col("n"), fanout))
        roots = roots.unionAll(tops.select("g", "digest"))

    upper = None
    for base, held, nodes in reversed(list(zip(bands, items, found))):
        paths = _paths(held, nodes, base, fanout, band)
        if upper is not None:  # of the node at the top of this band that covers the item
            top = F.expr(f"lo - lo % {fanout ** (base + band)}L")
            low, high = paths.withColumn("top", top).alias("l"), upper.alias("r")
            above = F.col("l.top") == F.col("r.lo")
            paths = low.join(high, same_group("l", "r", ["g"]) & above, "left").select(
                F.col("l.g"), F.col("l.lo"),
                F.concat("l.path", F.coalesce("r.path", _no_steps())).alias("path"),
            )
        upper = paths
        if base:
            upper = materialise(paths, "merkle-paths")
    if upper is None:  # no group has two leaves
        return Forest(found, roots, leaves.withColumn("path", _no_steps()))
    left, right = leaves.alias("l"), upper.alias("r")
    same = same_group("l", "r", ["g", "lo"])
    paths = left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in leaves.columns],
        F.coalesce("r.path", _no_steps()).alias("path"),
    )
    return Forest(found, roots, paths)


@dataclass
class Manifest:
    """``groups``: ``g, digest`` roots of the groups. ``root``: hex digest, None without rows.
    ``rows``: one per leaf: ``g, key, leaf, changed, subroot, path``, the path up to the root."""

    groups: Forest
    root: str | None
    rows: DataFrame


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = GROUP, key: str = KEY,
    changed: dict[str, Column] | None = None, fanout: int = FANOUT, band: int = BAND,
) -> Manifest:
    """``changed`` gives other values of some fields; the rows then carry the digest of those
    too, in ``changed``, null where it is the same."""
    leaf = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([(changed or {}).get(f, F.col(f)) for f in fields])
    digests = docs.select(
        F.col(group).alias("g"), F.col(key).alias("key"), F.unhex(leaf).alias("digest"),
        (F.unhex(other) if changed else F.lit(None).cast("binary")).alias("changed"),
    ).withColumn("changed", F.nullif("changed", "digest"))
    ranks = ranked(digests, ["g"], ["key", "digest"], "merkle-leaves", "lo", "n")
    leaves = materialise(ranks, "merkle-ranks")
    groups = forest(leaves, fanout, band)

    roots = materialise(groups.roots, "merkle-roots")
    top = ranked(roots.withColumnRenamed("g", "key"), [], ["key"], "merkle-groups", "lo", "n")
    whole = forest(
        materialise(top.withColumn("g", F.lit(0)), "merkle-tops"), fanout, band
    )
    root = whole.roots.select(F.lower(F.hex("digest"))).first()
    above = materialise(whole.paths.select("key", "digest", "path"), "merkle-group-paths")
    low, high = groups.paths.alias("l"), above.alias("r")
    rows = low.join(high, F.col("l.g").eqNullSafe(F.col("r.key"))).select(
        "l.g", "l.key", F.lower(F.hex("l.digest")).alias("leaf"),
        F.lower(F.hex("l.changed")).alias("changed"),
        F.lower(F.hex("r.digest")).alias("subroot"), F.concat("l.path", "r.path").alias("path"),
    )
    return Manifest(groups, root[0] if root else None, rows)


def checked(found: Manifest) -> DataFrame:
    """Every row with the root folded from its changed, else its own, digest, and whether it holds."""
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    root = F.lit(found.root).cast("string")
    return found.rows.select(
        "g", "key", "leaf", "subroot", root.alias("root"), path_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
