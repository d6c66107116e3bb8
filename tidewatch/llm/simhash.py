"""Near duplicates by SimHash with an inverted index on byte positions.

Two fingerprints of eight bytes that differ in at most two bits differ in at
most two bytes, so at least six positional bytes are the same. The eight
positions form four couples; whichever two bytes differ, two whole couples are
untouched. The index therefore lists each distinct fingerprint under its six
pairs of couples (four positional bytes each), and every link shares an entry.
Pairs of an entry are counted (shared positional bytes, six at least) and then
verified on their bits.

An entry with more than ``entry_limit`` fingerprints is not paired. There each
fingerprint is listed with every two of the entry's 32 free bits cleared;
fingerprints equal after that are within two bits of each other, so linking each
to the smallest of them keeps every connection at a cost linear in the entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.base import id_and_bytes, materialise

WORDS = 3
SEED = 42
ENTRY_LIMIT = 256
COUPLES = ((0, 1), (2, 3), (4, 5), (6, 7))
ENTRIES = [a + b for a, b in combinations(COUPLES, 2)]
BITS = 2
# shingles whose bits are unpacked at once: 64 bytes each
SHINGLES_AT_ONCE = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(words: list[bytes], size: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a word list, as a signed number."""
    if not words:
        return 0
    votes = np.zeros(64, np.int64)
    n = max(1, len(words) - size + 1)
    for start in range(0, n, SHINGLES_AT_ONCE):
        part = words[start : start + SHINGLES_AT_ONCE + size - 1]
        if len(words) < size:
            shingles = [b" ".join(words)]
        else:
            shingles = list(map(b" ".join, zip(*(part[k:] for k in range(size)))))
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8", len(shingles)
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS
) -> DataFrame:
    """``doc_id, fp``: one row per row; ``fp`` holds the 64 bits as a signed long."""
    return _fingerprinted(id_and_bytes(docs, doc_id, text), size)


def _fingerprinted(rows: DataFrame, size: int) -> DataFrame:
    """The columns before the last, which has the text in bytes, and ``fp``."""
    names = [*rows.columns[:-1], "fp"]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            found = [fingerprint_of(text.as_py().lower().split(), size) for text in texts]
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def _mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def shared_bytes(x: Column) -> Column:
    """How many of the eight positional bytes of ``a ^ b`` are zero."""
    return sum(
        (
            (F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(0xFF)) == 0).cast("int")
            for p in range(8)
        ),
        F.lit(0),
    )


def links(nodes: DataFrame, entry_limit: int = ENTRY_LIMIT) -> DataFrame:
    """Links ``a > b`` between distinct fingerprints ``fp`` that keep every connection.

    All pairs within two bits from entries up to ``entry_limit``; from larger ones
    each fingerprint with the smallest one of every set it shares.
    """
    entries = nodes.select(
        "fp",
        F.posexplode(F.array(*(F.lit(_mask(e)) for e in ENTRIES))).alias("entry", "mask"),
    ).select("fp", "entry", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = entries.groupBy("entry", "key").agg(F.count("*").alias("n")).where("n > 1")
    listed = materialise(entries.join(sizes, ["entry", "key"]), "simhash-index")

    small = listed.where(F.col("n") <= entry_limit).select("entry", "key", "fp")
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), ["entry", "key"])
        .where("a > b")
        .where(shared_bytes(x) >= 8 - BITS)
        .where(F.bit_count(x) <= BITS)
        .select("a", "b")
    )
    # 6 x 496 rows, whatever the data
    cleared = [
        (k, _signed(((1 << 64) - 1) ^ (1 << i) ^ (1 << j)))
        for k, kept in enumerate(ENTRIES)
        for i, j in combinations([b for b in range(64) if b // 8 not in kept], 2)
    ]
    masks = nodes.sparkSession.createDataFrame(cleared, "entry int, clear long")
    large = (
        listed.where(F.col("n") > entry_limit)
        .select("entry", "fp")
        .join(F.broadcast(masks), "entry")
        .select("entry", "clear", "fp", F.col("fp").bitwiseAND(F.col("clear")).alias("rest"))
    )
    centres = large.groupBy("entry", "clear", "rest").agg(F.min("fp").alias("b"))
    stars = (
        large.join(centres, ["entry", "clear", "rest"])
        .where(F.col("fp") > F.col("b"))
        .select(F.col("fp").alias("a"), "b")
    )
    return pairs.union(stars).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: every node of an edge with the smallest node it can reach.

    Alternates two star steps: larger neighbours move to the smallest neighbour,
    then smaller ones do, until nothing changes. Each round is written to the shared
    folder. Minima are combined before the shuffle and joined back, so a
    hub is a skewed join, which adaptive execution splits.
    """

    def step(now: DataFrame, larger: bool) -> DataFrame:
        near = now.union(now.select("b", "a")) if larger else now
        least = near.groupBy("a").agg(F.min("b").alias("low"))
        least = least.select("a", F.least("a", "low").alias("low"))
        moved = near.join(least, "a")
        if larger:
            out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
                least.select("a", F.col("low").alias("b"))
            )
        return out.where(F.col("a") > F.col("b")).distinct()

    def state(now: DataFrame) -> tuple:
        return tuple(
            now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        )

    now = materialise(
        edges.select(
            F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")
        ).where("a > b"),
        "components",
    )
    before, seen = None, state(now)
    while seen != before:
        before = seen
        now = materialise(step(step(now, True), False), "components")
        seen = state(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = WORDS,
    entry_limit: int = ENTRY_LIMIT,
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    ``component_id`` is the smallest id reachable over links of at most two
    bits; null ids are not counted, so it is null only where no id is known.
    Texts without a word have the fingerprint zero and link like any other.
    """
    rows = materialise(fingerprints(docs, doc_id, text, size), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), entry_limit))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns as they are.

    It is the row with the smallest id, null ids last, then the smallest hash of its
    text; of rows equal in id and text any one. Rows get a number once and are written with it,
    so the number names the same row whenever they are read.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    numbered = materialise(
        docs.select("*", F.monotonically_increasing_id().alias("__row")), "simhash-rows"
    )
    keyed = numbered.select(
        F.col("__row").alias("row"), F.col(doc_id).cast("long").alias("id"),
        F.xxhash64(value).alias("text_key"), value.cast("binary").alias("text"),
    )
    rows = materialise(_fingerprinted(keyed, WORDS), "simhash")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "row")
    nodes = materialise(rows.groupBy("fp").agg(F.min(key).alias("key")), "simhash-nodes")
    roots = components(links(nodes.select("fp")))
    kept = (
        nodes.join(roots, nodes.fp == roots.node, "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("key").alias("key"))
        .select(F.col("key.row").alias("__kept"))
    )
    return numbered.join(kept, numbered["__row"] == kept["__kept"], "left_semi").drop("__row")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their component, all columns as they are.

    Rows with one id stay or go together; rows without an id stay.
    """
    found = near_duplicates(docs, doc_id, text)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = kept.withColumnRenamed("doc_id", "__kept_id")
    held = docs.join(kept, docs[doc_id] == F.col("__kept_id"), "left_semi")
    return held.union(docs.where(F.col(doc_id).isNull()))
