"""Exact duplicates in three combining steps, each comparing whole contents.

1. Each task merges the equal texts of its own rows as they come.
2. What is left of a text meets by digest and salt; the salt is the task number
   modulo ``salts``, so even the copies of one text spread over ``salts`` groups.
3. The winners of the salts meet by digest.

A group never holds more rows than the tasks of its salt, then ``salts`` rows.
Ids of merged rows travel in the row that stands for them, at most as many as
one task held at once, so no copy has to be joined to its text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import id_and_bytes, materialise

SALTS = 16
HELD_BYTES = 32 << 20
ROW_BYTES = 100

LOCAL_SCHEMA = (
    "digest string, content binary, doc_id long, task long, run long, members array<long>"
)
_ARROW = pa.schema(
    [
        ("digest", pa.string()),
        ("content", pa.binary()),
        ("doc_id", pa.int64()),
        ("task", pa.int64()),
        ("run", pa.int64()),
        ("members", pa.list_(pa.int64())),
    ]
)


def _merge_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, run = TaskContext.get().partitionId(), 0
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal run
        columns: list[list] = [[], [], [], [], [], []]
        for content, ids in held.items():
            best = max(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
            ids[0], ids[best] = ids[best], ids[0]
            row = (hashlib.sha256(content).hexdigest(), content, ids[0], task, run, ids)
            for column, value in zip(columns, row):
                column.append(value)
            run += 1
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
        )

    for batch in batches:
        for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = held.get(content)
            if ids is None:
                held[content] = [doc_id]
                size += len(content) + ROW_BYTES
            else:
                ids.append(doc_id)
                size += 8
            if size >= HELD_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    The row with the largest id of equal texts stays; a null id is the smallest.
    If rows tie on that id, exactly one of them is kept. Null texts count as empty
    and equal the empty text.
    """
    local = id_and_bytes(docs, doc_id, text).mapInArrow(_merge_local, LOCAL_SCHEMA)
    local = local.select(
        "digest", "content", "members",
        F.struct("doc_id", "task", "run").alias("winner"),
        (F.col("task") % salts).alias("salt"),
    )
    same = Window.partitionBy("digest", "salt", "content")
    salted = local.select(
        "digest", "content", "members", "winner",
        F.max("winner").over(same).alias("salt_winner"),
        F.sum(F.size("members")).over(same).alias("salt_size"),
    )
    leads = (F.col("winner.task") == F.col("salt_winner.task")) & (
        F.col("winner.run") == F.col("salt_winner.run")
    )
    salted = materialise(
        salted.select(
            "digest", "members", "winner", "salt_winner", "salt_size",
            F.when(leads, F.col("content")).alias("content"),
            leads.alias("leads"),
        ),
        "exact-salted",
    )
    everywhere = Window.partitionBy("digest", "content")
    keepers = salted.where("leads").select(
        F.col("salt_winner.task").alias("to_task"),
        F.col("salt_winner.run").alias("to_run"),
        F.max("salt_winner").over(everywhere).alias("keep"),
        F.sum("salt_size").over(everywhere).alias("group_size"),
    )
    rows = salted.select(
        "digest", "members", "winner",
        F.col("salt_winner.task").alias("to_task"), F.col("salt_winner.run").alias("to_run"),
    ).join(keepers, ["to_task", "to_run"])
    stays = (F.col("winner.task") == F.col("keep.task")) & (
        F.col("winner.run") == F.col("keep.run")
    )
    return rows.select(
        F.posexplode("members").alias("at", "doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        stays.alias("stays"),
        F.col("digest").alias("text_sha256"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("stays") & (F.col("at") == 0)).alias("kept"),
        "text_sha256",
    )
