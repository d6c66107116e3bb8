"""Documents cut into token pieces and packed by bounded-space online best-fit.

Pieces come in a fixed pseudo-random order and go to the open bin with the
least free space that still holds them. Open bins are found through a bitset with
one bit per amount of free space. At most ``open_bins`` are open; when one more is
needed the fullest closes first. Ids never move: packing sees one row of a few
numbers per piece.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import id_and_text
from tidewatch.llm.tokens import in_chunks, shared_encoder

LENGTH = 2048
OPEN_BINS = 512
# text of one packing task, some 200,000 documents
TEXT_PER_TASK = 400 << 20
END = 0
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PACKED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "sequence_id long, offset long"
)


def token_pieces(
    docs: DataFrame,
    tokenizer: str = WORD_TOKENIZER,
    lowered: bool = True,
    length: int = LENGTH,
    end: int = END,
    with_ids: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """One row per piece of a document's ids, the end id included.

    Only documents longer than ``length`` are cut, at multiples of it. ``ids``
    holds little-endian unsigned 32-bit ids, or null if not asked for. An empty
    text is one piece with the end id alone. ``added_tokens`` as in ``WordEncoder``.
    """
    closing = end.to_bytes(4, "little")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
            ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, lowered, added_tokens)
        for batch in batches:
            for ids, texts in in_chunks(batch):
                rows = []
                for key, packed in zip(ids, encoder.encode(texts)):
                    packed += closing
                    for k, at in enumerate(range(0, len(packed), 4 * length)):
                        part = packed[at : at + 4 * length]
                        rows.append(
                            (key, k, at // 4, len(part) // 4, zlib.crc32(part),
                             part if with_ids else None)
                        )
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return id_and_text(docs, doc_id, text).mapInArrow(run, PIECES)


def placed(
    lengths: Iterable[int], length: int, open_bins: int
) -> Iterator[tuple[int, int]]:
    """The bin and the offset of each piece as it comes, bins numbered as they open."""
    bits = 0
    by_space: list[list[int]] = [[] for _ in range(length + 1)]
    n_open = opened = 0
    for n in lengths:
        if not 0 < n <= length:
            raise ValueError(f"a piece has {n} tokens, a sequence at most {length}")
        fitting = bits >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                bits ^= 1 << space
            n_open -= 1
        else:
            at, space = opened, length
            opened += 1
        yield at, length - space
        if space > n:
            if n_open == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_space[fullest].pop()
                if not by_space[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            by_space[space - n].append(at)
            bits |= 1 << (space - n)
            n_open += 1


def best_fit(lengths: Iterable[int], length: int, open_bins: int) -> tuple[list[int], list[int]]:
    """The bins and the offsets of all pieces."""
    found = list(placed(lengths, length, open_bins))
    return [b for b, _ in found], [o for _, o in found]


def pack(
    pieces: DataFrame,
    tasks: int,
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; the ids are left behind.

    Rows are dealt to ``tasks`` by a hash of id and piece and packed in that order
    within each, so the result does not depend on how the input was split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        waiting: deque[pa.RecordBatch] = deque()

        def lengths() -> Iterator[int]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield from batch.column(3).to_pylist()

        places = placed(lengths(), length, open_bins)
        for place in places:
            batch = waiting.popleft()
            found = [place, *islice(places, batch.num_rows - 1)]
            bins, offsets = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bins + first), pa.array(offsets)],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    deal = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
        .repartition(tasks, deal)
        .sortWithinPartitions(deal, "doc_id", "piece", "ids_crc32")
        .mapInArrow(run, PACKED)
    )


def pack_documents(
    docs: DataFrame,
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    text_per_task: int = TEXT_PER_TASK,
    added_tokens: bool = False,
    **columns: str,
) -> DataFrame:
    """Tokenizes and packs whole documents.

    The number of packing tasks follows the bytes of text, which the pieces follow whatever the
    length of a document. A task passes batches on as it places them and holds the open bins.
    """
    size = docs.agg(F.sum(F.octet_length(columns.get("text", "text")))).first()[0] or 0
    tasks = max(1, math.ceil(size / text_per_task))
    pieces = token_pieces(
        docs, length=length, with_ids=False, added_tokens=added_tokens, **columns
    )
    return pack(pieces, tasks, length, open_bins)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the pieces of each sequence joined in order.

    A sequence holds at most ``length`` pieces, so its group is small.
    """
    keys = ["doc_id", "piece", "ids_crc32"]
    left, right = packed.alias("l"), pieces.select(*keys, "ids").dropDuplicates(keys).alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    parts = left.join(right, same).select("sequence_id", F.struct("offset", "ids").alias("part"))
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    # hex keeps the bytes; binary has no concatenation over arrays
    joined = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    return ordered.select(
        "sequence_id",
        (F.length(joined) / 8).cast("long").alias("n_tokens"),
        F.unhex(joined).alias("ids"),
    )
