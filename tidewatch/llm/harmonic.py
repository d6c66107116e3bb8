"""Token sequences filled by length classes, each worker by itself and without a shuffle.

Lengths fall into reciprocal-capacity classes: class k holds what fits k times into a
sequence but not k + 1 times. A bin of class k takes exactly k documents. The room they
leave is at once filled with the head of the next document, whose rest is then classed
anew; so a sequence that closes is full. When the input ends, the bins that still wait
for documents, one per class at most, are cut anew into full sequences and, for what is
left, sequences of a power of two. No sequence of this kind needs padding, so nothing is padded.

A worker packs the rows of its split in their order: which documents share a sequence
depends on the split, that every id lies in one piece does not. Between batches it
holds the open bins, fewer than 2 * sqrt(length) sequences of ids. A task that is lost is packed again as a whole.

Null texts count as empty and hold the end id alone; null and repeated doc_ids go
through like others, each row as a document of its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import id_and_text
from tidewatch.llm.packing import WORD_TOKENIZER
from tidewatch.llm.tokens import in_chunks, shared_encoder

LENGTH = 4096
END = 2
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)
_PIECES = pa.schema(
    [(name.split()[0], pa.binary() if name.endswith("binary") else pa.int64())
     for name in PIECES.split(", ")]
)
# rows and bytes of ids handed on at once
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20


class Bin:
    """The pieces of one sequence: (doc_id, start, ids, doc_tokens), ids as bytes."""

    def __init__(self, length: int) -> None:
        self.space = length
        self.pieces: list[tuple] = []

    def put(self, key: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        self.pieces.append((key, start, ids, doc_tokens))
        self.space -= len(ids) // 4


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class HarmonicBins:
    """One open bin per class, and at most one closed bin whose room waits for the next document."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.open: dict[int, Bin] = {}
        self.roomy: Bin | None = None

    def add(self, key: int | None, ids: bytes) -> Iterator[Bin]:
        """Takes one document; gives the bins that it fills."""
        n, at = len(ids) // 4, 0

        def cut(size: int) -> tuple:
            nonlocal at
            at += size
            return key, at - size, ids[4 * (at - size) : 4 * at], n

        if self.roomy:
            self.roomy.put(*cut(min(self.roomy.space, n)))
            if not self.roomy.space:
                yield self.roomy
                self.roomy = None
        while n - at >= self.length:
            whole = Bin(self.length)
            whole.put(*cut(self.length))
            yield whole
        if at < n:
            k = self.length // (n - at)
            held = self.open.setdefault(k, Bin(self.length))
            held.put(*cut(n - at))
            if len(held.pieces) == k:
                del self.open[k]
                if held.space:
                    self.roomy = held
                else:
                    yield held

    def close(self) -> Iterator[Bin]:
        """What is still held, cut anew: full bins, then bins of a power of two."""
        held = [self.roomy] if self.roomy else []
        held += [self.open[k] for k in sorted(self.open)]
        total = sum(self.length - b.space for b in held)
        sizes = [self.length] * (total // self.length) + powers_of_two(total % self.length)
        sizes.reverse()
        current = None
        for key, start, ids, n in (piece for b in held for piece in b.pieces):
            at = 0
            while 4 * at < len(ids):
                current = current or Bin(sizes.pop())
                size = min(current.space, len(ids) // 4 - at)
                current.put(key, start + at, ids[4 * at : 4 * (at + size)], n)
                at += size
                if not current.space:
                    yield current
                    current = None
        self.open, self.roomy = {}, None


def pack_harmonic(
    docs: DataFrame,
    length: int = LENGTH,
    end: int = END,
    tokenizer: str = WORD_TOKENIZER,
    lowered: bool = True,
    added_tokens: bool = False,
    with_ids: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids.

    ``ids`` are little-endian unsigned 32-bit, null without ``with_ids``. ``added_tokens`` and
    ``lowered`` as in ``WordEncoder``.
    """
    closing = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, lowered, added_tokens)
        bins = HarmonicBins(length)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def filled() -> Iterator[Bin]:
            for batch in batches:
                for keys, texts in in_chunks(batch):
                    for key, ids in zip(keys, encoder.encode(texts)):
                        yield from bins.add(key, ids + closing)
            yield from bins.close()

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

        for done in filled():
            offset = 0
            for key, start, ids, n in done.pieces:
                size = len(ids) // 4
                rows.append(
                    (key, start, size, zlib.crc32(ids), n, sequence, offset,
                     ids if with_ids else None)
                )
                offset += size
            sequence += 1
            held += 4 * offset
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield flush()
        if rows:
            yield flush()

    return id_and_text(docs, doc_id, text).mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the pieces of each sequence joined in their order.

    A sequence holds at most ``length`` pieces, so its group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # hex keeps the bytes; binary has no concatenation over arrays
    joined = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        (F.length(joined) / 8).cast("long").alias("n_tokens"),
        F.unhex(joined).alias("ids"),
    )
