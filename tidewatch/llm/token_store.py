"""Token ids on disk: one zstandard frame per document, a shared dictionary, an offset index.

A store is a folder with two Parquet tables. ``dictionary`` holds the dictionary
and its hash. ``shards`` holds rows in ascending ``doc_id`` order: the frames of a
run of documents one after another in ``data``, and beside them the index: ids,
token counts, offsets, the place of each document among the ids of its task, the
width of an id and the dictionary's hash. Parquet only carries the bytes, so any
file system Spark can write to will do and a lost task is simply written again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.base import id_and_text, smallest_hashes
from tidewatch.llm.tokens import in_chunks, shared_encoder

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 0
LEVEL = 1
DICTIONARY_BYTES = 112_640
# the dictionary is fitted on this many documents at most, spread over all by a hash of the id
SAMPLE_DOCUMENTS = 1_000
SAMPLE_BYTES = 8 << 20
LEAST_SAMPLE = 64
SHARD_BYTES = 4 << 20
SHARD_DOCUMENTS = 8_192
READ_BYTES = 4 << 20

SHARDS = (
    "task long, shard long, first_doc long, last_doc long, width int, dictionary_sha256 string, "
    "doc_ids array<long>, starts array<long>, n_tokens array<long>, offsets array<long>, "
    "data binary"
)
_SHARDS = pa.schema(
    [
        ("task", pa.int64()), ("shard", pa.int64()), ("first_doc", pa.int64()),
        ("last_doc", pa.int64()), ("width", pa.int32()), ("dictionary_sha256", pa.string()),
        ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
        ("data", pa.binary()),
    ]
)
_IDS = pa.schema(
    [
        ("task", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
        ("n_tokens", pa.int64()), ("ids", pa.binary()),
    ]
)


def _narrow(packed: bytes, width: int) -> bytes:
    ids = np.frombuffer(packed, "<u4")
    return ids.astype("<u2").tobytes() if width == 2 else packed


def _wide(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw


def train_dictionary(
    docs: DataFrame,
    tokenizer: str = BYTE_TOKENIZER,
    end: int = END,
    size: int = DICTIONARY_BYTES,
    sample_documents: int = SAMPLE_DOCUMENTS,
    width: int = 2,
    added_tokens: bool = False,
) -> bytes:
    """A dictionary over serialized ids of at most ``sample_documents`` documents.

    The sample is the documents with the smallest hash of their id. One task
    encodes them and fits the dictionary; only the dictionary reaches the driver. Too
    few documents give an empty one, with which frames stand alone.
    """
    closing = end.to_bytes(4, "little")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, False, added_tokens)
        samples, held = [], 0
        for batch in batches:
            for _, part in in_chunks(batch):
                for packed in encoder.encode(part):
                    if held < SAMPLE_BYTES:
                        samples.append(_narrow(packed + closing, width))
                        held += len(samples[-1])
        fitted = b""
        if len(samples) >= LEAST_SAMPLE and held > 8 * 1024:
            try:
                fitted = zstandard.train_dictionary(min(size, held // 8), samples).as_bytes()
            except zstandard.ZstdError:
                fitted = b""  # samples too alike or too short for a dictionary
        yield pa.RecordBatch.from_arrays([pa.array([fitted], pa.binary())], names=["dictionary"])

    ids = id_and_text(docs).select("doc_id", F.xxhash64("doc_id").alias("order"))
    chosen = smallest_hashes(ids, "order", sample_documents, docs.count()).select("doc_id").distinct()
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text")
    found = texts.repartition(1).mapInArrow(fit, "dictionary binary").collect()
    return bytes(found[0]["dictionary"]) if found else b""


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str = BYTE_TOKENIZER,
    end: int = END,
    level: int = LEVEL,
    doc_id: str = "doc_id",
    text: str = "text",
    added_tokens: bool = False,
) -> None:
    """Encode and write all documents in ascending id order; null ids come first.

    Rows that share an id follow each other in the order of their text's hash. A
    null text is an empty one and holds the end id alone. ``added_tokens`` as in
    ``WordEncoder``.
    """
    rows = id_and_text(docs, doc_id, text)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(rows, tokenizer, end, width=width, added_tokens=added_tokens)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark = docs.sparkSession
    spark.createDataFrame(
        [(digest, bytearray(dictionary), width)], "sha256 string, bytes binary, width int"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    closing = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, False, added_tokens)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=level)
        frames = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        task, shard, place = TaskContext.get().partitionId(), 0, 0
        ids, starts, counts, offsets, data = [], [], [], [0], []

        def flush() -> pa.RecordBatch:
            nonlocal shard
            known = [i for i in ids if i is not None]
            row = (
                task, shard, min(known, default=None), max(known, default=None), width, digest,
                list(ids), list(starts), list(counts), list(offsets), b"".join(data),
            )
            shard += 1
            for held in (ids, starts, counts, data):
                held.clear()
            offsets[:] = [0]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, _SHARDS)], schema=_SHARDS
            )

        for batch in batches:
            for keys, texts in in_chunks(batch):
                for key, packed in zip(keys, encoder.encode(texts)):
                    packed += closing
                    frame = frames.compress(_narrow(packed, width))
                    ids.append(key)
                    starts.append(place)
                    counts.append(len(packed) // 4)
                    place += counts[-1]
                    data.append(frame)
                    offsets.append(offsets[-1] + len(frame))
                    if offsets[-1] >= SHARD_BYTES or len(ids) >= SHARD_DOCUMENTS:
                        yield flush()
        if ids:
            yield flush()

    tie = F.xxhash64("text")
    (
        rows.repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(run, SHARDS)
        .write.mode("overwrite")
        .option("compression", "none")
        .parquet(f"{path}/shards")
    )


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["sha256"], bytes(row["bytes"])


def read_store(
    spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None
) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, or of the given ids only.

    ``ids`` are little-endian unsigned 32-bit. ``start`` counts the ids of all
    documents before. With ``doc_ids`` only shards that can hold them are read and only
    their frames are unpacked. A store whose dictionary does not match its
    hash is refused.
    """
    digest, dictionary = _dictionary(spark, path)
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary of {path} does not match its hash")
    wanted = None if doc_ids is None else set(doc_ids)
    shards = spark.read.parquet(f"{path}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        frames = zstandard.ZstdDecompressor(dict_data=shared)
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _IDS)]
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, schema=_IDS)

        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1).to_pylist()[0]
                if row["dictionary_sha256"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                at, data = row["offsets"], memoryview(row["data"])
                for k, key in enumerate(row["doc_ids"]):
                    if wanted is None or key in wanted:
                        raw = _wide(frames.decompress(data[at[k] : at[k + 1]]), row["width"])
                        out.append((row["task"], key, row["starts"][k], row["n_tokens"][k], raw))
                        held += len(raw)
                    if held >= READ_BYTES:
                        yield flush()
        if out:
            yield flush()

    # one row per writing task
    totals = shards.groupBy("task").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n)).alias("total")
    )
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    if wanted is not None:
        some = F.lit(False)
        for key in sorted(wanted):
            some = some | F.lit(key).between(F.col("first_doc"), F.col("last_doc"))
        shards = shards.where(some)
    columns = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in _IDS)
    return (
        shards.mapInArrow(run, columns)
        .join(F.broadcast(places), "task")
        .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
    )
