"""Ids of the queries against the tokenizers library with its files as they are."""

import zlib

from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import packing, token_store
from tidewatch.llm.base import documents
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.tokens import WordEncoder

ROWS = [
    (1, "see <|endoftext|> here"), (2, "see <|ENDOFTEXT|> here"), (3, "plain <|endoftext|"),
    (4, "<|startoftext|>Two<|endoftext|><|endoftext|>  ends\n"), (5, "世界 <|endoftext|> é"), (6, None),
]


def untouched(path):
    library = Tokenizer.from_file(path)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_queries_give_the_ids_of_the_library(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for tokenizer, name in (
        (token_store.BYTE_TOKENIZER, "op7_token_binary_output"),
        (packing.WORD_TOKENIZER, "op10_best_fit_packing"),
    ):
        library = untouched(tokenizer)
        want = {i: zlib.crc32(packed(library(t))) for i, t in ROWS}
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.doc_id: r.ids_crc32 for r in got} == want
    stage = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    got = stage(spark, documents(spark, str(tmp_path)), str(tmp_path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want


def test_given_documents(texts):
    for path, lowered in ((token_store.BYTE_TOKENIZER, False), (packing.WORD_TOKENIZER, True)):
        mine, library = WordEncoder(path, lowered, added_tokens=True), untouched(path)
        some = list(texts.values())[:60]
        some += [t[: len(t) // 2] + "<|endoftext|>" + t[len(t) // 2 :] for t in some]
        assert [p + packed([0]) for p in mine.encode(some)] == [packed(library(t)) for t in some]


def test_only_the_sample_moves_to_the_task_that_fits(spark, texts, monkeypatch):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    fed, whole = [], type(docs).mapInArrow

    def kept(self, *args, **options):
        fed.append(self)
        return whole(self, *args, **options)

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    assert token_store.train_dictionary(docs)
    assert fed[-1].rdd.getNumPartitions() == 1
    assert "Coalesce 1" not in fed[-1]._jdf.queryExecution().executedPlan().toString()
