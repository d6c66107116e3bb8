import zlib

import pytest
from conftest_data import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import packing, token_store
from tidewatch.llm.tokens import WordEncoder

KINDS = [(token_store.BYTE_TOKENIZER, False), (packing.WORD_TOKENIZER, True)]


def plain(path):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True

    def ids(text):
        return library.encode(text, add_special_tokens=False).ids

    return ids


@pytest.fixture(scope="module")
def pairs():
    return [(WordEncoder(p, low), plain(p)) for p, low in KINDS]


def unpack(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


LATIN = st.text(st.sampled_from(" \n'abcsvtredmlABZ019éßÀžœĲ²½ª¡¿.,-_!$<|>endoftx"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(LATIN, st.text(max_size=40)))
def test_words_give_the_library_ids(pairs, text):
    for mine, library in pairs:
        assert unpack(next(mine.encode([text]))) == library(text)


def test_a_small_cache_gives_the_same(texts):
    for path, low in KINDS:
        mine, library = WordEncoder(path, low, cached=50), plain(path)
        some = list(texts.values())[:40]
        assert [unpack(p) for p in mine.encode(some)] == [library(t) for t in some]


def ids_by_hand(rows, path):
    library = plain(path)
    return [(i, library(t or "") + [0]) for i, t in rows]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_store_round_trip(spark, odd, texts, tmp_path):
    more = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    for k, (docs, rows) in enumerate(((odd, ODD), (more, list(texts.items())))):
        path = str(tmp_path / f"store-{k}")
        token_store.write_store(docs, path)
        got = token_store.read_store(spark, path).collect()
        want = ids_by_hand(rows, token_store.BYTE_TOKENIZER)
        assert sorted(((r.doc_id, unpack(bytes(r.ids))) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r.n_tokens == len(r.ids) // 4 for r in got)
        place = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == place
            place += r.n_tokens
        known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
        assert known == sorted(known)


def test_store_short_access_and_damage(spark, texts, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    token_store.write_store(docs, path)
    some = sorted(texts)[3:40:7]
    whole = {r.doc_id: (r.start, bytes(r.ids)) for r in token_store.read_store(spark, path).collect()}
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in token_store.read_store(spark, path, some).collect()}
    assert got == {i: whole[i] for i in some}
    # raw frames and dictionary take less room than the ids
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert sum(len(r.data) for r in shards) < sum(len(b) for _, b in whole.values()) / 2
    spark.createDataFrame([("0" * 64, bytearray(b"x"), 2)], "sha256 string, bytes binary, width int").write.mode(
        "overwrite"
    ).parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        token_store.read_store(spark, path)


def test_store_empty(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    token_store.write_store(empty, path)
    assert token_store.read_store(spark, path).count() == 0


def check_packing(got, rows, length):
    want = {}
    for i, ids in ids_by_hand(rows, packing.WORD_TOKENIZER):
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want.setdefault((i, k, at, len(part), crc(part)), []).append(1)
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert found == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        place = 0
        for offset, n in sorted(parts):
            assert offset == place
            place += n
        assert place <= length
    return len(by)


def test_packing(spark, odd, texts):
    check_packing(packing.pack_documents(odd).collect(), ODD, packing.LENGTH)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    got = packing.pack_documents(docs).collect()
    n = check_packing(got, list(texts.items()), packing.LENGTH)
    total = sum(r.length for r in got)
    assert n <= -(-total // packing.LENGTH) * 1.05 + 1
    # the split of the input does not matter
    again = packing.pack_documents(docs.repartition(2)).collect()
    assert sorted(got) == sorted(again)
    check_packing(packing.pack_documents(docs, text_per_task=40_000).collect(), list(texts.items()), 2048)


def test_sequences_hold_the_ids(spark, odd):
    pieces = packing.token_pieces(odd, length=64)
    packed = packing.pack(pieces, 2, length=64)
    rows = packing.sequences(packed, pieces).collect()
    total = sum(len(ids) for _, ids in ids_by_hand(ODD, packing.WORD_TOKENIZER))
    assert sum(r.n_tokens for r in rows) == total
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * 64 for r in rows)


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_best_fit_against_a_plain_list(lengths, room):
    bins, offsets = packing.best_fit(lengths, 20, room)
    open_, n = {}, 0
    for k, x in enumerate(lengths):
        fits = [s for s in open_.values() if s >= x]
        if fits:
            space = min(fits)
            assert open_.get(bins[k]) == space
        else:
            assert bins[k] == n
            space, n = 20, n + 1
        assert offsets[k] == 20 - space
        open_.pop(bins[k], None)
        if space > x:
            if len(open_) == room:
                least = min(open_.values())
                # ties close the one that was filled to this level last, as the stack has it
                last = [b for b in open_ if open_[b] == least][-1]
                open_.pop(last)
            open_[bins[k]] = space - x


def test_few_long_documents_are_several_tasks(spark):
    rows = [(k, f"word{k} and {k} " * 4_000) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = packing.pack_documents(docs, length=64, text_per_task=100_000).collect()
    check_packing(found, rows, 64)
    tasks = {r.sequence_id >> 40 for r in found}
    assert len(tasks) >= 5


def test_packing_in_small_batches_is_the_same(spark, texts):
    docs = documents_frame(spark, texts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(tuple, packing.pack_documents(docs).collect()), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, packing.pack_documents(docs).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def documents_frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)


def test_words_with_signs_are_kept_once():
    """Word by word what the library gives, and no chunk for single words."""
    text = "It says word word. word, word; 'word' word7 ª. naïve! ½. x² end\n. a.\nb don't. end' . ."
    for path, low in KINDS:
        mine = WordEncoder(path, low)
        assert unpack(next(mine.encode([text]))) == plain(path)(text)
        assert not {" word", " word.", " word,", "word", "word.", "word,"} & set(mine._chunks)
