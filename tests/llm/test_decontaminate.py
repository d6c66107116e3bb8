import random
import re

import pytest
from conftest_data import ODD

from tidewatch.llm import decontaminate as dec
from tidewatch.llm.base import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(docs, items):
    known = {}
    for item, text in items:
        ws = words(text)
        n = min(len(ws), dec.WINDOW)
        for i in range(len(ws) - n + 1 if n else 0):
            known.setdefault(tuple(ws[i : i + n]), set()).update([str(item)] if item is not None else [])
    lengths = {len(k) for k in known}
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in known:
                    hit |= set(range(i, i + n))
                    found |= known[tuple(ws[i : i + n])]
        out.append((doc, len(ws), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away"),
    (2, "short item"), (3, None), (4, ""), (5, "..."), (10, "Two WORDS"), (11, "two words"),
    (12, "The quick brown fox jumps over the lazy dog and"), (None, "ünï cödé İtem"),
]
DOCS = ODD + [
    (20, "x the quick, brown FOX jumps over the lazy dog and runs far. Off it went: short item!"),
    (21, "quick brown fox jumps over the lazy dog"),
    (22, "short item short item short short item ünï cödé İtem"),
    (22, "other text with short\nitem"),
    (23, "(the quick brown fox jumps over the lazy dog and the quick brown fox jumps over the "
         "lazy dog and)"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(
        [(i, t, None, "w", 1) for i, t in DOCS], "doc_id long, text string, lang string, words string, n int"
    )
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return docs.repartition(3), items


@pytest.mark.parametrize("bits", [dec.BITMAP_BITS, 64])
def test_odd_rows(tables, bits):
    docs, items = tables
    assert rows(dec.contamination(docs, items, bits=bits)) == by_hand(DOCS, ITEMS)


def test_beyond_the_broadcast(tables, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", 1)
    assert rows(dec.contamination(*tables)) == by_hand(DOCS, ITEMS)


def test_random_texts(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choices("abc", k=rnd.randint(1, 14)))) for i in range(6)]
    docs = [(i, " ".join(rnd.choices("abcd", k=rnd.randint(0, 400)))) for i in range(60)]
    got = dec.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert rows(got) == by_hand(docs, items)


def test_documents(spark, sf_dir):
    docs, items = documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert rows(dec.contamination(docs, items)) == want
    assert any(r[5] for r in want)


def test_stage_cuts_spans(tables):
    docs, items = tables
    kept = dec.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    dirty = {(r[0], r[1]) for r in by_hand(DOCS, ITEMS) if r[5]}
    got = {(r.doc_id, r.text) for r in kept.collect()}
    for i, t in DOCS:
        if (i, len(words(t))) not in dirty:
            assert (i, t) in got
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert by_id[20] == "x Off it went: "
    assert by_id[23] == "("
    assert by_id[21] == DOCS[len(ODD) + 1][1]


def test_stage_drops_documents(tables):
    docs, items = tables
    kept = dec.clean(docs, items, whole_documents=True)
    dirty = [r for r in by_hand(DOCS, ITEMS) if r[5]]
    assert kept.count() == len(DOCS) - len(dirty)


def test_spans_merge(spark):
    from pyspark.sql import functions as F

    text = "a b c d e f g h"
    spans = [(2, 2), (3, 2), (6, 1), (7, 2)]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<at:int,n:int>>")
    got = df.select(
        dec.covered(F.col("spans")), dec.without_spans(F.col("text"), F.col("spans"))
    ).first()
    assert got[0] == 6 and got[1] == "a e "


def test_empty(tables, empty):
    docs, items = tables
    assert dec.contamination(empty, items).count() == 0
    none = dec.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none)
    assert dec.clean(docs, items.limit(0)).count() == len(DOCS)
