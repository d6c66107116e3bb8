"""Harmonic packing: every id in one piece, no padding, and the bins of a plain one over lists of ids."""

import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import harmonic, queries
from tidewatch.llm.base import documents

LIBRARY = Tokenizer.from_file(harmonic.WORD_TOKENIZER)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def plain(lengths, capacity):
    """Sequences as lists of (document, position), token by token."""
    done, classes, waiting = [], defaultdict(list), None
    for doc, n in enumerate(lengths):
        tokens = [(doc, i) for i in range(n)]
        if waiting is not None:
            while tokens and len(waiting) < capacity:
                waiting.append(tokens.pop(0))
            if len(waiting) == capacity:
                done.append(waiting)
                waiting = None
        while len(tokens) >= capacity:
            done.append(tokens[:capacity])
            tokens = tokens[capacity:]
        if not tokens:
            continue
        k = max(j for j in range(1, capacity + 1) if j * len(tokens) <= capacity)
        classes[k].append(tokens)
        if len(classes[k]) == k:
            full = [t for part in classes.pop(k) for t in part]
            if len(full) == capacity:
                done.append(full)
            else:
                waiting = full
    rest = (waiting or []) + [t for k in sorted(classes) for part in classes[k] for t in part]
    while len(rest) >= capacity:
        done.append(rest[:capacity])
        rest = rest[capacity:]
    while rest:
        size = 1
        while 2 * size <= len(rest):
            size *= 2
        done.append(rest[:size])
        rest = rest[size:]
    return done


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 40), max_size=60), capacity=st.sampled_from([1, 6, 16]))
def test_bins_are_those_of_plain_lists(lengths, capacity):
    bins = harmonic.HarmonicBins(capacity)
    got = []
    for doc, n in enumerate(lengths):
        got += bins.add(doc, packed(range(n)))
        # an open bin per class at most, each with fewer documents than its class closes with
        assert all(len(b.pieces) < k for k, b in bins.open.items())
    got += bins.close()
    spelled = [
        [(key, int.from_bytes(ids[4 * j : 4 * j + 4], "little"))
         for key, _, ids, _ in b.pieces for j in range(len(ids) // 4)]
        for b in got
    ]
    assert spelled == plain(lengths, capacity)
    assert all(len(s) == capacity or len(s) & len(s) - 1 == 0 for s in spelled)


def check(rows, docs, capacity):
    """rows of pieces against (doc_id, text) rows; ids of repeated doc_ids as multisets."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == capacity or at < capacity and at & at - 1 == 0
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(ids_of(t))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == want.keys()
    for i, several in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, several))
        if len(several) == 1:
            ids, at = several[0], 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(packed(ids[at : at + r.length]))
                at += r.length
            assert at == len(ids)


def test_query(spark, sf_dir, texts):
    rows = queries.QUERIES["op13_harmonic_packing"](spark, sf_dir).collect()
    check(rows, texts.items(), 4096)
    total = sum(len(ids_of(t)) for t in texts.values())
    workers = documents(spark, sf_dir).rdd.getNumPartitions()
    assert len({r.sequence_id for r in rows}) <= total // 4096 + 12 * workers


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_rows_and_sequences(spark, odd, parts):
    docs = odd.repartition(parts, "doc_id", "text")
    pieces = harmonic.pack_harmonic(docs, length=64, added_tokens=True)
    rows = pieces.collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    got = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in harmonic.sequences(pieces).collect()}
    want = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] += r.ids
    assert got == {k: (len(v) // 4, v) for k, v in want.items()}


def test_empty_table(spark, empty):
    assert harmonic.pack_harmonic(empty).count() == 0
