import hashlib
from collections import defaultdict

from conftest_data import ODD

from tidewatch.llm import exact_dedup


def by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(odd):
    got = exact_dedup.exact_groups(odd).collect()
    assert sorted(
        [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr
    ) == by_hand(ODD)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_hot_group_over_many_tasks_and_small_buffers(spark, monkeypatch):
    rows = [(i, "same" if i % 3 else f"text {i // 6}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = exact_dedup.exact_groups(docs, salts=4).collect()
    assert sorted(
        [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr
    ) == by_hand(rows)
    assert sum(r.kept for r in got) == len({t for _, t in rows})


def test_empty_table(empty):
    got = exact_dedup.exact_groups(empty)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.count() == 0
