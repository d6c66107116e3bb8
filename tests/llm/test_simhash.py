import random

import xxhash
from conftest_data import ODD

from tidewatch.llm import simhash


def fp_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(fps):
    """Smallest reachable id of each (id, fingerprint) over links of two bits or fewer."""
    distinct = sorted(set(f for _, f in fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted([(i, f, least.get(find(f))) for i, f in fps], key=repr)


def got_of(df):
    return sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()], key=repr)


def test_documents(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)
    want = classes_by_hand([(i, fp_by_hand(t)) for i, t in texts.items()])
    assert got_of(simhash.near_duplicates(docs)) == want


def test_odd_rows(odd):
    want = classes_by_hand([(i, fp_by_hand(t)) for i, t in ODD])
    assert got_of(simhash.near_duplicates(odd)) == want


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    text = " ".join(random.Random(1).choices("abcdefgh", k=100))
    assert simhash.fingerprint_of(text.encode().split()) % (1 << 64) == fp_by_hand(text)


def test_links_in_small_and_large_entries(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            f = centre
            for b in rnd.sample(range(64), rnd.choice((0, 1, 1, 2, 2, 3))):
                f ^= 1 << b
            fps.add(f)
    fps |= {0, 3, (1 << 63) | 1}
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    want = {r[1]: r[2] for r in classes_by_hand([(f, f) for f in fps])}
    for limit in (256, 6, 0):
        edges = simhash.links(nodes, entry_limit=limit)
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        if limit == 256:
            every = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
            assert {frozenset(p) for p in pairs} == every
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
        for f in fps:
            for g in fps:
                assert (roots.get(f, f) == roots.get(g, g)) == (want[f] == want[g])


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    got = simhash.components(edges).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


def test_stage_keeps_one_of_each(spark, odd):
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted([r.doc_id for r in kept.collect()], key=repr)
    want = {c for i, _, c in classes_by_hand([(i, fp_by_hand(t)) for i, t in ODD]) if i is not None}
    assert set(ids) - {None} == want and ids.count(None) == 2


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.first_of_each(empty).columns == empty.columns
