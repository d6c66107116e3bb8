"""The Merkle manifest against plain lists of digests; the query against its SQL twin."""

import hashlib
import zlib
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle, queries
from tidewatch.llm.ranks import ranked

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, lo int, level int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    parts = []
    for v in values:
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha("".join(parts))


def first_nulls(v):
    return (v is not None, v if v is not None else "")


def tree(digests, fanout):
    """The root, and for every digest its siblings as (left, right) pairs per level."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, at in enumerate(places):
            start = at // fanout * fanout
            paths[leaf].append((digests[start:at], digests[at + 1 : start + fanout]))
        digests = [sha("".join(digests[i : i + fanout])) for i in range(0, len(digests), fanout)]
        places = [at // fanout for at in places]
    return digests[0], paths


def plain(rows, fanout):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        other = (*r[:3], r[3] + 1, r[4]) if hit else r
        groups[r[2]].append((first_nulls(r[0]), leaf_of(r), leaf_of(other), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[1] for r in sorted(groups[g])], fanout) for g in names}
    root, above = tree([trees[g][0] for g in names], fanout)
    out = []
    for g, upper in zip(names, above):
        subroot, paths = trees[g]
        for (_, leaf, other, doc_id), path in zip(sorted(groups[g]), paths):
            held, proof = other, ""
            for left, right in path + upper:
                held = sha("".join([*left, held, *right]))
                proof += "".join([*left, *right])
            out.append((doc_id, leaf, subroot, root, sha(proof), held, held == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)


def tampered():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def built(docs, fanout, band):
    found = merkle.checked(merkle.manifest(docs, changed=tampered(), fanout=fanout, band=band))
    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.select(*names).collect()), key=repr)


def made(n):
    langs = [None, "en", "en", "en", "", "é", "zz"]
    rows = [
        (i, "s" if i % 3 else None, langs[i * i % 7], None if i % 11 == 0 else i, f"text {i % 5} é")
        for i in range(n)
    ]
    return rows + [(None, None, None, None, None), (None, "s", "en", 1, ""), (3, "s", "en", 3, "twin")]


@pytest.mark.parametrize("fanout,band,n", [(2, 2, 60), (3, 1, 40), (2, 8, 130), (5, 2, 33)])
def test_trees_are_those_of_plain_lists(spark, tmp_path, fanout, band, n):
    rows = made(n) + made(n)[4:9]  # some rows twice
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert built(docs, fanout, band) == plain(rows, fanout)


@pytest.mark.parametrize("rows", [
    [(1, "s", "en", 5, "one")], [(1, "s", None, None, None), (2, None, "de", 3, "x")],
    [(7, "s", "en", 5, "same")] * 9, [(i, "s", "en", i, "") for i in range(17)],
])
def test_small_tables(spark, rows):
    docs = frame(spark, rows)
    assert built(docs, 2, 2) == plain(rows, 2)


def test_empty_table(spark):
    found = merkle.manifest(frame(spark, [(1, "s", "en", 5, "one")]).limit(0))
    assert found.root is None and merkle.checked(found).count() == 0


def test_intervals_cover_the_leaves(spark):
    found = merkle.manifest(frame(spark, [(i, "s", "en", i, "") for i in range(21)]), band=2)
    nodes = [r for part in found.groups.nodes for r in part.collect()]
    levels = defaultdict(list)
    for r in nodes:
        levels[r.level].append((r.lo, r.hi))
    assert sorted(levels) == [1, 2, 3, 4, 5]
    for level, spans in levels.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == 21
        assert all(a[1] == b[0] and a[1] - a[0] == 2**level for a, b in zip(spans, spans[1:]))


def test_query_equals_the_twin(spark, sf_dir):
    name = "op11_merkle_manifest"
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.difference(got, oracle.connect(sf_dir).execute(queries.ORACLE[name]).df()) is None
    assert (~got["verified"]).any() and got["verified"].any()


def test_ranks_of_groups_over_several_ranges(spark, tmp_path):
    rows = [(None if i % 3 else i % 2, i % 5 if i % 7 else None, i) for i in range(300)]
    spark.createDataFrame(rows, "g long, k long, v long").repartition(5).write.parquet(str(tmp_path / "r"))
    got = ranked(spark.read.parquet(str(tmp_path / "r")), ["g"], ["k"], "test-ranks").collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append(r)
    assert sum(map(len, groups.values())) == 300
    for members in groups.values():
        members.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in members] == list(range(len(members)))
        assert all(r["size"] == len(members) for r in members)
        keys = [first_nulls(r.k) for r in members]
        assert [k[0] for k in keys] == sorted(k[0] for k in keys)
        assert [k[1] for k in keys if k[0]] == sorted(k[1] for k in keys if k[0])
