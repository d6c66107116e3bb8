"""The near-duplicate stage keeps one row of each group, whatever the ids."""

import random

from conftest_data import ODD
from test_simhash import classes_by_hand, fp_by_hand

import corpus_pipeline

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
SCHEMA = "doc_id long, text string, source string"


def prose(seed):
    return " ".join(random.Random(seed).choices("alpha beta gamma delta epsilon zeta eta".split(), k=60))


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, f"s{k}") for k, r in enumerate(rows)], SCHEMA).repartition(4)
    found = STAGE(spark, docs, "")
    assert found.columns == docs.columns
    return sorted([(r.doc_id, r.text) for r in found.collect()], key=repr)


def test_null_ids_repeated_rows_and_shared_ids(spark):
    a, b, c, d = map(prose, range(4))
    rows = [(None, a)] * 5 + [(7, a)] + [(None, b)] * 4 + [(3, c)] * 3 + [(3, d), (1, d), (9, c)]
    assert kept(spark, rows) == sorted([(7, a), (None, b), (3, c), (1, d)], key=repr)


def test_one_row_of_each_group(spark):
    rnd = random.Random(3)
    rows = ODD + [(rnd.choice((None, 1, 20, 21, 22)), prose(rnd.randint(0, 6))) for _ in range(80)]
    # a number for every row, in the order of the ids with nulls last, tells the group's first row
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    groups = {}
    for n, _, first in classes_by_hand([(n, fp_by_hand(rows[k][1])) for n, k in enumerate(order)]):
        groups.setdefault(first, []).append(rows[order[n]])
    got = kept(spark, rows)
    assert len(got) == len(groups)
    assert sorted([i for i, _ in got], key=repr) == sorted([rows[order[n]][0] for n in groups], key=repr)
