"""Every query against its SQL twin, on the smallest tables."""

import oracle
import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE:
        assert oracle.difference(got, con.execute(ORACLE[name]).df()) is None
    else:
        assert len(got) > 0


def test_every_sql_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
