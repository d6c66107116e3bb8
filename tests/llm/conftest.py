import os
import sys

import pytest

from tidewatch.llm.base import documents

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_data import ODD  # noqa: E402


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """doc_id to text of the smallest documents table; null is empty."""
    return {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}




@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns whose names are those that operators use inside."""
    schema = "doc_id long, text string, lang string, source string, digest string, kept int, words int, fp string"
    rows = [(i, t, None, None, "d", 1, 2, "f") for i, t in ODD]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
