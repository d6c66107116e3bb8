import time

import oracle
from pyspark.sql import functions as F

from tidewatch.llm import line_templates as lt
from tidewatch.llm import queries_sql


def report(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lt.line_report(df).collect()}


def make(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", 0, 1) for i, t in rows],
        "doc_id long, text string, line string, line_no int, words int",
    ).repartition(3)


LOG = [
    (1, "login of user anna from host a7 at 10:04 done\nplain words that only this document has here"),
    (2, "login of user bert from host b3 at 11:59 done\nthe end"),
    (3, "unlike\nlogin of user carl from host zz9 at 00:00 done\nlast"),
    (4, "login of user dora from other place than those before here"),
    (5, "All rights reserved under the terms of this licence.\nshort line\nshort line"),
    (6, "short line\nAll rights reserved under the terms of this licence."),
    (7, None), (8, ""), (9, "\n\n"), (None, "All rights reserved under the terms of this licence."),
    (10, "12 34 56 78 90 11\n12 34 56 78 90 11"), (11, "12 34 56 78 90 12"),
    (12, "the very same line twice in one document\nthe very same line twice in one document"),
]


def test_variable_fields(spark):
    got = report(make(spark, LOG))
    # names vary in one position and hosts and times hold digits: one template, kept in document 1
    assert got[1] == (2, 0, LOG[0][1])
    assert got[2] == (2, 1, "the end")
    assert got[3] == (3, 1, "unlike\nlast")
    assert got[4] == (1, 0, LOG[3][1])
    # the row without an id comes first, so it holds the line
    assert got[None] == (1, 0, LOG[9][1])
    assert got[5] == (3, 1, "short line\nshort line")
    assert got[6] == (2, 1, "short line")
    assert got[7] == (1, 0, "") and got[8] == (1, 0, "") and got[9] == (3, 0, "\n\n")
    # lines of wildcards alone and lines within one document are left alone
    assert got[10][1] == got[11][1] == got[12][1] == 0


def test_against_sql(spark, sf_dir):
    import duckdb

    rows = [r for r in LOG if r[0] is not None]
    for k in range(100, 160):
        rows.append((k, f"user u{k} logged in by the console of site {'abc'[k % 3]}\nonly {k} here " + "w" * k))
        rows.append((k + 100, "a b c d e f " + " ".join("pqr"[(k * j) % 3] for j in range(6))))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    from pyspark.sql import functions as F

    got = lt.line_report(make(spark, rows)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")
    )
    assert oracle.difference(got.toPandas(), con.execute(queries_sql.LINES).df()) is None
    assert sum(r.n_dropped for r in got.collect()) > 60


def test_leaves_beyond_the_broadcast(spark, monkeypatch):
    want = report(make(spark, LOG))
    monkeypatch.setattr(lt, "BROADCAST_LEAVES", 0)
    assert report(make(spark, LOG)) == want


def test_stage(spark, odd, empty):
    docs = make(spark, LOG)
    kept = lt.without_recurring_lines(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got[2] == "the end" and got[7] is None and got[8] == ""
    # a document is only removed if all its words went
    copies = make(spark, [(1, "one two three four five six"), (2, "one two three four five six"), (3, "x")])
    assert sorted(r.doc_id for r in lt.without_recurring_lines(copies).collect()) == [1, 3]
    assert lt.without_recurring_lines(odd).count() == odd.count()
    assert lt.without_recurring_lines(empty).count() == 0


def test_lines_of_a_long_text_are_split_once(spark):
    """A text of many lines takes about as long as as many lines in short texts."""
    def seconds(texts, lines):
        first = (F.col("id") % 10).cast("string")
        text = F.concat(first, F.repeat(F.lit("\nline of words"), lines - 1))
        rows = spark.range(texts, numPartitions=1).select(text.alias("text"))
        left = lt.without_lines(F.col("text"), F.array(F.lit(1), F.lit(2)))
        start = time.perf_counter()
        assert rows.select(F.max(F.length(left))).first()[0] == 1 + 14 * (lines - 3)
        return time.perf_counter() - start

    seconds(200, 100)
    assert seconds(4, 5_000) < 5 * seconds(200, 100) + 1
