"""The pipeline against plain Python, stage by stage, on a small table."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_decontaminate import words
from test_language_id import learned_by_hand, predict_by_hand
from test_simhash import classes_by_hand, fp_by_hand
from test_tokens import check_packing

import corpus_pipeline
from tidewatch.llm import decontaminate, line_templates
from tidewatch.llm.base import documents

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def rows():
    rnd = random.Random(8)
    vocabulary = ["der", "die", "und", "haus", "the", "of", "and", "house", "el", "casa", "que", "le"]

    def prose(n):
        return " ".join(rnd.choices(vocabulary, k=n)).capitalize() + "."

    out = []
    for i in range(40):
        text = "\n".join(prose(rnd.randint(12, 40)) for _ in range(rnd.randint(1, 4)))
        out.append((i, text, "de" if i % 2 else "en", f"src{i % 3}", len(text)))
    out += [
        (40, out[3][1], "de", "copy", 0), (41, out[3][1] + " more", "de", "near", 0),
        (42, None, None, None, None), (43, "", "en", "x", 0), (44, "1234 5678 !!", "en", "x", 12),
        (45, f"{prose(20)}\nSee {PASSAGE}, it said. {prose(9)}", "en", "leak", 0),
        (46, "All rights reserved by the owner of this text 2024\n" + prose(25), "en", "x", 0),
        (47, "All rights reserved by the owner of this text 2025\n" + prose(25), "en", "x", 0),
        (48, out[5][1], "de", "copy", 0), (None, prose(30), "en", "no id", 0),
    ]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows(), schema).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder


def without_lines(docs):
    """Recurring templates kept in the first document only, in plain Python."""
    parsed = {}
    for d, text, *_ in docs:
        for k, line in enumerate((text or "").split("\n")):
            ws = re.split(r"[ \t\n\x0b\f\r]+", re.sub(r"[^\s0-9]*[0-9]\S*", "<*>", line, flags=re.ASCII))
            ws = tuple(w for w in ws if w)
            if len(ws) >= line_templates.LEAST_WORDS and 2 * sum(w != "<*>" for w in ws) >= len(ws):
                parsed[d, k] = ws
    count, leaf = {}, {}
    for ws in parsed.values():
        count[ws] = count.get(ws, 0) + 1
        leaf.setdefault((len(ws), ws[:3]), set()).add(ws)
    support = {}
    for ws, n in count.items():
        for k, w in enumerate(ws):
            support[len(ws), ws[:3], k, w] = support.get((len(ws), ws[:3], k, w), 0) + n
    template = {}
    for ws in count:
        template[ws] = ws
        if len(leaf[len(ws), ws[:3]]) > 1:
            own = [support[len(ws), ws[:3], k, w] for k, w in enumerate(ws)]
            usual = sorted(own[3:])[int(len(own[3:]) * line_templates.VARYING)]
            template[ws] = tuple(
                "<*>" if k >= 3 and usual > 1 and own[k] * 2 < usual else w for k, w in enumerate(ws)
            )
    holders = {}
    for (d, _), ws in parsed.items():
        holders.setdefault((len(ws), ws[:3], template[ws]), set()).add((d is not None, d or 0))
    out = []
    for row in docs:
        d, text = row[:2]
        lines = (text or "").split("\n")
        kept = [
            line for k, line in enumerate(lines)
            if (d, k) not in parsed
            or min(holders[len(parsed[d, k]), parsed[d, k][:3], template[parsed[d, k]]]) == (d is not None, d or 0)
        ]
        if len(kept) == len(lines):
            out.append(row)
        elif re.search(r"\S", "\n".join(kept)):
            out.append((d, "\n".join(kept), *row[2:]))
    return out


def test_stages_against_plain_python(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    docs, plain = documents(spark, sf), rows()

    def check(name, want):
        nonlocal docs
        before = docs
        docs = stages[name](spark, docs, sf)
        assert docs.columns == before.columns
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr)

    profiles = learned_by_hand([(r[2], r[1]) for r in plain])
    plain = [r for r in plain if predict_by_hand(r[1], profiles)[0] != "und"]
    assert len(plain) == len(rows()) - 3
    check("language_id", plain)

    plain = without_lines(plain)
    assert {40, 48} & {r[0] for r in plain} == set()
    assert not any("2025" in r[1] for r in plain)
    check("line_dedup", plain)

    classes = classes_by_hand([(r[0], fp_by_hand(r[1])) for r in plain])
    first = {c for _, _, c in classes}
    plain = [r for r in plain if r[0] is None or r[0] in first]
    check("simhash_near_dedup", plain)

    plain = [
        (*r[:1], re.sub("alpha beta.*omicron, ", "", r[1]), *r[2:]) if r[0] == 45 else r for r in plain
    ]
    check("benchmark_decontamination", plain)
    assert "See it said." in next(r[1] for r in plain if r[0] == 45)
    assert not any(PASSAGE.split()[3] in words(r[1]) for r in plain)

    packed = stages["best_fit_packing"](spark, docs, sf).collect()
    check_packing(packed, [(r[0], r[1]) for r in plain], 2048)


def test_run_gives_what_the_stages_give(spark, sf):
    docs = documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr) == sorted(
        map(tuple, docs.collect()), key=repr
    )


def test_extra_columns_and_empty_table(spark, sf):
    extra = documents(spark, sf).withColumns(
        {"words": F.lit(1), "fp": F.lit("x"), "spans": F.lit(2.0), "line": F.lit(None).cast("string"),
         "line_no": F.lit(3), "items": F.lit(4), "digest": F.lit("y"), "task": F.lit(5)}
    )
    empty = extra.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra, empty = stage(spark, extra, sf), stage(spark, empty, sf)
        assert extra.columns[-8:] == ["words", "fp", "spans", "line", "line_no", "items", "digest", "task"]
        assert extra.count() > 0 and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_spans_of_clean_documents_are_left_alone(spark, sf):
    docs, items = documents(spark, sf), documents(spark, sf, "benchmark")
    changed = decontaminate.clean(docs, items).exceptAll(docs).collect()
    assert [r.doc_id for r in changed] == [45]


def test_texts_in_no_learned_language_go(spark, sf_dir):
    """Given documents stay, short runs of their words too; other languages and random letters go."""
    given = documents(spark, sf_dir)
    rnd = random.Random(3)
    foreign = [
        "kun hän tuli kotiin oli jo pimeää ja kaikki ikkunat olivat kiinni mutta ovi aukesi helposti",
        "kiedy przyszedł do domu było już ciemno i wszystkie okna były zamknięte ale drzwi otworzyły się",
        "когда он пришёл домой было уже темно и все окна были закрыты но дверь открылась легко",
        " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60)),
    ]
    short = [" ".join(r.text.split()[:6]) for r in given.where("n_chars > 200").limit(20).collect()]
    added = [(10**7 + k, t, None) for k, t in enumerate(foreign + short)]
    table = given.unionByName(
        spark.createDataFrame(added, "doc_id long, text string, lang string"), allowMissingColumns=True
    )
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, table, sf_dir).collect()}
    assert kept == {r.doc_id for r in table.collect()} - set(range(10**7, 10**7 + len(foreign)))
