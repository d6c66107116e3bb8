"""Recurring lines by a log-template tree of fixed depth.

A line is parsed into words; words with a digit become a wildcard. The tree
leads by word count and the first ``DEPTH`` words to a leaf. In a leaf with
several lines, fields that vary are generalised too: a word that far fewer lines
have at its position than the line's other words becomes a wildcard, at most a
fifth of them. What is left is the line's template. A template found in more than
one document recurs; its lines are dropped from every document but the first.

Everything is counted by (leaf, line) before it is shuffled, so a line that holds a
third of all rows is one row per task. Only short keys travel; lines are cut into words
only in leaves with several lines. Nulls: a null text is one empty line and has no template, a
null id is smaller than all others. Rows equal in id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import materialise

WILD = "<*>"
DEPTH = 3
# shorter lines are too common in plain prose to be a template
LEAST_WORDS = 5
# a template's lines have at least this share of constant words
CONSTANT = 0.5
# this share of a line's words may be generalised
VARYING = 0.2
# leaves up to this number are broadcast as a set of longs; more are joined
BROADCAST_LEAVES = 500_000
# only tried where a word begins
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def parsed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, line_no, masked, leaf, line`` of every line long enough to count.

    ``masked`` has its words apart by one blank, so that words are counted and the first ones
    taken without cutting the line into all of them.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    masked = F.when(value.rlike("[0-9]"), F.regexp_replace(value, VARIABLE, WILD)).otherwise(value)
    odd = F.lit(False)
    for blank in "\t\x0b\f\r":
        odd = odd | F.contains(value, F.lit(blank))
    masked = F.when(odd, F.regexp_replace(masked, r"[\t\x0B\f\r]", " ")).otherwise(masked)
    # inside the generator, where a filter on the lines cannot have it computed again
    even = F.transform(
        F.split(masked, "\n", -1),
        lambda line: F.when(
            F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")),
            F.trim(F.regexp_replace(line, " +", " ")),
        ).otherwise(line),
    )
    lines = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(value).alias("text_key"),
        F.posexplode(even).alias("line_no", "masked"),
    )
    blanks = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    counted = lines.select("*", (blanks + 1).alias("n")).where(F.col("n") >= LEAST_WORDS)
    constant = F.size(F.array_remove(F.split("masked", " "), WILD))
    enough = ~F.contains("masked", F.lit(WILD)) | (constant >= CONSTANT * F.col("n"))
    return counted.where(enough).select(
        "doc_id", "text_key", "line_no", "masked",
        F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"),
        F.xxhash64("masked").alias("line"),
    )


def _templates(docs: DataFrame, lines: DataFrame, **columns: str) -> DataFrame:
    """``leaf, line, template`` for the lines of leaves with several lines."""
    shared = lines.groupBy("leaf").agg(F.count("*").alias("n_lines")).where("n_lines > 1")
    shared = materialise(shared.select("leaf"), "line-leaves")
    few = shared.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    spelled = (
        parsed_lines(docs, **columns)
        .select("leaf", "line", "masked")
        .join(F.broadcast(shared) if few else shared, "leaf", "left_semi")
        .groupBy("leaf", "line")
        .agg(F.first("masked").alias("masked"))
        .join(lines.select("leaf", "line", "n"), ["leaf", "line"])
    )
    tokens = materialise(
        spelled.select(
            "leaf", "line", "n", F.posexplode(F.split("masked", " ")).alias("at", "word")
        ),
        "line-words",
    )
    # the first words are the leaf's own and stay as they are
    support = (
        tokens.where(F.col("at") >= DEPTH)
        .groupBy("leaf", "at", "word")
        .agg(F.sum("n").alias("support"))
    )
    known = tokens.join(support, ["leaf", "at", "word"], "left")
    rows = known.groupBy("leaf", "line").agg(
        F.array_sort(F.collect_list(F.struct("at", "word", "support"))).alias("fields"),
        F.array_sort(F.collect_list("support")).alias("supports"),
    )
    usual = F.element_at(
        "supports", (F.floor(F.size("supports") * F.lit(VARYING)) + 1).cast("int")
    )
    rows = rows.select("leaf", "line", "fields", usual.alias("usual"))
    general = F.transform(
        "fields",
        lambda f: F.when(
            (F.col("usual") > 1) & (f["support"] * 2 < F.col("usual")), F.lit(WILD)
        ).otherwise(f["word"]),
    )
    return rows.select("leaf", "line", F.xxhash64(general).alias("template"))


def recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, line_no`` of every line to drop.

    A line goes if its template is found in several documents and this one is not
    the first of them by id. Rows equal in id and text are one document.
    """
    keys = materialise(
        parsed_lines(docs, doc_id, text).select("doc_id", "text_key", "line_no", "leaf", "line"),
        "line-keys",
    )
    holder = F.struct("doc_id", "text_key")
    lines = materialise(
        keys.groupBy("leaf", "line").agg(
            F.count("*").alias("n"), F.min(holder).alias("low"), F.max(holder).alias("high")
        ),
        "lines",
    )
    named = lines.join(
        _templates(docs, lines, doc_id=doc_id, text=text), ["leaf", "line"], "left"
    ).select("leaf", "line", "low", "high", F.coalesce("template", "line").alias("template"))
    named = materialise(named, "line-templates")
    common = (
        named.groupBy("leaf", "template")
        .agg(F.min("low").alias("first"), F.max("high").alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
    )
    dropped = named.join(common, ["leaf", "template"]).select("leaf", "line", "first")
    return (
        keys.join(dropped, ["leaf", "line"])
        .where(~holder.eqNullSafe(F.col("first")))
        .select("doc_id", "text_key", "line_no")
    )


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines of these numbers, counted from 0."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    # as a field of a lambda variable the lines are split once, not for every line kept
    both = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    left = F.transform(
        both, lambda b: F.array_join(F.transform(b["kept"], lambda i: F.get(b["lines"], i)), "\n")
    )
    return F.element_at(left, 1)


def _joined(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Column]:
    drops = (
        recurring(docs, doc_id, text)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line_no").alias("__dropped"))
        .withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    )
    value = F.coalesce(docs[text], F.lit(""))
    same = docs[doc_id].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(value) == F.col("__key"))
    return docs.join(drops, same, "left"), value


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` for every row; a null text is one empty line."""
    joined, value = _joined(docs, doc_id, text)
    left = F.when(F.col("__dropped").isNull(), value).otherwise(
        without_lines(value, F.col("__dropped"))
    )
    return joined.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.size(F.split(value, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        left.alias("text"),
    )


def without_recurring_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without those lines, all columns as they are.

    Rows left without a word go; rows that had none to begin with, and all others without
    a recurring line, are returned unchanged.
    """
    joined, value = _joined(docs, doc_id, text)
    whole = F.col("__dropped").isNull()
    left = F.when(whole, docs[text]).otherwise(without_lines(value, F.col("__dropped")))
    # one text or none, computed once
    texts = F.filter(F.array(left), lambda t: whole | t.rlike(r"\S"))
    return joined.select(
        *(F.explode(texts).alias(c) if c == text else docs[c] for c in docs.columns)
    )
