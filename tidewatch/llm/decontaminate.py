"""Removal of benchmark passages from training text, in DataFrame functions alone.

Benchmark items become windows of ten words (a shorter item is one window).
Windows of a document are hashed and looked up in a bitmap of fixed size that holds
the hashes of the benchmark windows; the few that pass are spelled out and matched
word for word with the broadcast set of windows. Texts are not shuffled for this: only
the passing windows leave the scan, joined in place, and one row per document is
combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import lower_ascii

WINDOW = 10
# in lower-cased text a separator is a run of ASCII other than digits and a-z
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RUNS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same words and separators in text as it was written
WRITTEN_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WRITTEN_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BITMAP_BITS = 1 << 20
# with more windows than this the benchmark is joined by its hash instead of broadcast
BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column, separators: str = SEPARATORS) -> Column:
    return F.array_remove(F.split(text, separators), "")


def benchmark_windows(
    benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """``n, passage, items``: distinct windows with the ids of the items they come from.

    Items without a word, null texts among them, have no window.
    """
    words = benchmark.select(
        F.col(item_id).cast("string").alias("item"),
        words_of(lower_ascii(F.coalesce(F.col(text), F.lit("")))).alias("words"),
    ).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = words.select(
        "item", "words", n.alias("n"),
        F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("at"),
    )
    passages = starts.select(
        "item", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("passage")
    )
    return passages.groupBy("n", "passage").agg(F.collect_set("item").alias("items"))


def _hash(n: Column, passage_words: Column) -> Column:
    return F.xxhash64(n, passage_words)


def _bitmap(windows: DataFrame, bits: int) -> Column:
    """The hashes of all windows as a constant array of longs; its size is fixed."""
    h = _hash(F.col("n"), F.split("passage", " ")).bitwiseAND(F.lit(bits - 1))
    cells = (
        windows.select(F.shiftright(h, 6).alias("cell"), h.bitwiseAND(F.lit(63)).alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("held"))
    )
    held = {r["cell"]: r["held"] for r in cells.collect()}
    listed = ",".join(str(held.get(c, 0)) for c in range(bits // 64))
    return F.split(F.lit(listed), ",").cast("array<bigint>")


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    bits: int = BITMAP_BITS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, text_key, n_words, copies, spans, items``: one row per distinct row.

    ``spans`` holds ``(at, n)`` of each matched window, word numbers from 1, in order;
    ``items`` the ids of the items that occur, as sorted strings. ``copies`` counts rows
    equal in id and text.
    """
    windows = benchmark_windows(benchmark, window)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    bitmap = _bitmap(windows, bits)
    value = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(value).alias("text_key"),
        words_of(lower_ascii(value)).alias("words"),
    )

    def hashes_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - (n - 1))
        every = F.transform(starts, lambda i: _hash(F.lit(n), F.slice("words", i, n)))
        return F.when(F.size("words") >= n, every)

    # hashes of all windows of each length, then the places whose bit is set
    hashed = split.select("*", *(hashes_of(n).alias(f"hashes_{n}") for n in lengths))

    def passing(n: int) -> Column:
        hashes = F.col(f"hashes_{n}")

        def held(i: Column) -> Column:
            h = F.get(hashes, i)
            cell = F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")
            return F.getbit(F.get(bitmap, cell), h.bitwiseAND(F.lit(63)).cast("int")) == 1

        return F.coalesce(
            F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), held),
            F.array().cast("array<int>"),
        )

    placed = hashed.select(
        "doc_id", "text_key", "words", *(passing(n).alias(f"places_{n}") for n in lengths)
    )

    def spelled(n: int) -> Column:
        return F.transform(
            f"places_{n}",
            lambda i: F.struct(
                (i + 1).alias("at"),
                F.lit(n).alias("n"),
                F.array_join(F.slice("words", i + 1, n), " ").alias("passage"),
            ),
        )

    none = F.array().cast("array<struct<at:int,n:int,passage:string>>")
    rows = placed.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
        F.posexplode_outer(F.concat(none, *(spelled(n) for n in lengths))).alias("pos", "found"),
    ).select(
        "doc_id", "text_key", "n_words",
        (F.coalesce("pos", F.lit(0)) == 0).cast("long").alias("row"),
        "found.at", "found.n", "found.passage",
    )
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    known = F.broadcast(windows) if few else windows
    matched = rows.join(known, ["n", "passage"], "left")
    hit = F.col("items").isNotNull()
    return (
        matched.groupBy("doc_id", "text_key", "n_words")
        .agg(
            F.sum("row").alias("copies"),
            F.array_sort(F.collect_set(F.when(hit, F.struct("at", "n")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def covered(spans: Column) -> Column:
    """How many words lie in at least one span, for spans in order of their start."""
    start = F.struct(F.lit(0).alias("until"), F.lit(0).alias("total"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["until"], s["at"] + s["n"]).alias("until"),
            (
                acc["total"]
                + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(acc["until"], s["at"]))
            ).alias("total"),
        ),
        lambda acc: acc["total"],
    ).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every row.

    A word is hit if it lies in an occurrence of a window. Null and wordless texts have
    no words and are never contaminated. Items with equal text are all named; an item
    without an id is matched but not named.
    """
    found = hits(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def merged(spans: Column) -> Column:
    """Overlapping or touching spans joined, as ``(at, until)`` with ``until`` behind the last word."""
    empty = F.array().cast("array<struct<at:int,until:int>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (F.coalesce(last["until"], F.lit(0)) >= s["at"])
        joined = F.struct(
            F.when(touches, last["at"]).otherwise(s["at"]).alias("at"),
            F.when(touches, F.greatest(last["until"], s["at"] + s["n"]))
            .otherwise(s["at"] + s["n"]).alias("until"),
        )
        before = F.when(touches, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.concat(before, F.array(joined))

    return F.aggregate(spans, empty, add)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what separates them from the next word."""
    words, gaps = words_of(text, WRITTEN_SEPARATORS), F.split(text, WRITTEN_WORDS)
    # every word with the separator behind it; the first separator stands before all
    units = F.zip_with(words, F.slice(gaps, 2, F.size(words)), lambda w, gap: F.concat(w, gap))
    cuts = merged(spans)
    starts = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda c: c["until"]))
    ends = F.concat(F.transform(cuts, lambda c: c["at"]), F.array(F.size(words) + 1))
    kept = F.transform(
        F.arrays_zip(starts.alias("low"), ends.alias("high")),
        lambda r: F.array_join(
            F.slice(units, r["low"], F.greatest(r["high"] - r["low"], F.lit(0))), ""
        ),
    )
    return F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    whole_documents: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Documents without benchmark passages, all columns as they are.

    Cuts the matched words out of the text, or with ``whole_documents`` drops the rows
    that have any. Rows without a match are returned unchanged.
    """
    found = (
        hits(docs, benchmark, doc_id=doc_id, text=text)
        .where(F.size("spans") > 0)
        .select(
            F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
            F.col("spans").alias("__spans"),
        )
    )
    same = docs[doc_id].cast("long").eqNullSafe(F.col("__id")) & (
        F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__key")
    )
    if whole_documents:
        return docs.join(found, same, "left_anti")
    cut = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(
        without_spans(F.col(text), F.col("__spans"))
    )
    joined = docs.join(found, same, "left")
    return joined.select(*(cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
