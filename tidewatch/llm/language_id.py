"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three characters, words padded
with a blank) in order. A text takes the language whose profile is nearest by
out-of-place distance: for each n-gram of the text's own profile, how far its
rank is from its rank in the language, or the profile length if it is not there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import id_and_text, in_fold

PROFILE = 300
ORDERS = 3
UNKNOWN = "und"
FOLDS, HELD_OUT_FOLD = 4, 2
CHARS_AT_ONCE = 1_000_000
HELD_GRAMS = 2_000_000
# stands for a blank; no letter has this code
BLANK = 1
# documents below this score are rejected beside those without a letter
LEAST_SCORE = 0.0

Profile = tuple[np.ndarray, np.ndarray]


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, every run of others as one blank, and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, BLANK).astype(np.int64)
    codes = np.concatenate(([BLANK], codes, [BLANK]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    return codes[keep]


def grams(codes: np.ndarray, orders: int = ORDERS) -> np.ndarray:
    """Every n-gram up to this order as one number, 21 bits a character; none spans a blank."""
    out = [codes[codes != BLANK]]
    packed = codes
    for n in range(2, orders + 1):
        packed = (packed[:-1] << 21) | codes[n - 1 :]
        # a blank may only stand first or last, and something must stand beside it
        inner = np.ones(len(packed), bool)
        for k in range(1, n - 1):
            inner &= codes[k : k + len(packed)] != BLANK
        if n == 2:
            inner &= (codes[:-1] != BLANK) | (codes[1:] != BLANK)
        out.append(packed[inner])
    return np.concatenate(out)


def ranked(found: np.ndarray, length: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; ties go to the smaller number."""
    values, counts = np.unique(found, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:length]]


def learn_profiles(
    docs: DataFrame,
    length: int = PROFILE,
    orders: int = ORDERS,
    lang: str = "lang",
    text: str = "text",
) -> dict[str, list[int]]:
    """The profile of every language named in ``lang``, counted over all rows.

    Each task counts the n-grams of its own rows, Spark adds the counts and keeps the
    ``length`` largest of each language, which is all the driver gets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Profile]] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                values = np.concatenate([v for v, _ in parts])
                counts = np.concatenate([c for _, c in parts])
                values, at = np.unique(values, return_inverse=True)
                total = np.bincount(at, weights=counts).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(total)],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            chars = 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k, (name, value) in enumerate(rows):
                waiting.setdefault(name, []).append(letter_codes(value))
                chars += len(value)
                if chars >= CHARS_AT_ONCE or k == len(rows) - 1:
                    for other, parts in waiting.items():
                        # each part begins and ends with a blank, so no n-gram joins two
                        found = np.unique(grams(np.concatenate(parts), orders), return_counts=True)
                        held.setdefault(other, []).append(found)
                        size += len(found[0])
                    waiting, chars = {}, 0
            if size > HELD_GRAMS:
                yield from merged()
                size = 0
        yield from merged()

    known = docs.where(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    counts = known.mapInArrow(count, "lang string, gram long, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        counts.groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= length)
    )
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """Compares texts with fixed profiles."""

    def __init__(self, profiles: dict[str, list[int]], length: int = PROFILE, orders: int = ORDERS):
        self.names = sorted(profiles)
        self.length, self.orders = length, orders
        every = sorted({g for p in profiles.values() for g in p})
        self.grams = np.array(every, np.int64)
        # the last row is for n-grams that no profile has
        self.ranks = np.full((len(every) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(profiles[name], np.int64))
            self.ranks[at, k] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and one minus its distance as a share of the largest possible."""
        own = ranked(grams(letter_codes(text or ""), self.orders), self.length)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        theirs = self.ranks[at]
        apart = np.abs(theirs - np.arange(len(own))[:, None])
        far = np.where(theirs < 0, self.length, apart).sum(axis=0)
        best = int(np.argmin(far))
        return self.names[best], 1.0 - float(far[best]) / (self.length * len(own))


def predict(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    length: int = PROFILE,
    orders: int = ORDERS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.

    ``und`` with score 0 where a text is null or has no letter, or nothing was learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, length, orders)
        for batch in batches:
            found = [ranker.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return id_and_text(docs, doc_id, text).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def training_part(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows outside the held-out fold."""
    return docs.where(~in_fold(F.col(doc_id), FOLDS, HELD_OUT_FOLD))


def accepted(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    least_score: float = LEAST_SCORE,
    text: str = "text",
) -> DataFrame:
    """The rows with a language, all columns as they are.

    Rows go if their text is null or has no letter, or scores below ``least_score``. If
    no profile was learned nothing is known about any row and only rows without a letter go.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        letters = _letters()
        for batch in batches:
            keep = []
            for value in batch.column(at):
                name, score = ranker.predict(value.as_py())
                if ranker.names:
                    keep.append(name != UNKNOWN and score >= least_score)
                else:
                    codes = letter_codes(value.as_py() or "")
                    keep.append(bool(letters[codes].any()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
