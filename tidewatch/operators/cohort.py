"""Entity tables and their alignment with measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written_once


def join_entities(
    stays: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    admission_key: str,
    patient_key: str,
) -> DataFrame:
    """Stays with their admission and patient.

    Columns that two inputs share are kept from the stays. No side is hinted:
    Spark broadcasts what its size statistics allow and sorts and merges else.
    """
    shared = [c for c in admissions.columns if c in stays.columns and c != admission_key]
    first = stays.join(admissions.drop(*shared), admission_key)
    shared = [c for c in patients.columns if c in first.columns and c != patient_key]
    return first.join(patients.drop(*shared), patient_key)


def align_tables(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides on common keys; a row of either side alone is kept."""
    return left.join(right, list(keys), "full_outer")


SPANS = (1, 32, 1024)  # days, each a multiple of the one before


def _span(days: int, day: Column) -> Column:
    """The span of so many days that holds a day; the length is part of it."""
    return F.struct(F.lit(days).alias("days"), F.floor(day / days).cast("int").alias("at"))


def _cover(first: Column, last: Column, lengths: Sequence[int]) -> Column:
    """Spans that together hold each day from ``first`` to ``last`` once, null if there is none.

    ``lengths`` rises. A length covers what is left at both ends by whole spans of the next
    length; the longest takes the middle.
    """

    def spans(n: int, low: Column, high: Column) -> Column:
        """Those of length ``n`` from the one at ``low`` to before the one at ``high``."""
        ats = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            ats, lambda at: F.struct(F.lit(n).alias("days"), at.cast("int").alias("at"))
        )

    parts, low, high = [], first, last + 1  # in spans of the length at hand
    for n, longer in zip(lengths, [*lengths[1:], None]):
        if longer is None:
            parts.append(spans(n, low, high))
            break
        times = longer // n
        inner_low, inner_high = F.ceil(low / times).cast("int"), F.floor(high / times).cast("int")
        whole = inner_low < inner_high
        # without a whole longer span inside, all is taken at this length
        parts.append(spans(n, low, F.when(whole, inner_low * times).otherwise(high)))
        parts.append(F.when(whole, spans(n, inner_high * times, high)).otherwise(
            F.array().cast("array<struct<days:int,at:int>>")
        ))
        low = F.when(whole, inner_low).otherwise(0)
        high = F.when(whole, inner_high).otherwise(0)
    return F.when(first <= last, F.concat(*parts))


def within_stay(
    stays: DataFrame,
    rows: DataFrame,
    entity: str,
    stay: str,
    begin: str,
    end: str,
    time: str,
) -> DataFrame:
    """Each stay with the entity's rows whose time lies in the stay; empty stays are kept.

    Both sides meet on entity and a span of time, so that a large entity spreads over its
    spans and no row is paired with a stay of another time. A stay is covered by the longest
    spans of ``SPANS`` days that lie inside its days, shorter ones at its two ends, so ten years
    take some 150 rows and not one per day. A row has one span of each length that the
    stays use: short stays alone make it meet them by the day. A stay that ends before it
    begins, or lacks a time, has no span and stays empty. The matches are written once, so
    the measurements are read once, and the stays without any follow from them.
    """
    first, last = F.unix_date(F.to_date(begin)), F.unix_date(F.to_date(end))
    longest = stays.agg(F.max(last - first + 1)).first()[0] or 0
    used = [n for n in SPANS if n == 1 or 2 * n <= longest]
    covered = stays.withColumn("_span", F.explode(_cover(first, last, used)))
    day = F.unix_date(F.to_date(time))
    dated = rows.withColumn("_span", F.explode(F.array(*[_span(n, day) for n in used])))
    matched = written_once(
        covered.join(dated, [entity, "_span"])
        .filter(F.col(time).between(F.date_trunc("hour", begin), F.col(end)))
        .drop("_span"),
        "within-stay",
    )
    held = matched.select(F.col(stay).alias("_held")).distinct()
    # a null stay is a stay like others
    empty = stays.join(held, F.col(stay).eqNullSafe(F.col("_held")), "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True)


def fanout_rows(
    stays: DataFrame, left: DataFrame, right: DataFrame, entity: str
) -> DataFrame:
    """How many rows an alignment by entity alone would give, per entity.

    The rows themselves are never built: the count of a product is the product
    of the counts.
    """
    def per_entity(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(entity).agg(F.count(F.lit(1)).alias(name))

    def at_least_one(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1))

    return (
        per_entity(stays, "_stays")
        .join(per_entity(left, "_left"), entity, "left")
        .join(per_entity(right, "_right"), entity, "left")
        .select(
            entity,
            (F.col("_stays") * at_least_one("_left") * at_least_one("_right")).alias("n_rows"),
        )
    )
