"""What several operators share: plain columns of a table, and results written once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import work_folder

# A word is a run of bytes other than these. ``bytes.split()`` cuts at the same six.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def id_and_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the text in UTF-8; null texts become empty."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def smallest_hashes(rows: DataFrame, hashed: str, wanted: int, total: int) -> DataFrame:
    """At most ``wanted`` of ``total`` rows, those with the smallest 64-bit hash.

    Rows far above the share that is wanted are left out first, so that tasks do not each pass on
    as many rows as are wanted altogether.
    """
    share = 1.5 * wanted / max(1, total)
    if share < 1:
        rows = rows.where(F.col(hashed) < F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(hashed).limit(wanted)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in this fold; a null id counts as ''."""
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % folds == fold


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Later steps start from files that outlive any executor, and a step that is
    used twice runs once.
    """
    path = f"{work_folder(df.sparkSession, purpose)}/{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
