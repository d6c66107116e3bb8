"""Readers with declared schemas, and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "orc")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Scan with a declared schema: nothing is inferred, so no extra pass over the files."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def read_gzip_csv(
    spark: SparkSession, path: str, schema: str, partitions: int | None = None
) -> DataFrame:
    """Gzip CSV with header. A gzip file is one task to read, so rows are spread afterwards."""
    rows = read_table(spark, path, schema, "csv")
    return rows.repartition(partitions) if partitions else rows


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
    mode: str = "overwrite", compression: str = "snappy",
) -> None:
    """Partitioned table. ``fmt="delta"`` works where that source is installed."""
    writer = df.write.format(fmt).mode(mode).option("compression", compression)
    if partition_by:
        # one shuffle by partition value keeps the number of files per folder down;
        # adaptive execution splits a value that is too large for one task
        writer = (
            df.hint("rebalance", *partition_by)
            .write.format(fmt).mode(mode).option("compression", compression)
            .partitionBy(*partition_by)
        )
    writer.save(path)


def hash_bucket(df: DataFrame, column: str, buckets: int, name: str = "bucket") -> DataFrame:
    """A partition column for ids that are too many to have a folder each."""
    return df.withColumn(name, F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))


def write_manifest(
    df: DataFrame, path: str, columns: Sequence[str], single_file: bool = False,
    compression: str = "none",
) -> None:
    """CSV with header. ``single_file`` is for small manifests only: one task writes it."""
    rows = df.select(*columns)
    if single_file:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Statistics or metrics, one JSON object per row."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
