"""A log of text records in partitions, each record with an offset: a source that can be replayed.

A log is a folder. ``records/segment=N`` holds the records of one append as Parquet with
``log_partition, offset, value``; ``ends/segment=N`` the offsets it covers, one row per partition, written
after them. A segment without its ends is not there. A stream over a log keeps the next offset of each
partition, so it goes on where it stopped, and reads any range again in the same order. Tasks read the files
through pyarrow, so a log must lie on a file system that pyarrow reaches from the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewatch.operators.ordered import row_numbers
from tidewatch.session import Folder

RECORDS = "log_partition int, offset long, value string"
ENDS = "log_partition int, first long, next long"
# records of one task
SPAN = 250_000


def append_records(df: DataFrame, path: str, key: str, value: str, partitions: int) -> int:
    """Append a segment; records go to partitions by their key, in the order of the key. Its number."""
    spark = df.sparkSession
    folder = Folder(spark, path)
    taken = [int(n.removeprefix("segment=")) for n in folder.names("ends")]
    segment = max(taken, default=-1) + 1
    at = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    rows = df.select(at.alias("log_partition"), F.col(key).alias("_key"), F.col(value).alias("value"))
    numbered = row_numbers(rows, ["log_partition"], ["_key"], "offset")
    if taken:
        # one row per partition
        ends = spark.read.schema(ENDS).parquet(f"{path}/ends").groupBy("log_partition").agg(
            F.max("next").alias("_next")
        )
        numbered = numbered.join(F.broadcast(ends), "log_partition", "left")
    else:
        numbered = numbered.withColumn("_next", F.lit(0))
    offset = F.col("offset") - 1 + F.coalesce("_next", F.lit(0))
    numbered.select("log_partition", offset.cast("long").alias("offset"), "value").write.mode(
        "overwrite"
    ).parquet(f"{path}/records/segment={segment}")
    spark.read.schema(RECORDS).parquet(f"{path}/records/segment={segment}").groupBy(
        "log_partition"
    ).agg(F.min("offset").alias("first"), (F.max("offset") + 1).alias("next")).coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/ends/segment={segment}")
    return segment


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log as a stream."""
    spark.dataSource.register(RecordLog)
    return spark.readStream.format(RecordLog.name()).load(path)


@dataclass
class Span(InputPartition):
    """Offsets ``low`` up to ``high`` of a partition, and the segments that hold them."""

    log_partition: int
    low: int
    high: int
    segments: list[int]


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return RECORDS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options["path"])


class LogReader(DataSourceStreamReader):
    """Offsets are ``{partition: next offset}``; partitions that a log gains later begin at 0."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._ends: dict[int, list[dict]] = {}

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            path = self.path.replace("file:/", "file:///").replace("file://///", "file:///")
            return pafs.FileSystem.from_uri(path)
        return pafs.LocalFileSystem(), self.path

    def _segments(self) -> dict[int, list[dict]]:
        """What each segment covers; a segment is read once."""
        fs, root = self._open()
        found = fs.get_file_info(pafs.FileSelector(f"{root}/ends", allow_not_found=True))
        for info in found:
            number = int(info.base_name.removeprefix("segment="))
            files = fs.get_file_info(pafs.FileSelector(info.path))
            if number not in self._ends and any(f.base_name == "_SUCCESS" for f in files):
                self._ends[number] = ds.dataset(info.path, filesystem=fs, format="parquet").to_table().to_pylist()
        return self._ends

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        latest: dict[str, int] = {}
        for ends in self._segments().values():
            for r in ends:
                key = str(r["log_partition"])
                latest[key] = max(latest.get(key, 0), r["next"])
        return latest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = []
        for key, high in sorted(end.items()):
            low = start.get(key, 0)
            for at in range(low, high, SPAN):
                to = min(high, at + SPAN)
                held = [
                    n for n, ends in self._segments().items() for r in ends
                    if str(r["log_partition"]) == key and r["first"] < to and at < r["next"]
                ]
                spans.append(Span(int(key), at, to, sorted(held)))
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, root = self._open()
        wanted = (
            (ds.field("log_partition") == partition.log_partition)
            & (ds.field("offset") >= partition.low) & (ds.field("offset") < partition.high)
        )
        for segment in partition.segments:
            rows = ds.dataset(f"{root}/records/segment={segment}", filesystem=fs, format="parquet")
            columns = ["log_partition", "offset", "value"]
            yield from rows.to_table(columns, filter=wanted).sort_by("offset").to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass
