"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for local runs; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tidewatch")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tidewatch-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run's tables and stream checkpoints.

    The cluster names the shared root in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary root.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """The rows from a table in the shared folder.

    What is not the same when it is computed twice, such as the number of the task a row
    landed in, is settled by this and outlives any executor.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Shuffle files go with the write they were made for, instead of when the driver collects its garbage; rows are
#: dealt to a few open files, which hold little in memory, without sorting them.
WRITE_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


class Slices:
    """A table in the shared folder that is cut into slices, each removed once it is not read again."""

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self._folder = Folder(spark, work_folder(spark, purpose))
        self._schema: StructType | None = None
        self._writes = 0

    def _path(self, write: int, k: int) -> str:
        return f"{write}/_slice={k}"

    def write(self, k: int, df: DataFrame) -> None:
        """Adds the rows to slice ``k``."""
        self._write(df, df.schema, self._path(self._writes, k))

    def deal(self, df: DataFrame, number: Column) -> None:
        """Adds each row to the slice that has its number."""
        self._write(df.withColumn("_slice", number), df.schema, f"{self._writes}", "_slice")

    def _write(self, df: DataFrame, schema: StructType, at: str, *by: str) -> None:
        with _settings(self.spark, **WRITE_SETTINGS):
            writer = df.write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20})
            writer.partitionBy(*by).parquet(f"{self._folder.path}/{at}")
        self._schema = schema
        self._writes += 1

    def read(self, *ks: int) -> DataFrame:
        """The rows of these slices."""
        paths = [p for k in ks for w in range(self._writes) if self._folder.has(p := self._path(w, k))]
        if not paths:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(*[f"{self._folder.path}/{p}" for p in paths])

    def remove(self, k: int) -> None:
        for write in range(self._writes):
            self._folder.remove(self._path(write, k))


class Folder:
    """A folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = path

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What lies in it, in order; nothing if it is not there."""
        if not self._fs.exists(self._at(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def bytes(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def set_time(self, name: str, millis: int) -> None:
        self._fs.setTimes(self._at(name), millis, -1)
