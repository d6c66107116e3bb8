"""Streams: scoring, latest state, bounded history, alerts, summary, windows, sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from tidewatch.functions.catalog import HISTORY_POINTS
from tidewatch.operators.quality import split_good_bad
from tidewatch.session import Folder

# runs of a level that are merged into one
FAN = 8


def file_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
    glob: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream; ``files_per_trigger`` bounds each batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int | None = None
) -> DataFrame:
    """Message texts of a topic; needs the Kafka connector on the classpath."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    if offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def _started(writer, folder: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{folder}/progress")
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def append_to_table(stream: DataFrame, folder: str, interval: str | None = None) -> StreamingQuery:
    """Append rows to ``folder/rows``, exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option(
        "path", f"{folder}/rows"
    )
    return _started(writer, folder, interval)


def batches_to(
    stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None],
    mode: str = "append", interval: str | None = None,
) -> StreamingQuery:
    return _started(stream.writeStream.outputMode(mode).foreachBatch(write), folder, interval)


class KeyedTable:
    """A table of the newest row per key that a stream keeps up to date.

    A batch writes only its own changes, sorted by key, as run ``epoch`` of level 0. When ``fan``
    runs of a level are complete they are merged into one run of the next level, the
    newest row per key. So a batch costs what it changes, however many keys the table holds, a change is
    written again once per level, and a reader merges fewer than ``fan`` runs per level. Runs that went into
    another stay until that level's next merge: a batch that is repeated finds what it found before, replaces its own
    runs, and readers that listed the old ones can finish. A run without its success mark is not read.

    With ``order`` the row with the largest values of these columns is the newest, else the row of
    the later batch, as for streams in update mode. Batches are numbered without gaps, as
    ``foreachBatch`` does.
    """

    def __init__(
        self, path: str, schema: StructType, keys: Sequence[str],
        order: Sequence[str] = (), fan: int = FAN,
    ) -> None:
        self.path, self.schema = path, schema
        self.keys, self.order, self.fan = list(keys), list(order), fan
        self._stored = StructType(list(schema.fields)).add("_epoch", "long")

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self._stored.names if c not in self.keys]
        newest = F.max_by(F.struct(*others), F.struct(*self.order, "_epoch")).alias("_r")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_r.*").select(
            *self._stored.names
        )

    def runs(self, spark: SparkSession) -> list[tuple[int, int]]:
        """The complete runs that no other one contains, as (level, number); the run covers epochs
        ``number * fan ** level`` up to the next number."""
        folder = Folder(spark, self.path)
        found: list[tuple[int, int]] = []
        for name in sorted(folder.names(), key=lambda n: -int(n.removeprefix("level="))):
            level = int(name.removeprefix("level="))
            for run in folder.names(name):
                number = int(run.removeprefix("run="))
                inside = any(number // self.fan ** (up - level) == n for up, n in found)
                if not inside and folder.has(f"{name}/{run}/_SUCCESS"):
                    found.append((level, number))
        return found

    def _read(self, spark: SparkSession, runs: Sequence[tuple[int, int]]) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], self._stored)
        paths = [f"{self.path}/level={level}/run={run}" for level, run in runs]
        return spark.read.schema(self._stored).parquet(*paths)

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        rows.sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(
            f"{self.path}/level={level}/run={run}"
        )

    def read(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        """The newest row of each key; empty if no batch came yet. ``where`` on keys
        reaches the scans, whose files are sorted by key."""
        rows = self._read(spark, self.runs(spark))
        if where is not None:
            rows = rows.where(where)
        return self._newest(rows).select(*self.schema.names)

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Take in a batch; for ``foreachBatch``."""
        spark = batch.sparkSession
        fresh = batch.select(*self.schema.names, F.lit(epoch).cast("long").alias("_epoch"))
        self._write(self._newest(fresh), 0, epoch)
        folder, level = Folder(spark, self.path), 1
        while (epoch + 1) % self.fan**level == 0:
            run = (epoch + 1) // self.fan**level - 1
            parts = [(level - 1, run * self.fan + k) for k in range(self.fan)]
            self._write(self._newest(self._read(spark, parts)), level, run)
            for k in range(self.fan):  # what went into the run before
                if run:
                    folder.remove(f"level={level - 1}/run={(run - 1) * self.fan + k}")
            level += 1


def appended(folder: str, name: str) -> Callable[[DataFrame, int], None]:
    """Keep the rows of every batch; a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")

    return write


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Give each batch to several sinks; it is computed once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return write


def parse_records(stream: DataFrame, value: str, schema: str) -> DataFrame:
    """JSON text to columns; ``_bad`` marks text that does not parse."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_text"}
    parsed = stream.withColumn("_r", F.from_json(value, f"{schema}, _text string", options))
    return parsed.select(
        *stream.columns, "_r.*", F.col("_r._text").isNotNull().alias("_bad")
    ).drop("_text")


def latest_stream(stream: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Latest record per entity, for update mode."""
    others = [c for c in stream.columns if c != entity]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_r")
    return stream.groupBy(entity).agg(newest).select(entity, "_r.*")


def history_stream(
    stream: DataFrame, entity: str, time: str, value: str, tiebreak: str, n: int = HISTORY_POINTS
) -> DataFrame:
    """Latest n points per entity, as an array after each batch, for update mode.

    ``tiebreak`` orders points of the same time. Every Arrow batch is first cut to n rows per entity where it lies, so that a
    large entity sends little to the task that keeps its state.
    """
    rows = stream.select(
        F.col(entity).cast("long").alias("entity"),
        F.unix_micros(time).alias("at"),
        F.col(tiebreak).cast("long").alias("tie"),
        F.col(value).cast("double").alias("value"),
    )

    def trim(frames):
        for frame in frames:
            yield frame.sort_values(["at", "tie"]).groupby("entity", sort=False).tail(n)

    def keep(key, frames, state):
        points = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            new = zip(frame["at"].tolist(), frame["tie"].tolist(), frame["value"].tolist())
            points = sorted([*points, *new], key=lambda p: p[:2])[-n:]
        at, ties, values = (list(column) for column in zip(*points))
        state.update((at, ties, values))
        yield pd.DataFrame({"entity": [key[0]], "at": [at], "values": [values]})

    return (
        rows.mapInPandas(trim, "entity long, at long, tie long, value double")
        .groupBy("entity")
        .applyInPandasWithState(
            keep,
            "entity long, at array<bigint>, values array<double>",
            "at array<bigint>, ties array<bigint>, values array<double>",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )


def subscribed(rows: DataFrame, subscriptions: DataFrame, entity: str) -> DataFrame:
    """Rows of the entities someone subscribed to."""
    return rows.join(subscriptions, entity, "left_semi")


def subscribed_sink(
    subscriptions: Callable[[SparkSession], DataFrame], entity: str,
    sink: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """Pass on the rows of subscribed entities; subscriptions are read again for each batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        sink(subscribed(batch, subscriptions(batch.sparkSession), entity), epoch)

    return write


def routed_sink(
    violations: str, good: Callable[[DataFrame, int], None],
    dead_letter: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """Rows that pass every rule go to one sink, the others to another."""

    def write(batch: DataFrame, epoch: int) -> None:
        passed, failed = split_good_bad(batch, violations)
        fan = ((good, passed), (dead_letter, failed))
        batch.persist()
        try:
            for sink, rows in fan:
                sink(rows, epoch)
        finally:
            batch.unpersist()

    return write


def late_and_on_time(
    folder: str, time: str, delay_seconds: float,
    on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """Rows older than the watermark of the batches before, and rows without a time, go to ``late``.

    The watermark is the latest time of all earlier batches less the delay, as the engine
    has it. It is kept in a table of one row, so a batch that is repeated is split in the same way.
    ``counted(folder, spark)`` reads what was seen so far.
    """
    marks = KeyedTable(f"{folder}/marks", StructType.fromDDL(_MARKS), ["name"])

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = marks.read(spark).first()  # one row
        before, n, n_late = (None, 0, 0) if held is None else (
            held["earlier"] if held["epoch"] == epoch else (held["latest"], held["n"], held["n_late"])
        )
        at = F.unix_micros(time)
        limit = F.lit(None if before is None else before - int(delay_seconds * 1_000_000))
        batch = batch.withColumn("_late", F.coalesce(at < limit.cast("long"), at.isNull()))
        batch.persist()
        try:
            seen = batch.agg(
                F.max(at).alias("latest"), F.count(F.lit(1)).alias("n"), F.count_if("_late").alias("n_late")
            ).first()
            on_time(batch.where(~F.col("_late")).drop("_late"), epoch)
            late(batch.where("_late").drop("_late"), epoch)
        finally:
            batch.unpersist()
        latest = max((t for t in (before, seen["latest"]) if t is not None), default=None)
        row = ("all", epoch, (before, n, n_late), latest, n + seen["n"], n_late + seen["n_late"])
        marks.write(spark.createDataFrame([row], _MARKS), epoch)

    return write


_MARKS = (
    "name string, epoch long, earlier struct<latest: long, n: long, n_late: long>, "
    "latest long, n long, n_late long"
)


def counted(folder: str, spark: SparkSession) -> tuple[int, int]:
    """Rows and late rows that ``late_and_on_time`` has split."""
    row = KeyedTable(f"{folder}/marks", StructType.fromDDL(_MARKS), ["name"]).read(spark).first()
    return (row["n"], row["n_late"]) if row else (0, 0)


class DropCounts(StreamingQueryListener):
    """Rows per query that stateful operators dropped for being older than the watermark, and the metrics
    that ``observe`` reports, from the progress of each batch."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.observed: dict[str, list[tuple[str, dict]]] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        key = str(progress.id)
        lost = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        self.dropped[key] = self.dropped.get(key, 0) + lost
        for name, row in (progress.observedMetrics or {}).items():
            self.observed.setdefault(key, []).append((name, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def sliding_totals(
    stream: DataFrame, time: str, value: str, window: str = "30 minutes",
    slide: str = "15 minutes", late: str = "10 minutes",
) -> DataFrame:
    """Count and mean per sliding window; rows later than ``late`` are dropped and counted
    in the query's progress."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "n", "mean_value")
    )


def session_totals(
    stream: DataFrame, entity: str, time: str, value: str, gap: str = "30 minutes",
    late: str = "10 minutes",
) -> DataFrame:
    """Count and mean per session; a session appears once the watermark has passed it.

    ``build_session`` has rows of a session merged where they lie before they are shuffled.
    """
    return (
        stream.withWatermark(time, late)
        .groupBy(entity, F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
        .select(entity, F.col("w.start").alias("session_start"),
                F.col("w.end").alias("session_end"), "n", "mean_value")
    )


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for a query that ends by itself, and pass on its failure."""
    query.awaitTermination()
    failure = query.exception()
    if failure:
        raise failure
    return query


def scored(stream: DataFrame, p: Column, valid: Column, fallback: float) -> DataFrame:
    """Add the score; invalid rows get the fallback and are marked."""
    return stream.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn(
        "p", F.when(F.col("valid"), p).otherwise(F.lit(fallback))
    )
