"""Keyed state with timers: sequences that end, buffers that flush, subscriptions that change.

Each operator is a ``StatefulProcessor``. Rows of a key wait in its state until the watermark has passed them
and are then taken in the order of their time, so results do not depend on how rows were cut into
batches. Rows without a time have no place in that order and are left out; ``late_and_on_time``
keeps them aside. A null record id counts as -1. One timer per key stands at the next moment at which something can happen. State needs
the RocksDB store, which ``stateful`` names for the query it starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

START, END = "start", "end"
IDLE, OPEN = "idle", "open"
SIZE, AGE = "size", "age"


def stateful(start: Callable[[], object], spark, tasks: int | None = None):
    """Calls ``start``, which starts a query, while the session names the RocksDB state store.

    ``tasks`` is the number of state partitions, else that of shuffles; a query that goes on
    keeps the number it began with. Every one of them starts a Python worker per batch.
    """
    wanted = {PROVIDER: ROCKSDB}
    if tasks:
        wanted["spark.sql.shuffle.partitions"] = str(tasks)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class InOrder(StatefulProcessor):
    """Rows of a key in the order of (at, ...), once no earlier one can come.

    ``row`` is the schema of what is kept of a row; its first column is ``at`` in microseconds.
    With ``arrival`` rows count from their arrival, the clock is the processing time, and
    nothing has to wait. Subclasses give ``open_state`` and ``take``.
    """

    row: str
    out: str

    def __init__(self, arrival: bool = False) -> None:
        self._arrival = arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self.row)
        self._alarm = handle.getValueState("alarm", "at long")
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: tuple, rows: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        """Output rows, and the microsecond after which there is more to do. ``now`` is the
        microsecond up to which all rows are known."""
        raise NotImplementedError

    def _set_alarm(self, at: int | None) -> None:
        held = self._alarm.get()[0] if self._alarm.exists() else None
        if at is None or held is not None and held <= at:
            return
        if held is not None:
            self._handle.deleteTimer(held)
        self._handle.registerTimer(at)
        self._alarm.update((at,))

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = [c.split()[0] for c in self.out.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    def _go_on(self, key: tuple, ready: list[tuple], now: int, rest: list[tuple]):
        rows, then = self.take(key, ready, now)
        moments = [m // 1000 for m in (then, rest[0][0] if rest else None) if m is not None]
        # a timer fires when the clock is past it
        self._set_alarm(min(moments, default=None))
        return self._frame(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [t for frame in rows for t in frame.itertuples(index=False, name=None)]
        if self._arrival:
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            ready = [(now, *t[1:]) for t in sorted(new)]
            yield from self._go_on(key, ready, now, [])
        elif new:
            self._waiting.appendList(new)
            self._set_alarm(min(new)[0] // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._alarm.clear()
        if self._arrival:
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            yield from self._go_on(key, [], now, [])
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(t) for t in self._waiting.get())
        ready = [t for t in rows if t[0] < now]
        rest = rows[len(ready):]
        if ready:
            self._waiting.put(rest) if rest else self._waiting.clear()
        yield from self._go_on(key, ready, now, rest)

    def close(self) -> None:
        pass


class Sequences(InOrder):
    """Sequences that a START row opens and an END row, a new START or ``idle`` without a row closes.

    ``carried`` is the state a sequence hands from row to row: half of it, plus the value. An
    idle end clears the key, so keys that stay away hold nothing.
    """

    row = "at long, id long, value double, flag string"
    out = "entity long, started_at long, last_at long, n long, carried double, ended_by string"

    def __init__(self, idle: int, arrival: bool = False) -> None:
        super().__init__(arrival)
        self._idle = idle

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "started long, last long, n long, carried double")

    def take(self, key, rows, now):
        held = tuple(self._open.get()) if self._open.exists() else None
        done = []

        def close(why: str) -> None:
            nonlocal held
            done.append((key[0], *held, why))
            held = None

        for at, _, value, flag in rows:
            if held and at - held[1] >= self._idle:
                close(IDLE)
            elif held and flag == START:
                close(START)
            started, _, n, carried = held or (at, at, 0, 0.0)
            held = (started, at, n + 1, carried / 2 + value)
            if flag == END:
                close(END)
        if held and (held[1] + self._idle) // 1000 < now // 1000:
            close(IDLE)
        self._open.update(held) if held else self._open.clear()
        return done, held[1] + self._idle if held else None


class Buffers(InOrder):
    """Records held until ``size`` of them are there or the oldest is ``age`` old.

    Every record leaves once, with the time of its buffer's first record and what flushed it.
    """

    row = "at long, id long, value double"
    out = "shard long, first_at long, cause string, id long, value double"

    def __init__(self, size: int, age: int, arrival: bool = False) -> None:
        super().__init__(arrival)
        self._size, self._age = size, age

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getListState("held", self.row)

    def take(self, key, rows, now):
        held = [tuple(t) for t in self._held.get()] if self._held.exists() else []
        done = []

        def flush(cause: str) -> None:
            done.extend((key[0], held[0][0], cause, t[1], t[2]) for t in held)
            held.clear()

        for t in rows:
            if held and t[0] - held[0][0] >= self._age:
                flush(AGE)
            held.append(t)
            if len(held) == self._size:
                flush(SIZE)
        if held and (held[0][0] + self._age) // 1000 < now // 1000:
            flush(AGE)
        self._held.put(held) if held else self._held.clear()
        return done, held[0][0] + self._age if held else None


class Subscriptions(InOrder):
    """Rows of an entity, once for each client that is subscribed at their time.

    Controls come before rows of the same time. The clients of an entity are its state.
    """

    row = "at long, kind int, id long, client string, value double"
    out = "client string, entity long, id long, value double"
    SUBSCRIBE, UNSUBSCRIBE, RECORD = 1, 0, 2

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self._clients = handle.getValueState("clients", "names array<string>")

    def take(self, key, rows, now):
        clients = set(self._clients.get()[0]) if self._clients.exists() else set()
        done = []
        for _, kind, record, client, value in rows:
            if kind == self.SUBSCRIBE:
                clients.add(client)
            elif kind == self.UNSUBSCRIBE:
                clients.discard(client)
            else:
                done.extend((c, key[0], record, value) for c in sorted(clients))
        self._clients.update((sorted(clients),)) if clients else self._clients.clear()
        return done, None


def _record_id(record: str) -> Column:
    return F.coalesce(F.col(record).cast("long"), F.lit(-1))


def _through(
    rows: DataFrame, keys: Sequence[str], processor: InOrder, time: str, late: str, arrival: bool
) -> DataFrame:
    mode = "ProcessingTime" if arrival else "EventTime"
    if not arrival:
        rows = rows.withWatermark(time, late)
    kept = [c.split()[0] for c in processor.row.split(", ")]
    rows = rows.where(F.col(time).isNotNull())
    slim = rows.select(*keys, F.unix_micros(time).alias("at"), *kept[1:], time)
    return slim.groupBy(*keys).transformWithStateInPandas(
        _Slim(processor, kept), processor.out, "Append" if not arrival else "Update", mode
    )


class _Slim(StatefulProcessor):
    """Hands a processor the columns it keeps, in their order."""

    def __init__(self, processor: InOrder, columns: Sequence[str]) -> None:
        self._processor, self._columns = processor, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._processor.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        return self._processor.handleInputRows(key, (f[self._columns] for f in rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._processor.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self._processor.close()


def ended_sequences(
    stream: DataFrame, entity: str, time: str, record: str, value: str, flag: Column,
    idle_seconds: float, late: str = "10 minutes", arrival: bool = False,
) -> DataFrame:
    """Sequences that ended: ``entity, started_at, last_at, n, carried, ended_by``, times in microseconds.

    ``flag`` is ``start``, ``end`` or null. Sequences still open stay in the state.
    """
    rows = stream.select(
        F.col(entity).cast("long").alias("entity"), F.col(time).alias("seen_at"),
        _record_id(record).alias("id"), F.col(value).cast("double").alias("value"),
        flag.alias("flag"),
    )
    processor = Sequences(int(idle_seconds * 1_000_000), arrival)
    return _through(rows, ["entity"], processor, "seen_at", late, arrival)


def flushed_buffers(
    stream: DataFrame, shards: int, time: str, record: str, value: str,
    size: int = 1000, age_seconds: float = 60, late: str = "10 minutes", arrival: bool = False,
) -> DataFrame:
    """Every record with the buffer it left in: ``shard, first_at, cause, id, value``.

    Records go to ``shards`` buffers by their id.
    """
    rows = stream.select(
        F.pmod(_record_id(record), F.lit(shards)).cast("long").alias("shard"),
        F.col(time).alias("seen_at"), _record_id(record).alias("id"),
        F.col(value).cast("double").alias("value"),
    )
    processor = Buffers(size, int(age_seconds * 1_000_000), arrival)
    return _through(rows, ["shard"], processor, "seen_at", late, arrival)


def delivered(
    controls: DataFrame, records: DataFrame, late: str = "10 minutes", salts: int = 1
) -> DataFrame:
    """``client, entity, id, value``: each record once per client subscribed to its entity at its time.

    ``controls``: ``seen_at, entity, client, subscribe`` (boolean). ``records``: ``seen_at, entity, id, value``.
    With ``salts`` the records of an entity are dealt to so many states and controls go to all
    of them, for entities that hold a large part of all records.
    """
    p = Subscriptions
    kind = F.when(F.col("subscribe"), p.SUBSCRIBE).otherwise(p.UNSUBSCRIBE)
    told = controls.select(
        "seen_at", F.col("entity").cast("long").alias("entity"), kind.alias("kind"),
        F.lit(-1).cast("long").alias("id"), "client", F.lit(0.0).alias("value"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    rows = records.select(
        "seen_at", F.col("entity").cast("long").alias("entity"), F.lit(p.RECORD).alias("kind"),
        _record_id("id").alias("id"), F.lit("").alias("client"),
        F.col("value").cast("double").alias("value"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
    )
    return _through(told.unionByName(rows), ["entity", "salt"], p(), "seen_at", late, False)
