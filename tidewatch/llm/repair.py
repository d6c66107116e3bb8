"""Repair of conversation structure by the cheapest edits, found from both ends.

The rows of a conversation, in order, and a small automaton for ``(s?(ua)+)?`` over role initials
span a lattice: node (i, q) has i rows handled and the automaton in q. Edges keep, re-role or
delete a row, or insert an empty turn. One heap runs forward from the start, one backward
from the end; they go on until no unseen crossing can be as cheap as the best, and of all
crossings of that cost the one with the least concatenated audit is taken. Labels of one node and cost are never
prefixes of each other, so the least label of either side is the least part of the whole.

A conversation may be of any length. It is cut into blocks of ``BLOCK`` rows, each searched from every state
to every state; inserts belong to the row after them, so audits of a block are prefix-free
and compare by their rank in it. Matrices of (cost, rank) are then composed ``FAN`` at a time, level by
level, and the chosen states handed down again. Texts take no part in this; they meet the edits by row number
and only their digest, which is one value over the conversation, passes them through one task, as a stream.

Null roles and texts count as one space, as in ``damage``; a null conversation id is a conversation. Rows with equal turns
follow each other by role and digest of the text. Extra columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import materialise
from tidewatch.llm.ranks import ranked, same_group

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLOCK, FAN, LINES = 256, 64, 64
ROLES = {"u": "user", "a": "assistant"}
# states: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
BACK = {q: [(p, r) for p in STEP for r in STEP[p] if STEP[p][r] == q] for q in STEP}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
BLANK, REPEATED, TRUNCATED, FINE = "b", "d", "t", "-"
DAMAGES = 20


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged by a hash of conversation and turn.

    Nulls become one space; ``copies`` is 0 for a dropped row and 2 for a repeated one.
    """
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    key = F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")
    kind = F.crc32(key) % DAMAGES
    text = F.when(kind == 1, "").when(kind == 2, F.translate(named("text"), ".!?", ""))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(named("role")).alias("role"),
        text.otherwise(named("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _edges(initials: str, faults: str, closing: bool, i: int, q: int) -> Iterator[tuple]:
    """(node, cost, letter) reached from (i, q)."""
    n = len(initials)
    if i < n or closing:
        for r in STEP[q]:
            if r in ROLES:
                yield (i, STEP[q][r]), INSERT, "I"
    if i < n:
        yield (i + 1, q), DELETE, "D"
        if faults[i] not in (BLANK, REPEATED):
            extra = CUT if faults[i] == TRUNCATED else 0
            for r, to in STEP[q].items():
                if r == initials[i]:
                    yield (i + 1, to), extra, "K"
                if r in ROLES:
                    yield (i + 1, to), REROLE + extra, "R"


def _edges_back(initials: str, faults: str, closing: bool, i: int, q: int) -> Iterator[tuple]:
    """(node, cost, letter) from which (i, q) is reached."""
    if i < len(initials) or closing:
        for p, r in BACK[q]:
            if r in ROLES:
                yield (i, p), INSERT, "I"
    if i:
        yield (i - 1, q), DELETE, "D"
        if faults[i - 1] not in (BLANK, REPEATED):
            extra = CUT if faults[i - 1] == TRUNCATED else 0
            for p, r in BACK[q]:
                if r == initials[i - 1]:
                    yield (i - 1, p), extra, "K"
                if r in ROLES:
                    yield (i - 1, p), REROLE + extra, "R"


def cheapest(
    initials: str, faults: str, start: int, goals: Sequence[int], closing: bool
) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits that lead from ``start`` to one of ``goals``.

    ``closing`` allows inserts after the last row. Among labels of equal cost the
    rows nearer to a side's own end are settled first: edges without cost lead away from it, so a
    label is final when it is settled.
    """
    n = len(initials)
    ahead, behind = {(0, start): (0, "")}, {(n, q): (0, "") for q in goals}
    heap, back = [(0, 0, start)], [(0, -n, q) for q in goals]
    heapq.heapify(back)
    done: set = set()
    done_back: set = set()
    best = None
    while heap and back and (best is None or heap[0][0] + back[0][0] <= best):
        forward = heap[0][0] <= back[0][0]
        queue, labels, seen = (heap, ahead, done) if forward else (back, behind, done_back)
        others = behind if forward else ahead
        cost, place, q = heapq.heappop(queue)
        node = (abs(place), q)
        if node in seen:
            continue
        seen.add(node)
        audit = labels[node][1]
        edges = (_edges if forward else _edges_back)(initials, faults, closing, *node)
        if node in others:
            best = min(best, cost + others[node][0]) if best is not None else cost + others[node][0]
        for to, price, letter in edges:
            found = (cost + price, audit + letter if forward else letter + audit)
            known = labels.get(to)
            if known is None or found < known:
                labels[to] = found
                if known is None or found[0] < known[0]:
                    heapq.heappush(queue, (found[0], to[0] if forward else -to[0], to[1]))
                if to in others:
                    total = found[0] + others[to][0]
                    best = total if best is None else min(best, total)
    if best is None:
        return None
    return best, min(
        label[1] + behind[v][1] for v, label in ahead.items()
        if v in behind and label[0] + behind[v][0] == best
    )


def block_matrix(initials: str, faults: str, first: bool, last: bool) -> tuple[list, list]:
    """Costs (-1: no way) and audits from state to state; a last block has its end at 0."""
    costs, audits = [-1] * 16, [None] * 16
    for start in (0,) if first else STEP:
        for goal in (0,) if last else STEP:
            found = cheapest(initials, faults, start, ENDS if last else (goal,), last)
            if found:
                costs[4 * start + goal], audits[4 * start + goal] = found
    return costs, audits


def dense_ranks(values: Sequence) -> list[int]:
    places = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}))}
    return [-1 if v is None else places[v] for v in values]


def compose(parts: Sequence[tuple[Sequence[int], Sequence[int]]]) -> tuple[list, list, list]:
    """Costs, ranks and inner states of consecutive (costs, ranks)."""
    costs, ranks, paths = list(parts[0][0]), list(parts[0][1]), [""] * 16
    for more, order in parts[1:]:
        new_costs, keys, new_paths = [-1] * 16, [None] * 16, [""] * 16
        for q in STEP:
            for to in STEP:
                ways = [
                    (costs[4 * q + m] + more[4 * m + to], ranks[4 * q + m], order[4 * m + to], m)
                    for m in STEP if costs[4 * q + m] >= 0 and more[4 * m + to] >= 0
                ]
                if ways:
                    cost, low, high, m = min(ways)
                    new_costs[4 * q + to], keys[4 * q + to] = cost, (low, high)
                    new_paths[4 * q + to] = paths[4 * q + m] + str(m)
        costs, ranks, paths = new_costs, dense_ranks(keys), new_paths
    return costs, ranks, paths


def decisions(initials: str, start: int, audit: str) -> list[tuple[list[str], bool, str | None]]:
    """Per row, and once more for the end: roles inserted before it, whether it stays, its new role."""
    out, before, q, i = [], [], start, 0
    for letter in audit:
        if letter in "IR":  # these states go on in one way, but for the start, where the user comes
            r = next(r for r in STEP[q] if r in ROLES)
        if letter == "I":
            before.append(ROLES[r])
            q = STEP[q][r]
            continue
        if letter == "K":
            q = STEP[q][initials[i]]
        elif letter == "R":
            q = STEP[q][r]
        out.append((before, letter != "D", ROLES[r] if letter == "R" else None))
        before, i = [], i + 1
    return [*out, (before, False, None)]


def _rowwise(rows: DataFrame, schema: str, one) -> DataFrame:
    """Arrow batches through ``one``: dict of a row to an iterable of tuples."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

    def kind(text: str) -> pa.DataType:
        return pa.list_(kind(text[6:-1])) if text.startswith("array<") else kinds[text]

    arrow = pa.schema([(c.split()[0], kind(c.split()[1])) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = [t for row in batch.slice(at, 1000).to_pylist() for t in one(row)]
                if found:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*found), arrow)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


BLOCKS = (
    "conv_id long, size long, block long, blank long, duplicate long, truncated long, illegal long, "
    "initials string, rows array<long>, costs array<long>, ranks array<int>, audits array<string>"
)


def _blocks(lined: DataFrame, length: int) -> DataFrame:
    """The searched blocks of ``conv_id, pos, size, row, initial, fault``; a row that ends a block is
    also shown to the next one, for the pair of the two."""
    own = F.struct(F.expr(f"pos div {length}L").alias("block"), F.lit(False).alias("seen"))
    next_one = F.struct(F.expr(f"pos div {length}L + 1").alias("block"), F.lit(True).alias("seen"))
    ends = (F.col("pos") % length == length - 1) & (F.col("pos") + 1 < F.col("size"))
    at = F.explode(F.when(ends, F.array(own, next_one)).otherwise(F.array(own)))
    run = F.array_sort(F.collect_list(F.struct("pos", "at.seen", "initial", "fault", "row")))
    grouped = lined.withColumn("at", at).groupBy("conv_id", "size", "at.block").agg(run.alias("run"))

    def search(r: dict) -> Iterator[tuple]:
        run, block = r["run"], r["block"]
        chain = "".join(x["initial"] for x in run)
        illegal = sum(a + b not in LEGAL for a, b in zip(chain, chain[1:]))
        own = [x for x in run if not x["seen"]]
        initials, faults = ("".join(x[c] for x in own) for c in ("initial", "fault"))
        last = (block + 1) * length >= r["size"]
        costs, audits = block_matrix(initials, faults, block == 0, last)
        yield (
            r["conv_id"], r["size"], block, *(faults.count(f) for f in (BLANK, REPEATED, TRUNCATED)),
            illegal, initials, [x["row"] for x in own], costs, dense_ranks(audits), audits,
        )

    return _rowwise(grouped, BLOCKS, search)


COMPOSED = (
    "conv_id long, block long, count long, costs array<long>, ranks array<int>, paths array<string>"
)


def _composed(level: DataFrame, fan: int) -> DataFrame:
    run = F.array_sort(F.collect_list(F.struct("block", "costs", "ranks")))
    groups = level.where("count > 1").groupBy(
        "conv_id", F.expr(f"block div {fan}L").alias("block"), "count"
    ).agg(run.alias("run"))

    def one(r: dict) -> Iterator[tuple]:
        found = compose([(x["costs"], x["ranks"]) for x in r["run"]])
        yield (r["conv_id"], r["block"], -(-r["count"] // fan), *found)

    return _rowwise(groups, COMPOSED, one)


def _chosen(blocks: DataFrame, length: int, fan: int) -> DataFrame:
    """``conv_id, block, start, goal, cost``: the states between which each block is passed; the
    cost of the whole conversation."""
    count = F.ceil(F.col("size") / length).cast("long").alias("count")
    levels = [blocks.select("conv_id", "block", count, "costs", "ranks")]
    longest = blocks.agg(F.max(F.col("block"))).first()[0] or 0
    while longest:
        levels.append(materialise(_composed(levels[-1], fan), "repair-levels"))
        longest //= fan
    chosen = None
    for k in reversed(range(len(levels))):
        whole = levels[k].where("count = 1").select(
            "conv_id", "block", F.lit(0).alias("start"), F.lit(0).alias("goal"),
            F.col("costs")[0].alias("cost"),
        )
        chosen = whole if chosen is None else chosen.unionByName(whole)
        if k:
            left, right = chosen.alias("l"), levels[k].alias("r")
            at = F.col("start") * 4 + F.col("goal") + 1
            inner = F.split(F.element_at("r.paths", at), "")  # '' gives ['']
            inner = F.filter(inner, lambda q: q != "").cast("array<int>")
            states = F.concat(F.array("start"), inner, F.array("goal"))
            pairs = F.transform(
                F.slice(states, 1, F.size(states) - 1),
                lambda q, j: F.struct(
                    (F.col("l.block") * fan + j).alias("block"), q.alias("start"),
                    F.element_at(states, j + 2).alias("goal"),
                ),
            )
            joined = left.join(right, same_group("l", "r", ["conv_id", "block"]))
            chosen = joined.select(
                F.col("l.conv_id").alias("conv_id"), "cost", F.explode(pairs).alias("p")
            ).select("conv_id", "p.*", "cost")
    return chosen


EDITS = (
    "conv_id long, pos long, row long, before array<string>, stays boolean, new_role string"
)


class Repair:
    """``report``: one row per conversation; ``rows``: the repaired turns,
    ``conv_id, pos, place, role, text``, in the order of pos and place."""

    def __init__(self, damaged: DataFrame, length: int = BLOCK, fan: int = FAN) -> None:
        last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
        first = F.substring("role", 1, 1)
        held = materialise(
            damaged.select(
                F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "copies",
                F.monotonically_increasing_id().alias("row"),
                F.unhex(F.sha2("text", 256)).alias("digest"),
                F.when(first.isin("s", "u", "a"), first).otherwise("-").alias("initial"),
                F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE)
                .otherwise(TRUNCATED).alias("fault"),
            ),
            "repair-rows",
        )
        each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
        light = held.where("copies > 0").select(
            "conv_id", "turn", "role", "digest", "initial", "fault", "row", each
        )
        order = ["turn", "role", "digest", "row", "copy"]
        lined = materialise(
            ranked(light, ["conv_id"], order, "repair-order", "pos", "size"), "repair-ranks"
        )
        firsts = lined.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(
            F.min("pos").alias("pos")
        )
        known = lined.alias("l").join(
            firsts.select("conv_id", "pos", F.lit(True).alias("new")).alias("r"),
            same_group("l", "r", ["conv_id", "pos"]), "left",
        )
        fault = F.when((F.col("l.fault") != BLANK) & F.col("r.new").isNull(), REPEATED)
        marked = known.select("l.conv_id", "l.pos", "size", "row", "initial",
                              fault.otherwise(F.col("l.fault")).alias("fault"))
        blocks = materialise(_blocks(marked, length), "repair-blocks")
        chosen = _chosen(blocks, length, fan).alias("l").join(
            blocks.alias("r"), same_group("l", "r", ["conv_id", "block"])
        )
        picked = F.element_at("audits", F.col("start") * 4 + F.col("goal") + 1)
        self._blocks = materialise(
            chosen.select(
                *[F.col(f"r.{c}") for c in blocks.columns[:9]], "start", "cost",
                picked.alias("audit"),
            ),
            "repair-chosen",
        )
        self._held, self._lined, self._length = held, lined, length
        self.rows = self._rows()

    def _rows(self) -> DataFrame:
        length = self._length

        def one(r: dict) -> Iterator[tuple]:
            made = decisions(r["initials"], r["start"], r["audit"])
            for k, (before, stays, role) in enumerate(made):
                if before or stays:
                    row = r["rows"][k] if stays else None
                    yield (r["conv_id"], r["block"] * length + k, row, before, stays, role)

        edits = materialise(
            _rowwise(
                self._blocks.select("conv_id", "block", "initials", "rows", "start", "audit"),
                EDITS, one,
            ),
            "repair-edits",
        )
        texts = self._held.select("row", "role", "text")
        kept = edits.where("stays").join(texts, "row").select(
            "conv_id", "pos", F.size("before").alias("place"),
            F.coalesce("new_role", "role").alias("role"), "text",
        )
        added = edits.select("conv_id", "pos", F.posexplode("before").alias("place", "role"))
        return kept.unionByName(added.withColumn("text", F.lit("")))

    def report(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
        turns = self._lined.groupBy("conv_id").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
        )
        counts = ["blank", "duplicate", "truncated", "illegal"]
        audit = F.array_sort(F.collect_list(F.struct("block", "audit")))
        found = self._blocks.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in counts], F.max("cost").alias("cost"), audit.alias("audit")
        ).withColumn("audit", F.array_join(F.transform("audit", lambda a: a["audit"]), ""))
        every = self._held.select("conv_id").distinct()
        parts = every
        for part in (turns, found, line_digests(self.rows)):
            parts = parts.unionByName(part, allowMissingColumns=True)
        longs = ["gaps", *counts, "cost"]
        empty = hashlib.sha256(b"").hexdigest()
        return parts.groupBy("conv_id").agg(
            *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs],
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"),
        )


def line_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of ``role:text`` lines joined by newlines.

    ``LINES`` neighbouring rows are joined first; the runs of a conversation then pass one task in
    order, which holds one run and the state of the digest.
    """
    line = F.concat_ws(":", "role", "text")
    run = F.array_sort(F.collect_list(F.struct("pos", "place", line.alias("line"))))
    runs = rows.groupBy("conv_id", F.expr(f"pos div {LINES}L").alias("run")).agg(run.alias("lines"))
    joined = runs.select(
        "conv_id", "run", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("lines")
    )
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                conv, lines = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if state is not None and conv == current:
                    state.update(b"\n")
                else:
                    if state is not None:
                        out.append((current, state.hexdigest()))
                    current, state = conv, hashlib.sha256()
                state.update(lines.encode())
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()), pa.array([state.hexdigest()])], schema=schema
            )

    return (
        joined.repartition("conv_id").sortWithinPartitions("conv_id", "run")
        .mapInArrow(digest, "conv_id long, repaired_sha256 string")
    )
