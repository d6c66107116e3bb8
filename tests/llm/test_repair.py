"""Conversation repair against every possible edit, in whole and cut into short blocks."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import oracle
import pytest

from tidewatch.llm import queries, repair

GOAL = re.compile(r"(s?(ua)+)?\Z")
INKED = re.compile(r"[^\x20\x09-\x0D]")


def by_hand(initials, faults):
    """Least (cost, audit, kept initials) over all edits with at most two inserts in one place."""
    choices = []
    for initial, fault in zip(initials, faults):
        ops = [("D", 2, "")]
        if fault not in "bd":
            extra = 5 if fault == "t" else 0
            ops += [("K", extra, initial), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        choices.append(ops)
    inserts = [("", "")] + [("I" * len(x), x) for x in ("u", "a", "ua", "au")]
    best = None
    for rows in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(initials) + 1):
            made = "".join(a[1] + r[2] for a, r in zip(added, rows)) + added[-1][1]
            if GOAL.match(made):
                audit = "".join(a[0] + r[0] for a, r in zip(added, rows)) + added[-1][0]
                found = (sum(r[1] for r in rows) + 5 * audit.count("I"), audit)
                best = min(best or found, found)
    return best


def test_searches_from_both_ends_find_the_least():
    rnd = random.Random(3)
    cases = [("".join(p), "-" * n) for n in range(4) for p in itertools.product("sua-", repeat=n)]
    cases += [
        ("".join(rnd.choices("sua-", k=n)), "".join(rnd.choices("bdt-", (1, 1, 2, 3), k=n)))
        for n in (1, 2, 3, 3, 4) for _ in range(12)
    ]
    for initials, faults in cases:
        assert repair.cheapest(initials, faults, 0, repair.ENDS, True) == by_hand(initials, faults)


def forward(initials, faults):
    """Least (cost, audit, roles by row) by one pass over rows."""
    from tidewatch.llm.repair import STEP

    held = {0: (0, "")}
    for k in range(len(initials) + 1):
        for _ in range(2):  # up to two inserts before a row
            for q, (cost, audit) in list(held.items()):
                for r, to in STEP[q].items():
                    if r != "s":
                        held[to] = min(held.get(to, (10**9, "")), (cost + 5, audit + "I"))
        if k == len(initials):
            break
        new = {}
        for q, (cost, audit) in held.items():
            ways = [(q, 2, "D")]
            if faults[k] not in "bd":
                extra = 5 if faults[k] == "t" else 0
                ways += [(to, extra, "K") for r, to in STEP[q].items() if r == initials[k]]
                ways += [(to, extra + 1, "R") for r, to in STEP[q].items() if r != "s"]
            for to, price, letter in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost + price, audit + letter))
        held = new
    return min(held[q] for q in (0, 3) if q in held)


def plain(rows):
    """What the query returns for (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for at, (conv, turn, role, text) in enumerate(rows):
        convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for copy in range({0: 0, 3: 2}.get(kind, 1)):
            digest = hashlib.sha256(text.encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0, role, digest, at, copy), role, text, turn))
    out = []
    for conv, lines in convs.items():
        lines.sort(key=lambda x: x[0])
        faults, seen = "", set()
        for _, role, text, _ in lines:
            ink = INKED.findall(text)
            fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "-"
            seen.add((role, text))
            faults += fault
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for _, r, _, _ in lines)
        cost, audit = forward(initials, faults)
        kept, queue = [], list(lines)
        for letter in audit:
            expected = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
            if letter == "I":
                kept.append((expected, ""))
                continue
            _, role, text, _ = queue.pop(0)
            if letter != "D":
                kept.append((expected if letter == "R" else role, text))
        turns = [t for *_, t in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a + b for a, b in zip(initials, initials[1:])]
        whole = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((
            conv, gaps, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256(whole.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def made(seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", " \t", "Why?  ", "é.", None, "x. \n", "long " * 2000 + "."]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "u", "sys"]
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(rnd.choice([0, 1, 2, 5, 9, 30])):
            turn = None if rnd.random() < 0.1 else turn + rnd.choice([0, 0, 0, 1, 7])
            rows.append((conv, turn, rnd.choice(roles), rnd.choice(texts)))
    rows += [(50, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(90)]
    rows += [(51, None, "user", "same.")] * 20 + [(52, 3, None, None)] * 3
    rows += [(60 + k, 0, "user", "Alone.") for k in range(60)]  # some of them are dropped whole
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("seed,length,fan", [(1, 256, 64), (2, 4, 2), (3, 1, 3)])
def test_reports(spark, seed, length, fan):
    rows = made(seed)
    frame = spark.createDataFrame(
        [(*r, 1, 2, "f", "b") for r in rows], f"{SCHEMA}, pos long, size int, fault string, block string"
    ).repartition(3)
    found = repair.Repair(repair.damage(frame), length, fan)
    assert sorted(map(tuple, found.report().select(*COLUMNS).collect()), key=repr) == plain(rows)
    turns = defaultdict(list)
    for r in sorted(found.rows.collect(), key=lambda r: (r.pos, r.place)):
        turns[r.conv_id].append(r.role[:1])
    assert turns and all(GOAL.match("".join(t)) for t in turns.values())


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert repair.Repair(repair.damage(frame)).report().count() == 0


def test_composed_blocks_are_the_whole():
    rnd = random.Random(9)
    for n in (5, 17, 40):
        initials = "".join(rnd.choices("sua-", (1, 5, 5, 1), k=n))
        faults = "".join(rnd.choices("bdt-", (1, 1, 2, 5), k=n))
        cuts = [(k, min(n, k + 3)) for k in range(0, n, 3)]
        blocks = [
            repair.block_matrix(initials[a:b], faults[a:b], a == 0, b == n) for a, b in cuts
        ]
        costs, _, paths = repair.compose([(c, repair.dense_ranks(x)) for c, x in blocks])
        states = [0, *map(int, paths[0]), 0]
        audit = "".join(x[4 * p + q] for (_, x), p, q in zip(blocks, states, states[1:]))
        assert (costs[0], audit) == forward(initials, faults)


def test_query_equals_the_twin(spark, sf_dir):
    name = "op12_conversation_repair"
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.difference(got, oracle.connect(sf_dir).execute(queries.ORACLE[name]).df()) is None
    assert got["cost"].sum() > 0 and set("".join(got["audit"])) >= set("KRD")
