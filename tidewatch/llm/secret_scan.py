"""Secrets in text: fixed patterns, and a character network over every other candidate.

Three patterns give the base findings. A candidate is any run of key characters as
long as the least value of the patterns, or the part of it that base findings leave open. The
network reads the whole candidate with the characters around it and is fitted here on
labelled runs: those in which a base finding ends are secrets, those that none touches are not.
A candidate counts with the highest of its blocks, in the fit as in the scan.

The fit starts from a few labelled runs and then takes all of them: hashes deal the documents to shards, each
trains a copy on all its runs, and the copies are averaged. Runs whose value has a certain
hash are left out. All of these calibrate the scores, and the threshold is the highest that
still finds the wanted share of them, to ``1 / STEPS`` of a logit.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import id_and_text, materialise, smallest_hashes
from tidewatch.llm.tokens import in_chunks

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

KEY_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]*")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_VALUE)
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
LEAST_CANDIDATE = 12
CONTEXT, BLOCK = 16, 64
WINDOW = BLOCK + 2 * CONTEXT
# blocks scored at once
SCORED_AT_ONCE = 1024

# the fit on all labelled candidates starts from this many of each kind
SAMPLE = 3_000
SHARD_CANDIDATES, STEP_CANDIDATES, STEP_SECRETS = 500_000, 4096, 256
COPY_RATE, MARGIN = 0.001, 4.0
STEPS, MOST_LOGIT = 1000, 200
CALIBRATION_SHARE = 4  # one in so many is kept for calibration
RECALL = 0.98
EPOCHS, BATCH, RATE = 6, 64, 0.004
CHARACTERS, WIDTH, KERNEL, FILTERS = 128, 8, 5, 24
LEAST_ROWS = 20

# what base findings say of a run: none touches it, one ends in it, or they leave this part open
FREE, SECRET, REST = range(3)
FOUND = (
    "doc_id long, kind int, label int, start int, end int, order long, n long, "
    "left string, value string, right string"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    if "=" in text or ":" in text:
        out += [
            (0, m.start(), m.end())
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= LEAST_VALUE
        ]
    if "AKIA" in text:
        out += [
            (1, m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST_ACCESS
        ]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Whole runs of key characters of some length that hold a digit and a letter."""
    out, place = [], 0
    while (found := DIGIT.search(text, place)) is not None:
        start = found.start()
        while start > place and text[start - 1] in KEY_CHARACTERS:
            start -= 1
        place = RUN.match(text, found.start()).end()
        if place - start >= LEAST_CANDIDATE and LETTER.search(text, start, place):
            out.append((start, place))
    return out


def runs(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, state)`` of every run of key characters as long as the least value.

    A run that a base finding touches gives the parts of that length which none covers, and itself
    as ``SECRET`` where a finding ends in it, so that the word before a value is not one.
    """
    covered: list[list[int]] = []
    for _, a, b in found:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    ends = sorted(b for _, _, b in found)
    out, k = [], 0
    for run in LONG_RUN.finditer(text):
        a, b = run.span()
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k == len(covered) or covered[k][0] >= b:
            out.append((a, b, FREE))
            continue
        if bisect_right(ends, b) > bisect_right(ends, a):
            out.append((a, b, SECRET))
        at, j = a, k
        while j < len(covered) and covered[j][0] < b:
            if covered[j][0] - at >= LEAST_VALUE:
                out.append((at, covered[j][0], REST))
            at, j = covered[j][1], j + 1
        if b - at >= LEAST_VALUE:
            out.append((at, b, REST))
    return out


def findings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """Labelled candidates with the characters around them, one per row.

    ``kind`` 1 are secrets; the others are long runs with a digit and a letter (0) and all the
    rest (2). Of a batch of rows the ``sample`` smallest hashes of each kind stay, and the
    first of them has in ``n`` how many there were.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kind", "label", "start", "end", "order", "n", "left", "value", "right"]
        types = [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 2, *[pa.string()] * 3]
        for batch in batches:
            held: list[list[tuple]] = [[], [], []]
            totals = [0, 0, 0]
            for keys, texts in in_chunks(batch):
                for key, whole in zip(keys, texts):
                    for a, b, state in runs(whole, base_spans(whole)):
                        if state == REST:
                            continue
                        value, left = whole[a:b], whole[max(0, a - CONTEXT) : a]
                        plain = (
                            b - a < LEAST_CANDIDATE or not DIGIT.search(value) or not LETTER.search(value)
                        )
                        kind = 1 if state == SECRET else 2 * plain
                        name = f"{value}\0{left}\0{a}\0{key}".encode()
                        order = xxhash.xxh64_intdigest(name) - (1 << 63)
                        totals[kind] += 1
                        held[kind].append(
                            (order, value, left, whole[b : b + CONTEXT], a, b, -1 if key is None else key, key)
                        )
                for kind, rows in enumerate(held):
                    held[kind] = heapq.nsmallest(sample, rows)
            out = [
                (key, kind, int(kind == 1), a, b, order, 0 if k else totals[kind], left, value, right)
                for kind, rows in enumerate(held)
                for k, (order, value, left, right, a, b, _, key) in enumerate(rows)
            ]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

    return id_and_text(docs, doc_id, text).mapInArrow(run, FOUND)


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(raw < CHARACTERS, raw, 1).astype(np.int64)


def blocks(left: str, value: str, right: str) -> list[np.ndarray]:
    """The candidate and its surroundings in blocks of fixed length.

    Characters of the candidate are marked by an offset. A candidate longer than a block
    gives several, so every character is read; 0 fills.
    """
    whole = np.concatenate([_codes(left), _codes(value) + CHARACTERS, _codes(right)])
    step, size = BLOCK, BLOCK + 2 * CONTEXT
    out = []
    for at in range(0, max(1, len(value)), step):
        start = max(0, len(left) + at - CONTEXT)
        part = whole[start : start + size]
        out.append(np.pad(part, (0, size - len(part))))
    return out


@dataclass
class Network:
    """Embedding, one convolution, maximum over places, a logistic output; then calibration."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rnd = np.random.default_rng(seed)
        return Network(
            rnd.normal(0, 0.3, (2 * CHARACTERS, WIDTH)),
            rnd.normal(0, (2 / (KERNEL * WIDTH)) ** 0.5, (KERNEL * WIDTH, FILTERS)),
            np.zeros(FILTERS), rnd.normal(0, 0.3, FILTERS), np.zeros(1),
        )

    def _forward(self, x: np.ndarray) -> tuple:
        seen = self.embed[x] * (x != 0)[:, :, None]
        places = x.shape[1] - KERNEL + 1
        cols = np.concatenate([seen[:, k : k + places] for k in range(KERNEL)], axis=2)
        act = cols @ self.kernel + self.shift
        best = act.argmax(axis=1)
        top = np.take_along_axis(act, best[:, None, :], axis=1)[:, 0]
        pooled = np.maximum(top, 0)
        return cols, best, top, pooled, pooled @ self.out + self.bias[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [self._forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)] or [np.zeros(0)]
        )

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        cols, best, top, pooled, z = self._forward(x)
        err = (1 / (1 + np.exp(-z)) - y) / len(y)
        d_top = err[:, None] * self.out * (top > 0)
        picked = np.take_along_axis(cols, best[:, :, None], axis=1)  # row, filter, input
        d_kernel = np.einsum("bf,bfi->if", d_top, picked)
        d_seen = np.zeros((*x.shape, WIDTH))
        back = d_top[:, :, None] * self.kernel.T[None]  # row, filter, input
        rows = np.arange(len(x))[:, None]
        for k in range(KERNEL):
            np.add.at(d_seen, (rows, best + k), back[:, :, k * WIDTH : (k + 1) * WIDTH])
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, x[x != 0], d_seen[x != 0])
        return [d_embed, d_kernel, d_top.sum(0), pooled.T @ err, np.array([err.sum()])]

    def fit(
        self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = EPOCHS
    ) -> None:
        """``starts`` has each candidate's first block; the gradient is that of its highest one."""
        ends = np.append(starts[1:], len(x))
        rnd = np.random.default_rng(seed)
        held = [self.embed, self.kernel, self.shift, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
        step = 0
        for _ in range(epochs):
            order = rnd.permutation(len(y))
            for at in range(0, len(y), BATCH):
                rows = order[at : at + BATCH]
                best = starts[rows].copy()
                for k in np.flatnonzero(ends[rows] - best > 1):
                    best[k] += self.logits(x[best[k] : ends[rows[k]]]).argmax()
                part = x[best]
                # without its surroundings half of the time, so the value itself must tell
                part[(part < CHARACTERS) & (rnd.random(len(rows)) < 0.5)[:, None]] = 0
                step += 1
                for p, g, m, v in zip(held, self.gradients(part, y[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(
        self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, recall: float = RECALL
    ) -> None:
        """Logistic scaling of the logits, then the highest threshold with that recall."""
        z = np.maximum.reduceat(self.logits(x), starts)
        self.calibrate_counts(z, y, np.ones(len(z)), recall)

    def calibrate_counts(
        self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL
    ) -> None:
        """``calibrate`` from logits and labels that ``n`` candidates share."""
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = n * (p * (1 - p) + 1e-6)
            off = n * (p - y)
            g = np.array([(off * z).sum() + 0.01 * (a - 1), off.sum()])
            h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum()]])
            move = np.linalg.solve(h + 1e-6 * np.eye(2), g)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        self.scale, self.offset = float(a), float(b)
        good, order = n[y == 1], np.argsort(z[y == 1])
        at = np.searchsorted(np.cumsum(good[order]), np.floor((1 - recall) * good.sum()), "right")
        self.threshold = float(self._scaled(z[y == 1][order[at]]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(self.logits(x))

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        z = self.scale * z + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, left: str, value: str, right: str) -> float:
        """The highest score of the candidate's blocks."""
        return float(self.scores(np.stack(blocks(left, value, right))).max())

    NAMES = ("embed", "kernel", "shift", "out", "bias")

    def tables(self) -> tuple[np.ndarray, ...]:
        """What characters add at the first two, the next two and the last place of the kernel."""
        assert KERNEL == 5
        parts = [
            np.where(np.arange(2 * CHARACTERS)[:, None] == 0, 0, self.embed @ part).astype(np.float32)
            for part in np.split(self.kernel, KERNEL)
        ]
        pairs = [(parts[k][:, None] + parts[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2)]
        return *pairs, parts[4]

    def score_all(self, texts: list[str], places: list[list[tuple[int, int]]]) -> np.ndarray:
        """``score`` of all candidates of the texts, one after another."""
        return self._scaled(self.logits_all(Layout(texts, places)))

    def logits_all(self, laid: Layout) -> np.ndarray:
        """The highest logit of each candidate's blocks."""
        tables, z = self.tables(), np.empty(len(laid.owner))
        for rows, codes in laid.groups():
            pooled = np.maximum(_convolved(tables, codes).max(axis=0) + self.shift, 0)
            z[rows] = pooled @ self.out + self.bias[0]
        best = np.full(laid.candidates, -np.inf)
        np.maximum.at(best, laid.owner, z)
        return best

    def margin_gradients(self, laid: Layout, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss of either label; it falls to 0 in a parabola up to ``MARGIN``."""
        tables, z = self.tables(), np.empty(len(laid.owner))
        tops = np.empty((len(z), FILTERS))
        for rows, codes in laid.groups():
            tops[rows] = _convolved(tables, codes).max(axis=0) + self.shift
        z[:] = np.maximum(tops, 0) @ self.out + self.bias[0]
        # of blocks of one candidate the highest, the first of equal ones
        order = np.lexsort((np.arange(len(z)), -z, laid.owner))
        best = np.zeros(len(z), bool)
        best[order[np.flatnonzero(np.diff(laid.owner[order], prepend=-1))]] = True
        sign = 2 * y[laid.owner] - 1
        share = np.where(sign > 0, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
        err = np.where(best, -sign * share * np.maximum(0, 1 - sign * z / MARGIN), 0)
        out = [np.zeros_like(getattr(self, k)) for k in self.NAMES]
        out[3] += np.maximum(tops, 0).T @ err
        out[4] += err.sum()
        slopes = np.zeros((KERNEL, 2 * CHARACTERS * FILTERS))
        for rows, codes in laid.groups():
            open_ = np.flatnonzero(err[rows])
            if not len(open_):
                continue
            rows, codes = rows[open_], codes[:, open_]
            at = _convolved(tables, codes).argmax(axis=0)  # row, filter
            d_top = err[rows, None] * self.out * (tops[rows] > 0)
            out[2] += d_top.sum(axis=0)
            for k in range(KERNEL):
                seen = codes[at + k, np.arange(len(rows))[:, None]] * FILTERS + np.arange(FILTERS)
                slopes[k] += np.bincount(seen.ravel(), d_top.ravel(), slopes.shape[1])
        for k, part in enumerate(slopes.reshape(KERNEL, 2 * CHARACTERS, FILTERS)):
            part[0] = 0  # nothing stands there
            own = slice(k * WIDTH, (k + 1) * WIDTH)
            out[0] += part @ self.kernel[own].T
            out[1][own] = self.embed.T @ part
        return out

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def unpacked(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for k in self.NAMES:
            like = getattr(self, k)
            out.append(flat[at : at + like.size].reshape(like.shape).copy())
            at += like.size
        return Network(*out)


class Layout:
    """The blocks of all candidates of some texts; ``bare`` ones without their surroundings."""

    def __init__(
        self, texts: list[str], places: list[list[tuple[int, int]]], bare: np.ndarray | None = None
    ) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.whole = _codes("".join(texts)).astype(np.int32)
        before = np.cumsum(lengths) - lengths
        text = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        spans = np.array([s for p in places for s in p], np.int64).reshape(-1, 2)
        self.a, self.b = spans.T + before[text]
        self.candidates = len(spans)
        around = CONTEXT if bare is None else np.where(bare, 0, CONTEXT)
        first = np.maximum(self.a - around, before[text])
        last = np.minimum(self.b + around, before[text] + lengths[text])
        parts = -(-(self.b - self.a) // BLOCK)
        self.owner = np.repeat(np.arange(self.candidates), parts)
        at = np.arange(len(self.owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.maximum(first[self.owner], self.a[self.owner] + at * BLOCK - CONTEXT)
        self.size = np.minimum(WINDOW, last[self.owner] - self.start)
        self.order = np.argsort(self.size, kind="stable")

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of about equal length, and their characters, one row per place."""
        for k in range(0, len(self.order), SCORED_AT_ONCE):
            rows = self.order[k : k + SCORED_AT_ONCE]
            # one place of padding alone is enough
            steps = np.arange(min(WINDOW, int(self.size[rows[-1]]) + KERNEL))[:, None]
            here = self.start[rows] + steps
            mine = self.owner[rows]
            codes = np.take(self.whole, here, mode="clip")
            codes += CHARACTERS * ((here >= self.a[mine]) & (here < self.b[mine]))
            codes[steps >= self.size[rows]] = 0
            yield rows, codes


def _convolved(tables: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """By place, row and filter, without the shift."""
    n = len(codes) - KERNEL + 1
    pairs = codes[:-1] * (2 * CHARACTERS) + codes[1:]
    out = np.take(tables[0], pairs[:n], axis=0, mode="clip")
    out += np.take(tables[1], pairs[2 : n + 2], axis=0, mode="clip")
    out += np.take(tables[2], codes[4:], axis=0, mode="clip")
    return out


def labelled(found: DataFrame, sample: int = SAMPLE) -> list:
    """At most ``sample`` candidates of each label, those with the smallest hash of their text.

    Half of those that are no secret are long runs with a digit and a letter, as far as there are
    so many; prose would leave few of them.
    """
    totals = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    mixed, secret, plain = (totals.get(kind, 0) for kind in range(3))
    n = min(mixed, max(sample - sample // 2, sample - plain))
    wanted = (n, min(secret, sample), min(plain, sample - n))
    out = []
    for kind in (0, 2, 1):
        part = found.where(F.col("kind") == kind).select("label", "left", "value", "right", "order")
        if wanted[kind]:
            out += smallest_hashes(part, "order", wanted[kind], totals[kind]).collect()
    return out


def _blocks(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of the candidates, and the place of each one's first."""
    parts = [np.stack(blocks(r["left"], r["value"], r["right"])).astype(np.int16) for r in rows]
    sizes = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.cumsum(sizes) - sizes


def train(found: DataFrame, sample: int = SAMPLE, recall: float = RECALL) -> Network | None:
    """A fitted and calibrated network, or none with too few labelled candidates.

    Values that share a hash fall in the same part, so none is both fitted and calibrated on.
    """
    rows = labelled(found, sample)
    y = np.array([r["label"] for r in rows], np.float64)
    if not LEAST_ROWS <= y.sum() <= len(y) - LEAST_ROWS:
        return None
    kept = np.array([_of_calibration(r["value"]) for r in rows])
    if not (0 < y[kept].sum() < kept.sum()) or not (0 < y[~kept].sum() < (~kept).sum()):
        return None
    network = Network.fresh()
    network.fit(*_blocks([r for r, k in zip(rows, kept) if not k]), y[~kept])
    network.calibrate(*_blocks([r for r, k in zip(rows, kept) if k]), y[kept], recall)
    return network


def _of_calibration(value: str) -> bool:
    return zlib.crc32(value.encode()) % CALIBRATION_SHARE == 0


def _learn(network: Network, start: list, shard: int, rows: Iterator[str]) -> tuple[Network, int]:
    """A copy trained on all labelled candidates of the texts, and their number.

    A step takes those of the next texts, and secrets of the start and of texts before, so that it
    always has both labels.
    """
    rnd = np.random.default_rng(shard)
    copy = network.unpacked(network.packed())
    held = [getattr(copy, k) for k in copy.NAMES]
    first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    known, fresh = list(start), 0
    steps = total = waiting = 0
    texts: list[str] = []
    places: list[list[tuple[int, int]]] = []
    labels: list[int] = []

    def step() -> None:
        nonlocal steps, total, waiting
        drawn = [known[k] for k in rnd.integers(0, len(known), STEP_SECRETS)]
        y = np.array(labels + [1] * len(drawn), np.float64)
        laid = Layout(
            texts + ["".join(parts) for parts in drawn],
            places + [[(len(left), len(left) + len(value))] for left, value, _ in drawn],
            # half of the time without its surroundings, so the value itself must tell
            rnd.random(len(y)) < 0.5,
        )
        steps += 1
        total += len(labels)
        for p, g, m, v in zip(held, copy.margin_gradients(laid, y), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= COPY_RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        for x in (texts, places, labels):
            x.clear()
        waiting = 0

    for whole in rows:
        mine = [
            (a, b, int(state == SECRET))
            for a, b, state in runs(whole, base_spans(whole))
            if state != REST and not _of_calibration(whole[a:b])
        ]
        for a, b, label in mine:
            if label:
                # the first places of the list stay those of the start
                secret = (whole[max(0, a - CONTEXT) : a], whole[a:b], whole[b : b + CONTEXT])
                if len(known) < len(start) + SAMPLE:
                    known.append(secret)
                else:
                    known[len(start) + fresh % SAMPLE] = secret
                fresh += 1
        for k in range(0, len(mine), STEP_CANDIDATES):
            part = mine[k : k + STEP_CANDIDATES]
            low, high = max(0, part[0][0] - CONTEXT), max(b for _, b, _ in part) + CONTEXT
            texts.append(whole[low:high])
            places.append([(a - low, b - low) for a, b, _ in part])
            labels.extend(label for *_, label in part)
            waiting += len(part)
            if waiting >= STEP_CANDIDATES:
                step()
    if waiting:
        step()
    return copy, total


def train_on_all(docs: DataFrame, network: Network, start: list, candidates: int) -> Network:
    """The mean of copies trained on all labelled candidates outside the calibration part.

    Documents go to shards, and follow each other there, by hashes of id and text, so the mean
    does not depend on how the table is cut into tasks. ``start`` has some secrets.
    """
    shards = max(1, -(-candidates // SHARD_CANDIDATES))
    tasks = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = (
        docs.select(
            F.pmod(F.xxhash64("text", "doc_id"), F.lit(shards)).alias("shard"),
            F.xxhash64("doc_id", "text").alias("at"), "doc_id", "text",
        )
        .repartitionById(tasks, (F.col("shard") % tasks).cast("int"))
        .sortWithinPartitions("shard", "at", "doc_id", "text")
        .select("shard", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (shard.as_py(), text.as_py())
            for batch in batches
            for shard, text in zip(batch.column(0), batch.column(1))
        )
        for shard, mine in groupby(rows, itemgetter(0)):
            copy, n = _learn(network, start, shard, (text for _, text in mine))
            weights = copy.packed()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(weights)), pa.int32()), pa.array(weights * n, pa.float64()),
                    pa.array([n] * len(weights), pa.int64()),
                ],
                names=["place", "total", "n"],
            )

    copies = dealt.mapInArrow(run, "place int, total double, n long").groupBy("place")
    mean = copies.agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    found = mean.orderBy("place").collect()  # one row per weight
    if not found or not found[0]["n"]:
        return network
    # sums of copies in another order differ in the last digits
    return network.unpacked(np.round([r["mean"] for r in found], 9))


def calibrate_on_all(docs: DataFrame, network: Network, recall: float = RECALL) -> None:
    """Scales and threshold from all labelled candidates of the calibration part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in in_chunks(batch):
                places, labels = [], []
                for whole in texts:
                    mine = [
                        (a, b, int(state == SECRET))
                        for a, b, state in runs(whole, base_spans(whole))
                        if state != REST and _of_calibration(whole[a:b])
                    ]
                    places.append([(a, b) for a, b, _ in mine])
                    labels.extend(label for *_, label in mine)
                z = np.clip(network.logits_all(Layout(texts, places)), -MOST_LOGIT, MOST_LOGIT)
                step = np.floor(z * STEPS).astype(np.int64) * 2 + np.array(labels, np.int64)
                step, n = np.unique(step, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(step % 2), pa.array(step // 2), pa.array(n.astype(np.int64))],
                    names=["label", "step", "n"],
                )

    counts = docs.mapInArrow(run, "label long, step long, n long")
    # at most two labels by the steps between the largest logits
    rows = counts.groupBy("label", "step").agg(F.sum("n").alias("n")).orderBy("label", "step").collect()
    y, step, n = (np.array([r[k] for r in rows], np.float64) for k in ("label", "step", "n"))
    network.calibrate_counts(step / STEPS, y, n, recall)


SCANNED = (
    "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
)


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, spans`` for every row: kind, start, end, whether base, score of added ones.

    Spans are ordered by start, then kind, in code points with the end exclusive. Runs, or parts of
    them, that no base finding covers are added if they reach the threshold. With too few
    labelled candidates only base findings are given. Null and empty texts have none.
    """
    found = materialise(findings(docs, doc_id, text, sample), "secret-sample")
    network = train(found, sample, recall)
    if network is not None:
        whole = id_and_text(docs, doc_id, text)
        start = [
            (r["left"], r["value"], r["right"])
            for r in labelled(found, sample)
            if r["label"] and not _of_calibration(r["value"])
        ]
        candidates = found.agg(F.sum("n")).first()[0]
        network = train_on_all(whole, network, start, candidates)
        calibrate_on_all(whole, network, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                 ("base", pa.bool_()), ("score", pa.float64())]
            )
        )
        names = (*KINDS, LEARNED)
        for batch in batches:
            for keys, texts in in_chunks(batch):
                spans = []
                for whole in texts:
                    spans.append([(a, k, b, True, None) for k, a, b in base_spans(whole)])
                if network is not None:
                    open_ = [
                        [(a, b) for a, b, state in runs(whole, [(k, a, b) for a, k, b, *_ in base])
                         if state != SECRET]
                        for whole, base in zip(texts, spans)
                    ]
                    scores = network.score_all(texts, open_)
                    listed = [(k, a, b) for k, p in enumerate(open_) for a, b in p]
                    for at in np.flatnonzero(scores >= network.threshold):
                        k, a, b = listed[at]
                        spans[k].append((a, len(KINDS), b, False, float(scores[at])))
                out = [
                    [
                        {"kind": names[k], "start": a, "end": b, "base": is_base, "score": score}
                        for a, k, b, is_base, score in sorted(found, key=lambda s: s[:3])
                    ]
                    for found in spans
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(out, kind)], names=["doc_id", "spans"]
                )

    return id_and_text(docs, doc_id, text).mapInArrow(run, SCANNED)
