"""Document log-likelihood from a gated recurrent language model with class-factored output.

Counting. Every word of the training texts is counted by Spark. Words that reach a
threshold form the head, at most ``HEAD`` of them, which is what tasks hold in memory.
The rest, the tail, meets its counts in a join; no tail word is frequent, so no key is hot.

Model. The state is a gated recurrent unit over the words read so far. A word's
probability is that of its class given the state times its own within the class.
The ``NEURAL`` most frequent words have their own inputs and a softmax within classes of
``CLASS_SIZE`` words; other head words share classes by the language they are most
frequent in and by their last sign and are drawn by their counts there; tail words
share classes by how they end, smoothed as in the base, unknown words included.
So the probabilities of all words, one unknown word per tail class and the end sum to 1.

Training. Every training document is trained on once. Hashes deal the documents to
``ROUNDS`` rounds, and those of a round to shards of about ``SHARD_TOKENS`` words. Per shard a
copy of the weights is trained on whole documents by truncated backpropagation. The copies
are averaged by the number of words they saw, ``FAN_IN`` at a time in as many levels as it takes,
and the next round starts from their mean.

Encoding. Each document is cut into words and turned into the network's inputs once; training
and scoring read these.

Scoring. Documents run side by side in lanes; the state is carried from window to
window to the end of each document, so every word counts with all words before it.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import in_fold, materialise

FOLDS, HELD_OUT_FOLD = 10, 0
ADD = 0.1
HEAD = 1 << 17
NEURAL, CLASS_SIZE = 2048, 64
LANGUAGES = 15
STATE = 32
ENDINGS = 16
SIGNS = 4  # none, full stop, comma, other
ROUNDS = 2
SHARD_TOKENS, FAN_IN = 1_000_000, 16
COPY = "shard long, weights binary, n long"
TRAIN_LANES, TRAIN_WINDOW, RATE = 128, 16, 0.08
SCORE_LANES, SCORE_WINDOW = 256, 32
WIDEN = 8
BLOCK, STACK = 512, 128
HELD_TOKENS = 3_000_000
HELD_BYTES = 10_000_000
# counts are told apart exactly up to here and by 64 steps per doubling above
EXACT = 4096
TAIL_CLASSES = SIGNS * ENDINGS


def sign_of(word: bytes) -> int:
    last = word[-1:]
    if last == b".":
        return 1
    if last == b",":
        return 2
    return 0 if last.isalnum() or last > b"\x7f" else 3


def shape_of(word: bytes) -> int:
    """Class of a tail word by its last sign and the two bytes before such signs."""
    sign = sign_of(word)
    stem = word.rstrip(b".,;:!?*$%&#\"'()") if sign else word
    return sign * ENDINGS + zlib.crc32(stem[-2:]) % ENDINGS


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int
) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``most`` bytes of a column at a time; a longer value is alone."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for at in range(len(lengths)):
            length = int(lengths[at])
            if size and size + length > most:
                if at > start:
                    held.append(batch.slice(start, at - start))
                yield joined()
                held, size, start = [], 0, at
            size += length
        if start < len(lengths):
            held.append(batch.slice(start))
    if held:
        yield joined()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, each word's number among them, and its text's number.

    As ``words_of`` cuts each text, but by Arrow's functions for all texts at once.
    """
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = found.flatten().dictionary_encode()
    ends = found.offsets.to_numpy()
    texts_of = np.repeat(np.arange(len(found), dtype=np.int32), np.diff(ends))
    distinct, numbers = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    # blanks at either end of a text leave an empty word there
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:
        real = numbers != empty
        numbers, texts_of = numbers[real], texts_of[real]
    return distinct.view(pa.binary()), numbers, texts_of


# ---- counting


def count_words(docs: DataFrame, lang: str | None = "lang", text: str = "text") -> DataFrame:
    """``word, shape, n, lang`` of every distinct word; ``word`` null stands for the end.

    ``lang`` numbers the language a word is most frequent in among the ``LANGUAGES`` most
    frequent ones, or is their number for other and unknown languages.
    """
    named = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = docs.select(
        named.alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    known = rows.where(F.col("lang").isNotNull()).groupBy("lang").count()
    names = [r["lang"] for r in known.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    number = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = len(names) + 1
        for batch in _slices(batches, "text", HELD_BYTES):
            langs = np.array([number.get(x, len(names)) for x in batch.column("lang").to_pylist()])
            words, numbers, texts_of = _split(batch.column("text"))
            n = np.bincount(numbers * np.int64(kinds) + langs[texts_of], minlength=len(words) * kinds)
            # of each language a word is found in, and the ends
            at = np.flatnonzero(n)
            ends = np.bincount(langs, minlength=kinds)
            each = np.flatnonzero(ends)
            shapes = np.array([shape_of(w) if w else -1 for w in words.to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(
                        [words.take(pa.array(at // kinds)), pa.nulls(len(each), pa.binary())]
                    ),
                    pa.array(np.append(shapes[at // kinds], np.full(len(each), -1, np.int32))),
                    pa.array(np.append(at % kinds, each).astype(np.int32)),
                    pa.array(np.append(n[at], ends[each])),
                ],
                names=["word", "shape", "lang", "n"],
            )

    counted = rows.mapInArrow(count, "word binary, shape int, lang int, n long")
    parts = counted.groupBy("word", "shape").agg(
        F.sum("n").alias("n"),
        *(
            F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n_{k}")
            for k in range(len(names) + 1)
        ),
    )
    by = F.array(*(F.col(f"n_{k}") for k in range(len(names) + 1)))
    best = (F.array_position(by, F.array_max(by)) - 1).cast("int")
    return parts.select("word", "shape", "n", best.alias("lang"))


def head_threshold(vocabulary: DataFrame, head: int = HEAD) -> int:
    """The least count of a head word: 2 or more, and at most ``head`` words reach it."""
    n = F.col("n")
    step = F.when(n < EXACT, n).otherwise(
        EXACT + F.floor(F.log2(n.cast("double") / EXACT) * 64)
    )
    sizes = (
        vocabulary.where(F.col("word").isNotNull())
        .groupBy(step.cast("long").alias("step"))
        .agg(F.count("*").alias("words"), F.min("n").alias("least"))
        .collect()
    )
    total, least = 0, 1 << 62
    for row in sorted(sizes, key=lambda r: -r["step"]):
        total += row["words"]
        if total > head:
            break
        least = row["least"]
    return max(2, least)


# ---- the model


class Vocabulary:
    """Numbers of head words: input, class, place in the class, and fixed log probabilities."""

    def __init__(
        self,
        head: list[tuple[bytes, int, int]],
        ends: int,
        tokens: int,
        distinct: int,
        tail: dict[int, tuple[int, int]],
        neural: int = NEURAL,
        size: int = CLASS_SIZE,
    ) -> None:
        head = sorted(head, key=lambda w: (-w[1], w[0]))
        self.words = [w for w, _, _ in head]
        counts = np.array([n for _, n, _ in head] + [ends], np.float64)
        langs = np.array([k for _, _, k in head] + [LANGUAGES], np.int64)
        self.tokens, self.distinct, self.tail = tokens, distinct, tail
        self.unit = math.log10(tokens + ADD * (distinct + 1)) if tokens else math.log10(ADD)
        self.base = np.log10(counts + ADD) - self.unit
        self.known = counts > 0
        self.end = len(head)
        own = np.concatenate((np.arange(min(neural, len(head))), [self.end]))
        order = own[np.lexsort((own, langs[own]))]
        self.input = np.zeros(len(counts), np.int32)
        self.group = np.zeros(len(counts), np.int32)
        self.place = np.full(len(counts), -1, np.int32)
        self.fixed = np.zeros(len(counts), np.float64)
        groups, members, last = -1, size, None
        for k, w in enumerate(order):
            if members == size or langs[w] != last:
                groups, members, last = groups + 1, 0, langs[w]
            self.input[w], self.group[w], self.place[w] = k, groups, members
            members += 1
        self.neural_groups, self.size = groups + 1, size
        rest = np.arange(len(own) - 1, len(head))
        signs = np.array([sign_of(self.words[w]) for w in rest], np.int64)
        kinds, at = np.unique(langs[rest] * SIGNS + signs, return_inverse=True)
        held = np.bincount(at, weights=counts[rest], minlength=len(kinds))
        self.group[rest] = self.neural_groups + at
        self.input[rest] = len(own) + at
        self.fixed[rest] = np.log10(counts[rest] / held[at]) if len(rest) else 0.0
        self.first_tail_group = self.neural_groups + len(kinds)
        self.first_tail_input = len(own) + len(kinds)
        self.groups = self.first_tail_group + TAIL_CLASSES
        self.inputs = self.first_tail_input + TAIL_CLASSES
        # where a fit starts: class and word frequencies
        mass = np.bincount(self.group, weights=counts, minlength=self.groups)
        for shape, (n, _) in tail.items():
            mass[self.first_tail_group + shape] += n
        self.group_bias = np.log(mass + ADD)
        self.word_bias = np.full((self.neural_groups, size), -1e9)
        self.word_bias[self.group[own], self.place[own]] = np.log(counts[own] + ADD)
        # an input tells class and place as well
        self.input_group = np.zeros(self.inputs, np.int32)
        self.input_place = np.full(self.inputs, -1, np.int32)
        self.input_group[self.input], self.input_place[self.input] = self.group, self.place
        tails = np.arange(TAIL_CLASSES)
        self.input_group[self.first_tail_input + tails] = self.first_tail_group + tails
        self.code = "<u2" if self.inputs <= 1 << 16 else "<i4"
        self.input_lang = np.full(self.inputs, LANGUAGES, np.int64)
        self.input_lang[self.input] = langs
        self._number: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_number": None}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Head numbers of the words, -1 for tail words."""
        if self._number is None:
            self._number = {w: k for k, w in enumerate(self.words)}
        return np.fromiter(map(self._number.get, words, repeat(-1)), np.int64, len(words))

    def inputs_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head numbers, -1 for tail words, and inputs of the words."""
        found = self.numbers(words)
        inputs = self.input[found]
        tail = np.flatnonzero(found < 0)
        inputs[tail] = [self.first_tail_input + shape_of(words[at]) for at in tail.tolist()]
        return found, inputs

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Head numbers, inputs, classes and places of the words and the end."""
        found, inputs = self.inputs_of(words)
        found, inputs = np.append(found, self.end), np.append(inputs, self.input[self.end])
        return found, inputs, self.input_group[inputs], self.input_place[inputs]


def _sigmoid(x: np.ndarray) -> None:
    """In place; half of one and the tangent of half, which is faster than an exponential."""
    half = x.dtype.type(0.5)
    x *= half
    np.tanh(x, out=x)
    x *= half
    x += half


def _sorted(ids: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts numbers under ``below``, the different ones, and their counts."""
    # a stable sort of 16 bits is by digits
    order = np.argsort(ids.astype(np.uint16) if below <= 1 << 16 else ids, kind="stable")
    counts = np.bincount(ids, minlength=below)
    found = np.flatnonzero(counts)
    return order, found, counts[found]


def _sums(rows: np.ndarray, counts: np.ndarray, few: int = 6) -> np.ndarray:
    """The sums of runs of so many rows, one after another.

    Short runs are added side by side and long ones by a product with ones, as a
    reduction run by run takes three times as long.
    """
    starts = np.cumsum(counts) - counts
    out = rows[starts]
    for k in range(1, few):
        at = np.flatnonzero((counts > k) & (counts <= few))
        out[at] += rows[starts[at] + k]
    ones = np.ones(counts.max(), rows.dtype)
    for k in np.flatnonzero(counts > few).tolist():
        np.matmul(ones[: counts[k]], rows[starts[k] : starts[k] + counts[k]], out=out[k])
    return out


def _near(weights: np.ndarray, longest: float) -> bool:
    """Whether the exponentials of all logits stay in range as they are.

    ``weights`` end with the biases. A logit is within the product of the lengths of state and weights of
    its bias. Where that shows that none overflows and that the best is not close to zero, no
    maximum has to be taken off.
    """
    out, bias = weights[..., :-1, :], weights[..., -1, :]
    reach = longest * np.sqrt(np.einsum("...ij,...ij->...j", out, out))
    return bool((bias + reach).max() < 70 and (bias - reach).max(axis=-1).min() > -60)


def _exponentials(logits: np.ndarray, at: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logits become exponentials in place; their sums, and the natural log of the softmax at one place per row."""
    if not near:
        logits -= logits.max(axis=1, keepdims=True)
    mine = logits.ravel().take(at)
    np.exp(logits, out=logits)
    # a product with ones sums rows faster than a reduction over the short axis
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    mine -= np.log(total)
    return total, mine


def _slopes(logits: np.ndarray, at: np.ndarray, share: np.ndarray, near: bool) -> float:
    """Logits become slopes of the softmax's loss by the rows' shares; returns that loss."""
    total, mine = _exponentials(logits, at, near)
    logits *= (share / total)[:, None]
    logits.ravel()[at] -= share
    return -float(mine @ share)


class Lanes:
    """Whole documents one after another in lanes of about equal length, longest lanes first."""

    def __init__(self, docs: list[tuple[np.ndarray, ...]], lanes: int) -> None:
        lengths = [len(d[0]) for d in docs]
        heap = [(0, k) for k in range(min(lanes, len(docs)))]
        taken: list[list[int]] = [[] for _ in heap]
        for d in sorted(range(len(docs)), key=lambda d: -lengths[d]):
            n, k = heapq.heappop(heap)
            taken[k].append(d)
            heapq.heappush(heap, (n + lengths[d], k))
        taken.sort(key=lambda ds: -sum(lengths[d] for d in ds))
        order = [d for ds in taken for d in ds]
        self.inputs, self.groups, self.places = (
            np.concatenate([docs[d][k] for d in order]) for k in range(3)
        )
        self.doc = np.repeat(order, [lengths[d] for d in order])
        self.first = np.zeros(len(self.doc), bool)
        ends = np.cumsum([lengths[d] for d in order])
        self.first[np.concatenate(([0], ends[:-1]))] = True
        self.lengths = np.array([sum(lengths[d] for d in ds) for ds in taken])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the active lanes' next words, and which of them are real.

        With fewer lanes left windows are longer, ``WIDEN`` times at most, so that a long document does not
        end in many small ones.
        """
        at = 0
        while len(self.lengths) and at < self.lengths[0]:
            active = int(np.searchsorted(-self.lengths, -at))
            wide = size * min(WIDEN, len(self.lengths) // active)
            width = min(wide, int(self.lengths[0]) - at)
            steps = at + np.arange(width)
            real = steps[None] < self.lengths[:active, None]
            last = (self.starts + self.lengths - 1)[:active, None]
            yield np.minimum(self.starts[:active, None] + steps[None], last), real
            at += width


def _stacked(rows: np.ndarray) -> np.ndarray:
    """The rows as a stack of small matrices where they fill them; products of long narrow ones are slow."""
    high = STACK if len(rows) % STACK == 0 else len(rows)
    return rows.reshape(-1, high, rows.shape[1])


def _longest(states: np.ndarray) -> float:
    return math.sqrt(float(np.einsum("ij,ij->i", states, states).max(initial=0)))


class Gated:
    """The recurrent network; weights in single precision."""

    NAMES = ("enter", "turn", "group_out", "group_bias", "word_out", "word_bias")

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.state = weights["turn"].shape[0]

    @staticmethod
    def fresh(v: Vocabulary, state: int = STATE, seed: int = 3) -> Gated:
        rnd = np.random.default_rng(seed)
        # words of one language start out alike
        common = rnd.normal(0, 0.7, (LANGUAGES + 1, 3 * state))
        common[LANGUAGES] = 0
        weights = {
            "enter": common[v.input_lang] + rnd.normal(0, 0.05, (v.inputs, 3 * state)),
            "turn": rnd.normal(0, 0.5 / state**0.5, (state, 3 * state)),
            "group_out": np.zeros((state, v.groups)),
            "group_bias": v.group_bias,
            "word_out": np.zeros((v.neural_groups, state, v.size)),
            "word_bias": v.word_bias,
        }
        return Gated({k: x.astype(np.float32) for k, x in weights.items()})

    def packed(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.NAMES])

    def unpacked(self, flat: np.ndarray) -> Gated:
        out, at = {}, 0
        for k in self.NAMES:
            size = self.w[k].size
            out[k] = flat[at : at + size].reshape(self.w[k].shape).astype(np.float32)
            at += size
        return Gated(out)

    def _run(self, h: np.ndarray, inputs: np.ndarray, first: np.ndarray, keep: bool) -> tuple:
        """States before each word with a one behind them, the last state, and what backpropagation needs."""
        (n, width), s = inputs.shape, self.state
        enter, turn = self.w["enter"], self._turns()
        states = np.ones((width, n, s + 1), turn.dtype)
        kept = width if keep else 1
        gates = np.empty((kept, 3, n, s), turn.dtype)
        news = np.empty((kept, n, s), turn.dtype)
        x = np.empty((n, 3 * s), turn.dtype)
        by_gate = x.reshape(n, 3, s).transpose(1, 0, 2)
        ids, starts = np.ascontiguousarray(inputs.T), first.any(axis=0)
        h = np.array(h, turn.dtype)
        for t in range(width):
            if starts[t]:
                h[first[:, t]] = 0
            states[t, :, :s] = h
            enter.take(ids[t], axis=0, out=x, mode="clip")
            g, new = gates[t % kept], news[t % kept]
            np.matmul(h, turn, out=g)
            zr = g[:2]
            zr += by_gate[:2]
            _sigmoid(zr)
            np.multiply(g[1], g[2], out=new)
            new += by_gate[2]
            np.tanh(new, out=new)
            h -= new
            h *= g[0]
            h += new
        return states, h, gates, news

    def joint(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of classes and of words over their biases, which a one behind each state meets."""
        w = self.w
        return (
            np.concatenate((w["group_out"], w["group_bias"][None])),
            np.concatenate((w["word_out"], w["word_bias"][:, None]), axis=1),
        )

    def _turns(self) -> np.ndarray:
        """The state's weights, gate by gate."""
        s = self.state
        return np.ascontiguousarray(self.w["turn"].reshape(s, 3, s).transpose(1, 0, 2))

    def _by_group(self, groups: np.ndarray, places: np.ndarray) -> tuple:
        """Words with a place sorted by class, the classes, and where each one's rows begin and end."""
        own = np.flatnonzero(places >= 0)
        order, found, counts = _sorted(groups[own], len(self.w["group_bias"]))
        ends = np.cumsum(counts)
        return own[order], found, list(zip((ends - counts).tolist(), ends.tolist()))

    def log_probabilities(
        self, h: np.ndarray, inputs: np.ndarray, first: np.ndarray, groups: np.ndarray,
        places: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs for each word of a window (rows are lanes), and the last state."""
        s = self.state
        states, h, *_ = self._run(h, inputs, first, False)
        flat = states.reshape(-1, s + 1)
        groups, places = groups.T.ravel(), places.T.ravel()
        out = np.empty(len(flat), flat.dtype)
        weights, word_weights = self.joint()
        longest = _longest(flat[:, :s])
        near = _near(weights, longest)
        # blocks of rows whose logits stay in a core's cache
        for start in range(0, len(flat), BLOCK):
            rows = slice(start, start + BLOCK)
            logits = (_stacked(flat[rows]) @ weights).reshape(-1, weights.shape[1])
            at = np.arange(len(logits)) * logits.shape[1] + groups[rows]
            out[rows] = _exponentials(logits, at, near)[1]
        order, found, ends = self._by_group(groups, places)
        if len(order):
            seen = flat.take(order, axis=0)
            logits = np.empty((len(order), word_weights.shape[-1]), flat.dtype)
            for k, (start, end) in zip(found, ends):
                np.matmul(seen[start:end], word_weights[k], out=logits[start:end])
            at = np.arange(len(logits)) * logits.shape[1] + places[order]
            out[order] += _exponentials(logits, at, _near(word_weights, longest))[1]
        return out.reshape(inputs.shape[1], -1).T, h

    def _slopes(
        self, joint: tuple[np.ndarray, np.ndarray], h: np.ndarray, inputs: np.ndarray,
        first: np.ndarray, groups: np.ndarray, places: np.ndarray, real: np.ndarray,
    ) -> tuple[dict[str, tuple], np.ndarray, float]:
        """Rows of each weight that have slopes, and these; the last state; the mean loss over a window.

        Those of classes and words are ``joint``. Nothing flows to the window before.
        """
        s = self.state
        states, after, gates, new = self._run(h, inputs, first, True)
        z, r, g_new = (gates[:, k] for k in range(3))
        flat = states.reshape(-1, s + 1)
        groups, places, weight = groups.T.ravel(), places.T.ravel(), real.T.ravel()
        places = np.where(weight, places, -1)
        share = weight.astype(flat.dtype) / flat.dtype.type(max(1, weight.sum()))
        back = np.empty((len(flat), s), flat.dtype)
        longest, loss = _longest(flat[:, :s]), 0.0
        weights, word_weights = joint
        near = _near(weights, longest)
        by_group, inward = np.zeros_like(weights), np.ascontiguousarray(weights[:s].T)
        for start in range(0, len(flat), BLOCK):
            rows = slice(start, start + BLOCK)
            seen = _stacked(flat[rows])
            p = (seen @ weights).reshape(-1, weights.shape[1])
            at = np.arange(len(p)) * p.shape[1] + groups[rows]
            loss += _slopes(p, at, share[rows], near)
            by_group += np.matmul(seen.transpose(0, 2, 1), _stacked(p)).sum(axis=0)
            np.matmul(_stacked(p), inward, out=_stacked(back[rows]))
        every = slice(None)
        grad = {"group": (every, by_group)}
        order, found, ends = self._by_group(groups, places)
        if len(order):
            seen = flat.take(order, axis=0)
            q = np.empty((len(order), word_weights.shape[-1]), flat.dtype)
            for k, (start, end) in zip(found, ends):
                np.matmul(seen[start:end], word_weights[k], out=q[start:end])
            at = np.arange(len(q)) * q.shape[1] + places[order]
            loss += _slopes(q, at, share[order], _near(word_weights, longest))
            by_word = np.empty((len(found), *word_weights.shape[1:]), flat.dtype)
            inner = np.empty((len(order), s), flat.dtype)
            for mine, k, (start, end) in zip(by_word, found, ends):
                np.matmul(seen[start:end].T, q[start:end], out=mine)
                np.matmul(q[start:end], word_weights[k, :s].T, out=inner[start:end])
            back[order] += inner
            grad["word"] = (every if len(found) == len(word_weights) else found, by_word)
        back = back.reshape(new.shape)
        inward = np.ascontiguousarray(self._turns().transpose(0, 2, 1))
        # what the slope of a state is multiplied by for its update, reset, reset candidate and candidate
        n = len(after)
        by = np.empty((len(new), 4, n, s), flat.dtype)
        keep, (by_z, by_r, by_both, by_new) = 1 - z, (by[:, k] for k in range(4))
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= keep
        np.multiply(by_new, r, out=by_both)
        np.subtract(1, r, out=by_r)
        by_r *= g_new
        by_r *= by_both
        np.subtract(states[:, :, :s], new, out=by_z)
        keep *= z
        by_z *= keep
        each = np.empty((3, n, s), flat.dtype)
        dh, starts = np.zeros_like(after), first.any(axis=0)
        for t in range(len(new) - 1, -1, -1):
            d = by[t]
            d *= dh
            dh *= z[t]
            for part in np.matmul(d[:3], inward, out=each):
                dh += part
            dh += back[t]
            if starts[t]:
                dh[first[:, t]] = 0
        # step by step, as long products of few columns are slow
        d_turn = np.matmul(by[:, :3].transpose(0, 1, 3, 2), states[:, None, :, :s]).sum(axis=0)
        grad["turn"] = (every, d_turn.transpose(2, 0, 1).reshape(s, 3 * s))
        order, found, counts = _sorted(inputs.T.ravel(), len(self.w["enter"]))
        rows = (order // n * 4 * n + order % n)[:, None] + np.array([0, n, 3 * n])
        d_enter = by.reshape(-1, s).take(rows, axis=0).reshape(-1, 3 * s)
        grad["enter"] = (found, _sums(d_enter, counts))
        return grad, after, loss

    def gradients(
        self, h: np.ndarray, inputs: np.ndarray, first: np.ndarray, groups: np.ndarray,
        places: np.ndarray, real: np.ndarray,
    ) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradient of the mean loss over a window by all weights, the last state, and that loss."""
        joint = self.joint()
        slopes, after, loss = self._slopes(joint, h, inputs, first, groups, places, real)
        grad = {k: np.zeros_like(x) for k, x in self.parts(joint).items()}
        for k, (rows, g) in slopes.items():
            grad[k][rows] = g
        group, word = grad.pop("group"), grad.pop("word")
        grad |= {"group_out": group[:-1], "group_bias": group[-1]}
        return {**grad, "word_out": word[:, :-1], "word_bias": word[:, -1]}, after, loss

    def parts(self, joint: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """The weights as they are trained."""
        return {"enter": self.w["enter"], "turn": self.w["turn"], "group": joint[0], "word": joint[1]}

    def train(self, docs: list[tuple[np.ndarray, ...]], lanes: int, window: int, rate: float,
              squares: dict[str, np.ndarray]) -> float:
        """One pass over whole documents; ``squares`` carries the step sizes from pass to pass."""
        held = Lanes(docs, lanes)
        h = np.zeros((len(held.lengths), self.state), np.float32)
        losses, joint = [], self.joint()
        weights = self.parts(joint)
        for k, x in weights.items():
            squares.setdefault(k, np.full_like(x, 1e-3))
        for at, real in held.windows(window):
            h = h[: len(at)]
            grad, h, loss = self._slopes(
                joint, h, held.inputs[at], held.first[at] & real, held.groups[at],
                held.places[at], real,
            )
            losses.append(loss)
            size = math.sqrt(sum(float(np.vdot(g, g)) for _, g in grad.values()))
            shrink = min(1.0, 5.0 / (size + 1e-9))
            # weights without a slope keep their values and squares
            for k, (rows, g) in grad.items():
                if shrink < 1:
                    g *= shrink
                square = squares[k][rows]
                square += g * g
                if not isinstance(rows, slice):
                    squares[k][rows] = square
                g *= rate
                g /= np.sqrt(square)
                weights[k][rows] -= g
        group, word = joint
        self.w |= {"group_out": group[:-1], "group_bias": group[-1]}
        self.w |= {"word_out": word[:, :-1], "word_bias": word[:, -1]}
        return float(np.mean(losses)) if losses else 0.0

    def score(self, docs: list[tuple[np.ndarray, ...]], lanes: int, window: int) -> np.ndarray:
        """The natural log of each document's class and word probabilities, summed."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        held = Lanes(docs, lanes)
        h = np.zeros((len(held.lengths), self.state), np.float32)
        for at, real in held.windows(window):
            logs, h = self.log_probabilities(
                h[: len(at)], held.inputs[at], held.first[at] & real, held.groups[at],
                held.places[at],
            )
            out += np.bincount(
                held.doc[at[real]], weights=logs[real].astype(np.float64), minlength=len(docs)
            )
        return out


# ---- on Spark


def _mean(table: pa.Table) -> pa.Table:
    """One copy for up to ``FAN_IN``: the mean of their weights by the tokens behind them."""
    total, tokens = None, 0
    table = table.sort_by("shard")
    for flat, n in zip(table["weights"], table["n"].to_pylist()):
        part = np.frombuffer(flat.as_buffer(), "<f4").astype(np.float64) * n
        total = part if total is None else total + part
        tokens += n
    return pa.table(
        {
            "shard": pa.array([table["up"][0].as_py()], pa.int64()),
            "weights": pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary()),
            "n": pa.array([tokens], pa.int64()),
        }
    )


def _average(copies: DataFrame, shards: int) -> np.ndarray | None:
    """The mean of all copies, by as many levels of ``FAN_IN`` as it takes."""
    while shards > 1:
        shards = -(-shards // FAN_IN)
        copies = (
            copies.withColumn("up", F.floor(F.col("shard") / FAN_IN))
            .groupBy("up")
            .applyInArrow(_mean, COPY)
        )
    rows = copies.collect()  # one row, or none where no document was chosen
    return np.frombuffer(bytes(rows[0]["weights"]), "<f4") if rows else None


CODED = (
    "doc_id long, at long, held boolean, task long, row long, n_tokens long, n_known long, "
    "base double, fixed double, tail array<struct<word:binary,shape:int,n:int>>, codes binary"
)


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))


def _coded(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Every document's inputs of the network, its sums over head words, and its tail words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in _slices(batches, "text", HELD_BYTES):
            n = batch.num_rows
            words, numbers, texts_of = _split(batch.column("text"))
            found, inputs = v.inputs_of(words.to_pylist())
            head = found >= 0

            def total(values: np.ndarray) -> np.ndarray:
                """The sum over each text's head words and its end."""
                each = np.where(head, values[found], 0)
                return np.bincount(texts_of, each[numbers], n) + values[v.end]

            sizes = np.bincount(texts_of, minlength=n) + 1
            ends = np.cumsum(sizes)
            codes = np.full(int(ends[-1]), v.input[v.end], v.code)
            codes[np.arange(len(numbers)) + texts_of] = inputs.astype(v.code)[numbers]
            # tail words of a text, each with its count there
            rare = np.flatnonzero(~head[numbers])
            keys, times = np.unique(
                texts_of[rare] * np.int64(len(words)) + numbers[rare], return_counts=True
            )
            texts, mine = (x.astype(np.int32) for x in divmod(keys, max(1, len(words))))
            tails = pa.StructArray.from_arrays(
                [
                    words.take(pa.array(mine)),
                    pa.array((inputs[mine] - v.first_tail_input).astype(np.int32)),
                    pa.array(times.astype(np.int32)),
                ],
                ["word", "shape", "n"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("at"), batch.column("held"),
                    pa.array(np.full(n, task)), pa.array(np.arange(row, row + n)),
                    pa.array(sizes), pa.array(total(v.known).astype(np.int64)),
                    pa.array(total(v.base)), pa.array(total(v.fixed)),
                    pa.ListArray.from_arrays(_offsets(np.bincount(texts, minlength=n)), tails),
                    pa.Array.from_buffers(
                        pa.binary(), n,
                        [None, _offsets(sizes * codes.itemsize).buffers()[1], pa.py_buffer(codes)],
                    ),
                ],
                names=["doc_id", "at", "held", "task", "row", "n_tokens", "n_known", "base",
                       "fixed", "tail", "codes"],
            )
            row += n

    return materialise(docs.mapInArrow(run, CODED), "lm-codes")


def _rows(docs: DataFrame, doc_id: str, text: str, held: Column | None = None) -> DataFrame:
    """What is encoded of each document, with a hash of id and text."""
    found = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        (F.lit(False) if held is None else held).alias("held"),
    )
    return found.withColumn("at", F.xxhash64("doc_id", "text"))


class Codes:
    """From the codes of a document to inputs, classes and places."""

    def __init__(self, v: Vocabulary) -> None:
        self.kind, self.group, self.place = v.code, v.input_group, v.input_place

    def read(self, codes: pa.Scalar) -> tuple[np.ndarray, ...]:
        inputs = np.frombuffer(codes.as_buffer(), self.kind).astype(np.int32)
        return inputs, self.group[inputs], self.place[inputs]


def _round(
    coded: DataFrame, codes: Codes, start: Gated, rate: float, share: int, part: int, shards: int
) -> Gated:
    """Weights after a copy per shard trained on its documents of this round's share.

    Documents go to shards, and follow each other there, by hashes of id and text, so the
    weights do not depend on how the table is cut into tasks. A row that is repeated with
    its id is trained on once, so that no shard fills up with one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, squares, shard, held, size, total = None, {}, None, [], 0, 0

        def learn() -> None:
            nonlocal held, size, total
            model.train(held, TRAIN_LANES, TRAIN_WINDOW, rate, squares)
            total += size
            held, size = [], 0

        def copy() -> pa.RecordBatch:
            if held:
                learn()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([model.packed().astype("<f4").tobytes()], pa.binary()),
                    pa.array([total], pa.int64()),
                ],
                names=["shard", "weights", "n"],
            )

        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != shard:
                    if model is not None:
                        yield copy()
                    model, shard, total = start.unpacked(start.packed()), at, 0
                    squares = {}
                held.append(codes.read(text))
                size += len(held[-1][0])
                # a whole shard as a rule: lanes of its documents then end at about the same time
                if size >= 2 * SHARD_TOKENS:
                    learn()
        if model is not None:
            yield copy()

    tasks = min(shards, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = (
        coded.where(~F.col("held") & (F.pmod("at", F.lit(share)) == part))
        .select("doc_id", "at", "codes")
        .dropDuplicates()
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(part), "at", "doc_id"), F.lit(shards)))
        .repartitionById(tasks, (F.col("shard") % tasks).cast("int"))
        .sortWithinPartitions("shard", "at", "doc_id", "codes")
    )
    copies = materialise(chosen.select("shard", "codes").mapInArrow(run, COPY), "lm-copies")
    mean = _average(copies, shards)
    return start if mean is None else start.unpacked(mean)


class Model:
    """Vocabulary table, numbers of the head, the fitted network, and the documents in its inputs."""

    def __init__(
        self, counts: DataFrame, least: int, vocabulary: Vocabulary, network: Gated,
        coded: DataFrame,
    ) -> None:
        self.counts, self.least = counts, least
        self.vocabulary, self.network = vocabulary, network
        self.coded = coded


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    head: int = HEAD,
    rounds: int = ROUNDS,
    share: int | None = None,
    rate: float = RATE,
    held: Column | None = None,
) -> Model:
    """Count all words of ``docs`` and train on one in ``share`` documents per round.

    Without ``share`` the rounds have all documents among them, each in one round.
    Rows where ``held`` is true are not learned from, but are encoded with the others for
    ``score_coded``, so that a table that is scored by its own model is encoded once.
    A round has one shard per ``SHARD_TOKENS`` of its tokens, so that a copy takes as many
    steps in a large corpus as in a small one. Null texts are empty and count as an end
    alone. Without a column ``lang`` all words are of one unknown language.
    """
    if lang is not None and lang not in docs.columns:
        lang = None
    learned = docs if held is None else docs.where(~held)
    counts = materialise(count_words(learned, lang, text), "lm-words")
    least = head_threshold(counts, head)
    rows = counts.where((F.col("n") >= least) & F.col("word").isNotNull()).select("word", "n", "lang")
    # at most ``head`` words
    frequent = list(zip(*(column.to_pylist() for column in rows.toArrow().columns)))
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count("*").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    tail = {
        r["shape"]: (r["n"], r["words"])
        for r in counts.where((F.col("n") < least) & F.col("word").isNotNull())
        .groupBy("shape")
        .agg(F.sum("n").alias("n"), F.count("*").alias("words"))
        .collect()
    }
    vocabulary = Vocabulary(frequent, sums["ends"], sums["tokens"], sums["distinct"], tail)
    network = Gated.fresh(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    coded = _coded(_rows(docs, doc_id, text, held), shared)
    share = share or rounds
    shards = max(1, -(-int(sums["tokens"]) // (share * SHARD_TOKENS)))
    codes = Codes(vocabulary)
    for part in range(rounds):
        network = _round(coded, codes, network, rate / (1 + part), share, part % share, shards)
    return Model(counts, least, vocabulary, network, coded)


SCORED = (
    "doc_id long, task long, row long, n_tokens long, n_known long, base double, score double"
)


def _score_head(coded: DataFrame, model: Model) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast((Codes(model.vocabulary), model.network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, network = shared.value
        rows, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held, size
            table = pa.Table.from_batches(rows).combine_chunks()
            logs = network.score(held, SCORE_LANES, SCORE_WINDOW) / math.log(10)
            score = pa.array(logs + table["fixed"].to_numpy(), pa.float64())
            rows, held, size = [], [], 0
            return table.drop_columns("fixed").append_column("score", score).to_batches()[0]

        for batch in batches:
            start = 0
            for at, text in enumerate(batch.column("codes")):
                held.append(codes.read(text))
                size += len(held[-1][0])
                if size >= HELD_TOKENS:
                    rows.append(batch.drop_columns("codes").slice(start, at + 1 - start))
                    start = at + 1
                    yield flush()
            if start < batch.num_rows:
                rows.append(batch.drop_columns("codes").slice(start))
        if held:
            yield flush()

    needed = coded.select("doc_id", "task", "row", "n_tokens", "n_known", "base", "fixed", "codes")
    return needed.mapInArrow(run, SCORED)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row.

    ``base_score`` is the sum of the words' smoothed log10 frequencies, ``score`` the
    model's log10 probability of the whole text. A null or empty text is the end alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
    return score_coded(_coded(_rows(docs, doc_id, text), shared), model)


def score_coded(coded: DataFrame, model: Model) -> DataFrame:
    """What ``score`` gives, for documents that are encoded, as ``Model.coded`` has them."""
    v = model.vocabulary
    heads = _score_head(coded, model)
    tails = coded.select("task", "row", F.explode("tail").alias("t")).select("task", "row", "t.*")
    counts = model.counts.where(
        (F.col("n") < model.least) & F.col("word").isNotNull()
    ).select("word", F.col("n").alias("c"))
    room = coded.sparkSession.createDataFrame(
        [
            (k, math.log10(v.tail.get(k, (0, 0))[0] + ADD * (v.tail.get(k, (0, 0))[1] + 1)))
            for k in range(TAIL_CLASSES)
        ],
        "shape int, room double",
    )
    weight = F.log10(F.coalesce("c", F.lit(0)) + ADD)
    sums = (
        tails.join(counts, "word", "left")
        .join(F.broadcast(room), "shape")
        .groupBy("task", "row")
        .agg(
            F.sum(F.col("n") * (weight - v.unit)).alias("tail_base"),
            F.sum(F.col("n") * (weight - F.col("room"))).alias("tail_score"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        )
    )
    none = F.lit(0.0)
    return heads.join(sums, ["task", "row"], "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("tail_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("tail_score", none)).alias("score"),
    )


def training_part(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows outside the held-out fold."""
    return docs.where(~in_fold(F.col(doc_id), FOLDS, HELD_OUT_FOLD))
