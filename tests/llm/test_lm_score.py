import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_data import ODD

from tidewatch.llm import lm_score as lm
from tidewatch.llm.base import documents


def small_vocabulary():
    head = [(b"the", 50, 0), (b"of", 40, 0), (b"der", 30, 1), (b"und.", 20, 1), (b"a", 5, 0), (b"b,", 4, 1)]
    return lm.Vocabulary(head, 10, 200, 30, {lm.shape_of(b"rare"): (41, 23)}, neural=4, size=3)


def documents_of(v, texts):
    return [v.encode(lm.words_of(t))[1:] for t in texts]


TEXTS = [b"the of the a", b"der und. der b, b, rare words", b"", b"of of of of of of of of of"]


def test_probabilities_sum_to_one():
    v = small_vocabulary()
    net = lm.Gated.fresh(v)
    rnd = np.random.default_rng(1)
    net.w["group_out"] += rnd.normal(0, 1, net.w["group_out"].shape).astype(np.float32)
    net.w["word_out"] += rnd.normal(0, 1, net.w["word_out"].shape).astype(np.float32)
    prefix = lm.words_of(b"der und. the rare")
    total = 0.0
    alone = v.encode(prefix)
    every = [([w]) for w in v.words] + [[]]
    for words in every:
        full = v.encode(prefix + words)
        at = len(prefix)
        args = [np.array([x[: at + 1]]) for x in full[1:]]
        first = np.zeros_like(args[0], bool)
        first[0, 0] = True
        logs, _ = net.log_probabilities(np.zeros((1, net.state), np.float32), args[0], first, args[1], args[2])
        number = v.end if not words else v.numbers(words)[0]
        total += math.exp(logs[0, at]) * 10 ** v.fixed[number]
    # all tail words of a class, the unknown one included, have the probability of the class
    for shape in range(lm.TAIL_CLASSES):
        group = v.first_tail_group + shape
        inputs = np.array([np.append(alone[1][:-1], v.first_tail_input + shape)])
        groups = np.array([np.append(alone[2][:-1], group)])
        places = np.array([np.append(alone[3][:-1], -1)])
        first = np.zeros(inputs.shape, bool)
        first[0, 0] = True
        logs, _ = net.log_probabilities(np.zeros((1, net.state), np.float32), inputs, first, groups, places)
        total += math.exp(logs[0, len(prefix)])
    assert abs(total - 1) < 1e-4


def test_state_is_carried_and_reset():
    """Lanes and windows of any size give each document what it gets alone."""
    v = small_vocabulary()
    net = lm.Gated.fresh(v)
    net.w["group_out"] += 0.5
    docs = documents_of(v, TEXTS * 3)
    want = np.concatenate([net.score([d], 1, 1000) for d in docs])
    for lanes, window in ((1, 1), (2, 3), (5, 4), (64, 32)):
        assert np.allclose(net.score(docs, lanes, window), want, atol=1e-4)


def test_gradient():
    v = small_vocabulary()
    net = lm.Gated.fresh(v)
    rnd = np.random.default_rng(2)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    net.w["group_out"] += rnd.normal(0, 0.3, net.w["group_out"].shape)
    net.w["word_out"] += rnd.normal(0, 0.3, net.w["word_out"].shape)
    held = lm.Lanes(documents_of(v, TEXTS), 2)
    (at, real), *_ = held.windows(7)
    h = rnd.normal(0, 0.5, (len(at), net.state))
    args = (held.inputs[at], held.first[at] & real, held.groups[at], held.places[at], real)
    grad, _, loss = net.gradients(h, *args)
    for name in lm.Gated.NAMES:
        p = net.w[name]
        for _ in range(12):
            k = tuple(rnd.integers(0, s) for s in p.shape)
            if abs(p[k]) > 1e6:
                continue
            old, eps = p[k], 1e-4
            p[k] = old + eps
            up = net.gradients(h, *args)[2]
            p[k] = old - eps
            down = net.gradients(h, *args)[2]
            p[k] = old
            assert abs((up - down) / (2 * eps) - grad[name][k]) < 2e-4, name


def test_counts_and_threshold(spark, sf_dir):
    train = lm.training_part(documents(spark, sf_dir))
    counts, shapes, n = Counter(), {}, 0
    for r in train.collect():
        counts.update(lm.words_of(r.text.encode()))
        n += 1
    got = {None if r.word is None else bytes(r.word): r for r in lm.count_words(train).collect()}
    assert {w: r.n for w, r in got.items()} == {**counts, None: n}
    table = lm.count_words(train)
    for head in (10, 500, 10**6):
        least = lm.head_threshold(table, head)
        assert least >= 2 and sum(c >= least for c in counts.values()) <= head
    assert lm.head_threshold(table, 10**6) == 2


def test_base_score_known_and_held_out(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # a small head, so that the join of the tail carries most words
    model = lm.fit(lm.training_part(docs), head=200, rounds=2, share=2)
    rows = {r.doc_id: r.text for r in docs.collect()}
    train = Counter()
    for i, t in rows.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(lm.words_of(t.encode()) + [None])
    total, distinct = sum(train.values()), len(train)
    got = lm.score(docs, model).collect()
    assert model.vocabulary.tokens == total and len(got) == len(rows)
    held_base = held = 0.0
    for r in got:
        tokens = lm.words_of(rows[r.doc_id].encode()) + [None]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.n_tokens == len(tokens) and r.n_known == sum(train[w] > 0 for w in tokens)
        if zlib.crc32(str(r.doc_id).encode()) % 10 == 0:
            held_base, held = held_base + r.base_score, held + r.score
    assert held > held_base


def test_odd_rows(spark, odd, empty, sf_dir):
    model = lm.fit(lm.training_part(documents(spark, sf_dir)), rounds=1, share=4)
    got = sorted([(r.doc_id, r.n_tokens) for r in lm.score(odd, model).collect()], key=repr)
    want = sorted([(i, len((t or "").encode().split()) + 1) for i, t in ODD], key=repr)
    assert got == want
    by_tokens = {r.n_tokens: r.score for r in lm.score(odd, model).collect()}
    assert all(math.isfinite(s) and s < 0 for s in by_tokens.values())
    assert lm.score(empty, model).count() == 0
    nothing = lm.fit(empty)
    assert all(math.isfinite(r.score) and r.base_score == 0 for r in lm.score(odd, nothing).collect())
    assert lm.fit(odd, lang=None).vocabulary.tokens == sum(n for _, n in want)


@pytest.mark.parametrize("word,sign", [(b"a", 0), (b"a.", 1), (b"a,", 2), (b"a***", 3), ("é".encode(), 0)])
def test_signs(word, sign):
    assert lm.sign_of(word) == sign and 0 <= lm.shape_of(word) < lm.TAIL_CLASSES


def plain_log10(v, net, text):
    """One word after the other, in double precision, from the definitions."""
    w = {k: x.astype(np.float64) for k, x in net.w.items()}
    s, h, total = net.state, np.zeros(net.state), 0.0
    words = lm.words_of(text)
    for word in [*words, None]:
        number = v.end if word is None else v.words.index(word) if word in v.words else None
        if number is None:
            shape = lm.shape_of(word)
            group, place, enter, fixed = v.first_tail_group + shape, -1, v.first_tail_input + shape, 0.0
        else:
            group, place = v.group[number], v.place[number]
            enter, fixed = v.input[number], v.fixed[number]
        logits = h @ w["group_out"] + w["group_bias"]
        high = logits.max()
        total += (logits[group] - high - math.log(np.exp(logits - high).sum())) / math.log(10)
        if place >= 0:
            inner = h @ w["word_out"][group] + w["word_bias"][group]
            high = inner.max()
            total += (inner[place] - high - math.log(np.exp(inner - high).sum())) / math.log(10)
        total += fixed
        x, g = w["enter"][enter], h @ w["turn"]
        z = 1 / (1 + np.exp(-(x[:s] + g[:s])))
        r = 1 / (1 + np.exp(-(x[s : 2 * s] + g[s : 2 * s])))
        h = (1 - z) * np.tanh(x[2 * s :] + r * g[2 * s :]) + z * h
    return total


def test_every_score_against_a_plain_pass(spark, sf_dir):
    """All head: then the score of a document has no part from the join of the tail."""
    docs = documents(spark, sf_dir).where("length(text) < 3000")
    model = lm.fit(docs, rounds=1, share=1)
    v = model.vocabulary
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    common = set(v.words)
    checked = 0
    for r in lm.score(docs, model).collect():
        text = texts[r.doc_id]
        if all(w in common for w in lm.words_of(text)):
            want = plain_log10(v, model.network, text)
            assert abs(r.score - want) < 1e-4 * max(1, abs(want))
            checked += 1
    assert checked > 20


def test_scores_do_not_depend_on_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 900)  # several shards, more than one level of copies
    monkeypatch.setattr(lm, "FAN_IN", 3)
    docs = documents(spark, sf_dir)
    docs = docs.unionByName(docs.limit(5))  # repeated rows as well
    found = []
    for tasks in (2, 16, 64):
        cut = docs.repartition(tasks)
        model = lm.fit(lm.training_part(cut), head=300, share=2)
        rows = lm.score(cut, model).collect()
        found.append(sorted((r.doc_id, r.score) for r in rows))
    for other in found[1:]:
        assert [i for i, _ in other] == [i for i, _ in found[0]]
        for (_, a), (_, b) in zip(found[0], other):
            assert abs(a - b) < 1e-6 * max(1, abs(a))


def test_no_language_column(spark, sf_dir):
    docs = documents(spark, sf_dir).drop("lang")
    assert lm.score(docs, lm.fit(docs, head=50, rounds=1)).count() == docs.count()


def test_every_training_document_is_trained_on_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    average, seen = lm._average, []

    def counted(copies, shards):
        seen.append(copies.agg({"n": "sum"}).first()[0] or 0)
        return average(copies, shards)

    monkeypatch.setattr(lm, "_average", counted)
    docs = lm.training_part(documents(spark, sf_dir))
    model = lm.fit(docs)
    assert len(seen) == lm.ROUNDS and all(seen)
    assert sum(seen) == model.vocabulary.tokens


def test_long_document_does_not_end_in_small_windows():
    v = small_vocabulary()
    docs = documents_of(v, [b"of the " * 2000] + [b"der und. a " * 30] * 64)
    held = lm.Lanes(docs, 32)
    seen, windows = np.zeros(len(held.doc), int), 0
    for at, real in held.windows(16):
        seen[at[real]] += 1
        windows += 1
    assert (seen == 1).all()
    assert windows < 60  # 251 of sixteen words


def test_steps_are_those_of_all_weights():
    """Weights without a slope in a window are left out of its step, which changes nothing."""
    v = small_vocabulary()
    net, plain = lm.Gated.fresh(v), lm.Gated.fresh(v)
    docs = documents_of(v, TEXTS[:1])
    net.train(docs, 1, 1000, 0.08, {})
    held = lm.Lanes(docs, 1)
    at, real = next(held.windows(1000))
    grad, *_ = plain.gradients(
        np.zeros((1, net.state), np.float32), held.inputs[at], held.first[at] & real,
        held.groups[at], held.places[at], real,
    )
    size = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
    for k, g in grad.items():
        g = g * min(1, 5 / (size + 1e-9))
        want = plain.w[k] - 0.08 * g / np.sqrt(1e-3 + g * g)
        assert np.allclose(net.w[k], want, atol=1e-5), k


def test_large_weights_do_not_overflow():
    v = small_vocabulary()
    net = lm.Gated.fresh(v)
    rnd = np.random.default_rng(5)
    for k in ("group_out", "word_out"):
        net.w[k] += rnd.normal(0, 200, net.w[k].shape).astype(np.float32)
    assert not any(lm._near(x, 1.0) for x in net.joint())
    docs = documents_of(v, TEXTS)
    got = net.score(docs, 2, 4) / math.log(10)
    for text, mine in zip(TEXTS, got):
        fixed = sum(v.fixed[k] for k in v.numbers(lm.words_of(text)) if k >= 0)
        assert math.isclose(mine + fixed, plain_log10(v, net, text), rel_tol=1e-4)


def test_batches_are_cut_and_encoded_as_single_texts(spark, sf_dir, odd, monkeypatch):
    monkeypatch.setattr(lm, "HELD_BYTES", 3000)
    v = lm.fit(lm.training_part(documents(spark, sf_dir)), head=300, rounds=1, share=4).vocabulary
    texts = {(i, len((t or "").encode().split()) + 1): (t or "").encode() for i, t in ODD}
    coded = lm._coded(lm._rows(odd, "doc_id", "text"), spark.sparkContext.broadcast(v))
    codes, rows = lm.Codes(v), coded.collect()
    assert len(rows) == len(ODD) and len({(r.task, r.row) for r in rows}) == len(ODD)
    for r in rows:
        words = lm.words_of(texts[r.doc_id, r.n_tokens])
        found, *want = v.encode(words)
        assert all((a == b).all() for a, b in zip(codes.read(lm.pa.scalar(bytes(r.codes))), want))
        tail = Counter(words[k] for k in np.flatnonzero(found < 0))
        assert {bytes(t.word): (t["shape"], t.n) for t in r.tail} == {
            w: (lm.shape_of(w), n) for w, n in tail.items()
        }


def test_a_table_is_encoded_once_for_its_own_model(spark, sf_dir, monkeypatch):
    docs = documents(spark, sf_dir)
    apart = lm.score(docs, lm.fit(lm.training_part(docs), head=300)).collect()
    coded, calls = lm._coded, []
    monkeypatch.setattr(lm, "_coded", lambda *args: calls.append(1) or coded(*args))
    held = lm.in_fold(lm.F.col("doc_id"), lm.FOLDS, lm.HELD_OUT_FOLD)
    model = lm.fit(docs, head=300, held=held)
    once = {r.doc_id: r for r in lm.score_coded(model.coded, model).collect()}
    assert len(calls) == 1 and len(once) == len(apart)
    for r in apart:
        other = once[r.doc_id]
        assert (r.n_tokens, r.n_known) == (other.n_tokens, other.n_known)
        assert math.isclose(r.base_score, other.base_score, rel_tol=1e-6)
        assert math.isclose(r.score, other.score, rel_tol=1e-6)
