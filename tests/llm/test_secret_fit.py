"""The fit of the secret scan on all labelled candidates."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm.test_secret_scan import made_documents
from tidewatch.llm import secret_scan as ss


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_margin_gradient():
    rnd = np.random.default_rng(4)
    net = ss.Network.fresh(5)
    texts = ["a key 0a1b2c3d4e5f6071 here", "wörter " + "Ab3_" * 40, "plainword another-word."]
    places = [[(6, 22)], [(7, 167)], [(0, 9), (10, 23)]]
    laid = ss.Layout(texts, places, np.array([False, False, True, False]))
    y = np.array([1.0, 0.0, 0.0, 1.0])

    def loss():
        z = net.logits_all(laid)
        each = ss.MARGIN / 2 * np.maximum(0, 1 - (2 * y - 1) * z / ss.MARGIN) ** 2
        return each[y == 1].mean() + each[y == 0].mean()

    for name, slopes in zip(net.NAMES, net.margin_gradients(laid, y)):
        p = getattr(net, name)
        flat = np.argsort(-np.abs(slopes).ravel())[:6]
        for k in [*flat, *rnd.integers(0, p.size, 6)]:
            at = np.unravel_index(k, p.shape)
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert slopes[at] == pytest.approx((up - down) / 2e-3, abs=2e-3), name


def test_all_labelled_candidates_count(spark, monkeypatch):
    """Those beyond the sample as well: some train, all others calibrate."""
    monkeypatch.setattr(ss, "SHARD_CANDIDATES", 500)
    monkeypatch.setattr(ss, "STEP_CANDIDATES", 64)
    rows = made_documents(400)
    labels = [
        (text[a:b], state == ss.SECRET)
        for _, text in rows
        for a, b, state in ss.runs(text, ss.base_spans(text))
        if state != ss.REST
    ]
    kept = [label for value, label in labels if ss._of_calibration(value)]
    net = ss.Network.fresh()
    trained = sum(ss._learn(net, [("", "0a" * 9, "")], 0, iter([t]))[1] for _, t in rows)
    assert trained == len(labels) - len(kept) > 500
    seen = []
    monkeypatch.setattr(ss.Network, "calibrate_counts", lambda self, z, y, n, recall: seen.append((y, n)))
    ss.calibrate_on_all(frame(spark, rows), net)
    (y, n), = seen
    assert [n[y == 0].sum(), n[y == 1].sum()] == [len(kept) - sum(kept), sum(kept)]


def test_candidates_beyond_the_sample_change_the_network(spark, monkeypatch):
    """And the table's cut into tasks does not."""
    monkeypatch.setattr(ss, "SHARD_CANDIDATES", 500)
    monkeypatch.setattr(ss, "STEP_CANDIDATES", 64)
    fitted, last = [], ss.calibrate_on_all

    def calibrate(docs, network, recall):
        last(docs, network, recall)
        fitted.append(network)

    monkeypatch.setattr(ss, "calibrate_on_all", calibrate)
    docs = frame(spark, made_documents(400))
    sampled = ss.train(ss.findings(docs, sample=60), 60)
    spans = [
        sorted((r.doc_id, str(r.spans)) for r in ss.scan(docs.repartition(n), sample=60).collect())
        for n in (2, 9)
    ]
    assert np.allclose(fitted[0].packed(), fitted[1].packed(), atol=1e-8)
    assert fitted[0].threshold == pytest.approx(fitted[1].threshold)
    assert spans[0] == spans[1]
    assert not np.allclose(fitted[0].packed(), sampled.packed(), atol=5e-4)
