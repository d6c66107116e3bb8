"""Tail probabilities against published quantiles; Kernel SHAP against exact Shapley values."""

from itertools import permutations
from math import erfc, exp, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.distributions import chi2_tail, kolmogorov_tail
from tidewatch.operators import attribution as a

# fixed values: published quantiles of the chi-square distribution (value, degrees, tail)
CHI2 = [
    (3.841458820694124, 1, 0.05), (6.6348966010212145, 1, 0.01), (5.991464547107979, 2, 0.05),
    (11.070497693516351, 5, 0.05), (18.307038053275146, 10, 0.05), (9.34181776559197, 10, 0.5),
]
# fixed values: published quantiles of the Kolmogorov distribution (value, tail)
KOLMOGOROV = [
    (1.3580986393225507, 0.05), (1.6276236115189503, 0.01), (1.2238478702170825, 0.1),
    (0.8275735551899077, 0.5),
]


def test_chi2_tail(spark):
    rows = spark.createDataFrame([(x, n) for x, n, _ in CHI2], "x double, n long")
    got = [r.p for r in rows.select(chi2_tail(F.col("x"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([p for *_, p in CHI2], abs=1e-9)


def test_chi2_tail_has_its_closed_forms(spark):
    xs = [0.0, 0.01, 0.7, 3.0, 12.5, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", *[chi2_tail(F.col("x"), F.lit(n)).alias(f"n{n}") for n in (0, 1, 2, 4)]
    )
    for r in rows.collect():
        assert r.n0 is None
        assert r.n1 == pytest.approx(erfc(sqrt(r.x / 2)), abs=1e-12)
        assert r.n2 == pytest.approx(exp(-r.x / 2), abs=1e-12)
        assert r.n4 == pytest.approx(exp(-r.x / 2) * (1 + r.x / 2), abs=1e-12)


def test_kolmogorov_tail(spark):
    rows = spark.createDataFrame([(x,) for x, _ in KOLMOGOROV] + [(0.0,), (None,), (0.05,)], "x double")
    got = [r.p for r in rows.select(kolmogorov_tail(F.col("x")).alias("p")).collect()]
    assert got[:4] == pytest.approx([p for _, p in KOLMOGOROV], abs=1e-9)
    assert got[4] == 1.0 and got[5] is None and got[6] == pytest.approx(1.0)


def test_both_series_meet(spark):
    rows = spark.range(100).select((1.1 + F.col("id") / 500).alias("x"))
    got = [r.p for r in rows.select("x", kolmogorov_tail(F.col("x")).alias("p")).orderBy("x").collect()]
    assert all(p > q for p, q in zip(got, got[1:])) and max(np.abs(np.diff(got))) < 3e-3


def curved():
    def make():
        def predict(x):
            return x[:, 0] * x[:, 1] + np.sin(x[:, 2]) * x[:, 3] + x[:, 4] ** 2
        return predict
    return make


def exact(x, base, predict):
    total = np.zeros(len(x))
    orders = list(permutations(range(len(x))))
    for order in orders:
        row = base.copy()
        before = predict(row[None])[0]
        for j in order:
            row[j] = x[j]
            after = predict(row[None])[0]
            total[j] += after - before
            before = after
    return total / len(orders)


def test_all_coalitions_give_exact_values(spark):
    rng = np.random.default_rng(3)
    xs, base = rng.normal(size=(7, 5)), rng.normal(size=5)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(xs)], "id long, v array<double>")
    found = a.shapley_kernel(rows, "id", "v", curved(), base, n_coalitions=100, block=7)
    got = {(r.instance, r.feature): r.value for r in found.collect()}
    for k, x in enumerate(xs):
        assert [got[k, j] for j in range(5)] == pytest.approx(exact(x, base, curved()()).tolist(), abs=1e-9)


def linear(weights):
    def make():
        return lambda x: x @ weights
    return make


def test_sampled_coalitions_are_exact_for_linear_models(spark):
    rng = np.random.default_rng(4)
    xs, base, w = rng.normal(size=(9, 30)), rng.normal(size=30), rng.normal(size=30)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(xs)], "id long, v array<double>")
    found = a.shapley_kernel(rows.repartition(3), "id", "v", linear(w), base, n_coalitions=400)
    got = {(r.instance, r.feature): r.value for r in found.collect()}
    want = {(k, j): w[j] * (x[j] - base[j]) for k, x in enumerate(xs) for j in range(30)}
    assert got == pytest.approx(want, abs=1e-8)


def test_one_feature_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [3.0])], "id long, v array<double>")
    found = a.shapley_kernel(rows, "id", "v", linear(np.array([2.0])), [1.0]).collect()
    assert [(r.instance, r.feature, r.value) for r in found] == [(1, 0, 4.0)]
    assert a.shapley_kernel(rows.limit(0), "id", "v", linear(np.array([2.0])), [1.0]).count() == 0


def test_attribution_table_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", 0, 0.5), (2, "m", 1, None)], "instance long, method string, feature int, value double")
    path = str(tmp_path / "attributions")
    a.write_attributions(rows, path)
    assert sorted(a.read_attributions(spark, path).collect()) == sorted(rows.collect())
