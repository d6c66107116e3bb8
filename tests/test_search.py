"""Draws are fixed by the seed; halving keeps the settings that are best on the growing shares."""

import math

from pyspark.sql import functions as F

from tidewatch.operators import search

SPACE = {"a": search.Uniform(-1.0, 1.0), "b": search.LogUniform(0.001, 10.0), "c": search.Choice(("x", "y"))}


def test_draws_lie_in_their_ranges_and_repeat(spark):
    drawn = search.draw(spark, SPACE, 200, seed=7)
    assert drawn == search.draw(spark, SPACE, 200, seed=7) != search.draw(spark, SPACE, 200, seed=8)
    assert all(-1 <= s["a"] < 1 and 0.001 <= s["b"] < 10 and s["c"] in "xy" for s in drawn)
    logs = [math.log10(s["b"]) for s in drawn]
    assert abs(sum(logs) / 200 - -1) < 0.3  # the middle of the logarithms
    assert 60 < sum(s["c"] == "x" for s in drawn) < 140


def test_the_best_setting_survives(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 10).cast("double").alias("v"))

    def loss(s):
        return F.abs(F.col("v") - 4.5 - s["a"]) + (0 if s["c"] == "x" else 5)

    found = search.successive_halving(rows, SPACE, loss, ["id"], 12, keep=2, rungs=3).collect()
    assert [sum(r.rung == k for r in found) for k in range(3)] == [6, 3, 3]
    last = [r for r in found if r.rung == 2]
    exact = {r.candidate: sum(abs(v - 4.5 - r.a) for v in range(10)) / 10 + (0 if r.c == "x" else 5) for r in found}
    assert all(abs(r.loss - exact[r.candidate]) < 1e-9 for r in last)
    assert min(exact, key=lambda k: (exact[k], k)) in {r.candidate for r in last}


def test_no_rows_and_unknown_losses(spark):
    rows = spark.range(10).select("id").limit(0)
    found = search.successive_halving(rows, SPACE, lambda s: F.lit(s["a"]), ["id"], 4, rungs=2).collect()
    assert [r.loss for r in found] == [None] * 4
    assert sorted(r.rung for r in found) == [0, 0, 1, 1]
    some = spark.range(50)
    loss = lambda s: F.lit(float("nan") if s["candidate"] % 2 else s["a"])
    found = search.successive_halving(some, SPACE, loss, ["id"], 6, rungs=2).collect()
    assert {r.candidate for r in found if r.rung == 1} == {0, 2, 4}
