"""Feature attributions, their ranking, comparison and stability.

Linear-logistic models are attributed with column expressions. Sampled methods
work on Arrow batches and take any model callable. All give long rows
``(instance, feature, value)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.expressions import double_array, let, sigmoid, unit_hash
from tidewatch.operators.ordered import row_numbers
from tidewatch.operators.scoring import linear_logit
from tidewatch.sources.tables import read_table

def mean_baseline(df: DataFrame, vector: str) -> list[float]:
    """Element-wise mean; one number per element comes to the driver."""
    rows = (
        df.select(F.posexplode(vector).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .orderBy("pos")
        .collect()
    )
    return [r["m"] for r in rows]


def long_rows(df: DataFrame, instance: str, values: Column, method: str | None = None):
    rows = df.select(F.col(instance).alias("instance"), F.posexplode(values).alias("feature", "value"))
    if method is None:
        return rows
    return rows.select("instance", F.lit(method).alias("method"), "feature", "value")


def _slope(logit: Column) -> Column:
    return let(sigmoid(logit), lambda p: p * (1 - p))


def _scaled(values: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(values, lambda v: v * f))


def _product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y)


def saliency(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Absolute gradient."""
    slope = _slope(linear_logit(vector, weights, bias))
    return _scaled(double_array([abs(w) for w in weights]), slope)


def input_x_gradient(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    slope = _slope(linear_logit(vector, weights, bias))
    return _scaled(_product(vector, double_array(weights)), slope)


def integrated_gradients(
    vector: Column,
    weights: Sequence[float],
    baseline: Sequence[float],
    bias: float = 0.0,
    n_steps: int = 50,
) -> Column:
    """Gradient averaged over the midpoints of ``n_steps`` parts of the straight path.

    Along the path the logit moves on a line, so one number per step is enough
    for all features.
    """
    start = float(bias + sum(w * b for w, b in zip(weights, baseline)))
    at = double_array([(k + 0.5) / n_steps for k in range(n_steps)])

    def along(end: Column) -> Column:
        return F.aggregate(
            at, F.lit(0.0), lambda acc, a: acc + _slope(F.lit(start) + (end - start) * a)
        )

    total = let(linear_logit(vector, weights, bias), along)
    moved = F.zip_with(vector, double_array(baseline), lambda x, b: x.cast("double") - b)
    return _scaled(_product(moved, double_array(weights)), total / n_steps)


def shapley_linear(
    vector: Column, weights: Sequence[float], background: Sequence[float]
) -> Column:
    """Exact Shapley values of a linear logit: weight times distance from the mean."""
    moved = F.zip_with(vector, double_array(background), lambda x, b: x.cast("double") - b)
    return _product(moved, double_array(weights))


def noise_baselines(width: int, n_samples: int, sigma: float, seed: int) -> list[list[float]]:
    """Gaussian baselines fixed by the seed alone, to be shared by all instances."""
    return np.random.default_rng(seed).normal(0.0, sigma, (n_samples, width)).tolist()


def baseline_of(
    df: DataFrame, vector: str, width: int, kind: str = "zeros", sigma: float = 0.1, seed: int = 42
) -> list[float]:
    """A baseline by name: zeros, the mean of all rows, or Gaussian noise."""
    if kind == "zeros":
        return [0.0] * width
    if kind == "mean":
        return mean_baseline(df, vector)
    if kind == "gaussian_noise":
        return noise_baselines(width, 1, sigma, seed)[0]
    raise ValueError(f"unknown baseline: {kind}")


def gradient_shap(
    df: DataFrame, instance: str, vector: str, weights: Sequence[float], bias: float = 0.0,
    n_samples: int = 50, sigma: float = 0.1, seed: int = 42,
) -> DataFrame:
    """Gradients at random points between noise baselines and the input, averaged.

    The baselines depend on the seed, the point on the way on seed, instance and sample. The
    logit moves on a line between the two, so one slope per sample serves all features.
    """
    bases = noise_baselines(len(weights), n_samples, sigma, seed)
    starts = [float(bias + np.dot(b, weights)) for b in bases]
    per_feature = F.array(*[double_array(list(column)) for column in zip(*bases)])

    def slopes(end: Column) -> Column:
        shares = F.array(
            *[unit_hash(seed, F.col(instance), F.lit(k)) for k in range(n_samples)]
        )
        return F.zip_with(
            double_array(starts), shares, lambda z, t: _slope(z + t * (end - z))
        )

    rows = df.select(
        F.col(instance), F.col(vector), let(linear_logit(F.col(vector), weights, bias), slopes).alias("_s")
    ).withColumn("_all", F.aggregate("_s", F.lit(0.0), lambda acc, v: acc + v))
    moved = F.zip_with(
        vector, per_feature,
        lambda x, b: x.cast("double") * F.col("_all")
        - F.aggregate(F.zip_with(b, "_s", lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v),
    )
    values = F.zip_with(moved, double_array(weights), lambda m, w: m * w / n_samples)
    return long_rows(rows, instance, values, "gradient_shap")


def component_predict(
    make_predict: Callable[[], Callable], background: Sequence[float], component: Sequence[int]
) -> Callable[[], Callable]:
    """The model with every feature outside the component held at its mean."""
    means, own = np.array(background, dtype=float), list(component)

    def make():
        predict = make_predict()

        def run(matrix):
            filled = np.tile(means, (len(matrix), 1))
            filled[:, own] = np.asarray(matrix)[:, own]
            return predict(filled)

        return run

    return make


def feature_orders(width: int, n_orders: int, seed: int) -> list[np.ndarray]:
    """Random orders of the features, fixed by the seed alone."""
    return [np.random.default_rng([seed, k]).permutation(width) for k in range(n_orders)]


def shapley_sampled(
    df: DataFrame, instance: str, vector: str, make_predict: Callable[[], Callable],
    background: Sequence[float], n_orders: int = 20, seed: int = 42, rows_per_call: int = 128,
) -> DataFrame:
    """Mean marginal change over sampled feature orders, for any model callable.

    Features are switched from the background to the instance one by one. The
    orders depend on the seed alone.
    """
    base = np.array(background, dtype=float)

    def run(frames):
        predict = make_predict()
        d = len(base)
        orders = feature_orders(d, n_orders, seed)
        # row j of a block has the first j features of the order switched
        masks = [np.argsort(order)[None, :] < np.arange(d + 1)[:, None] for order in orders]
        for frame in frames:
            for start in range(0, len(frame), rows_per_call):
                part = frame.iloc[start : start + rows_per_call]
                x = np.stack([np.asarray(v, dtype=float) for v in part["_v"]])
                total = np.zeros_like(x)
                for order, switched in zip(orders, masks):
                    mixed = np.where(switched[None], x[:, None, :], base)
                    p = np.asarray(predict(mixed.reshape(-1, d))).reshape(len(x), d + 1)
                    total[:, order] += np.diff(p, axis=1)
                yield pd.DataFrame(
                    {"instance": part["_id"].to_numpy(), "values": list(total / n_orders)}
                )

    mapped = df.select(F.col(instance).cast("long").alias("_id"), F.col(vector).alias("_v"))
    return long_rows(
        mapped.mapInPandas(run, "instance long, values array<double>"),
        "instance", F.col("values"), "shapley",
    )


def kernel_coalitions(width: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions as rows of 0 and 1, and their weights.

    All proper ones with the Shapley kernel's weights if there are at most ``n``. Else ``n`` drawn ones of
    equal weight: sizes by the kernel, members at random, each followed by its complement.
    """
    sizes = np.arange(1, width)
    if width <= 20 and 2**width - 2 <= n:
        numbers = np.arange(1, 2**width - 1)
        masks = (numbers[:, None] >> np.arange(width) & 1).astype(float)
        held = masks.sum(axis=1).astype(int)
        return masks, np.array([(width - 1) / (comb(width, k) * k * (width - k)) for k in held])
    rng = np.random.default_rng(seed)
    share = 1.0 / (sizes * (width - sizes))
    drawn = rng.choice(sizes, n // 2, p=share / share.sum())
    masks = (np.argsort(rng.random((len(drawn), width)), axis=1) < drawn[:, None]).astype(float)
    return np.stack([masks, 1 - masks], axis=1).reshape(-1, width), np.ones(2 * len(drawn))


def shapley_kernel(
    df: DataFrame, instance: str, vector: str, make_predict: Callable[[], Callable],
    background: Sequence[float], n_coalitions: int = 2048, seed: int = 42, block: int = 512,
    rows_per_call: int = 64,
) -> DataFrame:
    """Shapley values as the weighted least squares fit over coalitions, for any model callable.

    The coalitions are the same for all instances, so they share one normal matrix of the size of the features;
    its inverse is a constant. An instance meets the coalitions in blocks, each a row of its own that may be
    evaluated elsewhere; the right-hand sides of the blocks are summed in Spark and solved per instance. That
    the values add up to the change of the model is kept by taking the last feature from the others.
    """
    base = np.array(background, dtype=float)
    d = len(base)
    masks, weights = kernel_coalitions(d, n_coalitions, seed)
    reduced = masks[:, :-1] - masks[:, -1:]
    inverse = np.linalg.pinv(reduced.T @ (weights[:, None] * reduced)) if d > 1 else np.zeros((0, 0))
    n_blocks = max(1, -(-len(masks) // block))

    def run(frames):
        predict = make_predict()
        empty = float(np.asarray(predict(base[None]))[0])
        for frame in frames:
            for number, rows in frame.groupby("_block"):
                part = slice(number * block, (number + 1) * block)
                z, left = masks[part], reduced[part] * weights[part, None]
                for start in range(0, len(rows), rows_per_call):
                    some = rows.iloc[start : start + rows_per_call]
                    x = np.stack([np.asarray(v, dtype=float) for v in some["_v"]])
                    total = np.asarray(predict(x)) - empty
                    mixed = np.where(z[None] > 0, x[:, None, :], base).reshape(-1, d)
                    y = np.asarray(predict(mixed)).reshape(len(x), len(z)) if len(z) else np.zeros((len(x), 0))
                    right = (y - empty - total[:, None] * z[:, -1]) @ left
                    yield pd.DataFrame(
                        {"instance": some["_id"].to_numpy(), "right": list(right), "total": total}
                    )

    spread = df.select(
        F.col(instance).cast("long").alias("_id"), F.col(vector).alias("_v"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"),
    )
    parts = spread.mapInPandas(run, "instance long, right array<double>, total double")
    summed = parts.groupBy("instance").agg(
        F.array(*[F.sum(F.get("right", F.lit(j))) for j in range(d - 1)]).alias("right"),
        F.max("total").alias("total"),
    )
    solved = F.transform(
        F.array(*[double_array(row) for row in inverse.tolist()]) if d > 1 else F.array().cast("array<array<double>>"),
        lambda row: F.aggregate(F.zip_with(row, "right", lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v),
    )
    rows = summed.select("instance", "total", solved.alias("_s"))
    last = F.col("total") - F.aggregate("_s", F.lit(0.0), lambda acc, v: acc + v)
    return long_rows(rows, "instance", F.concat("_s", F.array(last)), "shapley_kernel")


ATTRIBUTIONS = "instance long, method string, feature int, value double"


def write_attributions(rows: DataFrame, path: str) -> None:
    """The long table of ``instance, method, feature, value`` as CSV with header, one file per task."""
    rows.selectExpr("instance", "method", "feature", "value").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def read_attributions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ATTRIBUTIONS, "csv")


def gaussian(seed: int, *ids: Column) -> Column:
    """A standard normal number fixed by seed and ids."""
    u = 1 - unit_hash(seed, *ids, F.lit("u"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * unit_hash(seed, *ids, F.lit("v")))


def with_noise(
    df: DataFrame, instance: str, vector: str, n_runs: int, sigma: float, seed: int = 42
) -> DataFrame:
    """Add ``noisy``: ``n_runs`` copies of the vector with Gaussian noise.

    Noise is fixed by seed, instance, run and position.
    """
    noisy = [
        F.transform(
            vector,
            lambda x, at: x.cast("double")
            + gaussian(seed, F.col(instance), F.lit(run), at) * sigma,
        )
        for run in range(n_runs)
    ]
    return df.select(instance, vector, F.array(*noisy).alias("noisy"))


def attribution_stability(
    df: DataFrame, instance: str, vector: str, attribute: Callable[[Column], Column],
    n_runs: int = 5, sigma: float = 0.01, seed: int = 42,
) -> DataFrame:
    """Correlation of noisy with plain attributions, and their spread over the runs.

    The runs of an instance stay in its row, so cells are not shuffled.
    """
    rows = with_noise(df, instance, vector, n_runs, sigma, seed)
    plain, noisy = attribute(F.col(vector)), F.transform("noisy", attribute)
    cells = rows.select(plain.alias("a"), noisy.alias("n")).select(
        F.posexplode("a").alias("pos", "a"), "n"
    ).select("a", F.transform("n", lambda run: run[F.col("pos")]).alias("n"))
    mean = F.aggregate("n", F.lit(0.0), lambda s, v: s + v) / n_runs
    var = F.aggregate("n", F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n_runs
    runs = [F.corr("a", F.col("n")[i]).alias(f"r{i}") for i in range(n_runs)]
    one = cells.agg(*runs, F.avg(F.sqrt(var)).alias("mean_std"))
    r = F.array(*[f"r{i}" for i in range(n_runs)])
    mean_r = F.aggregate(r, F.lit(0.0), lambda s, v: s + v) / n_runs
    var_r = F.aggregate(r, F.lit(0.0), lambda s, v: s + (v - mean_r) * (v - mean_r)) / n_runs
    return one.select(
        r.alias("correlations"), mean_r.alias("mean_correlation"),
        F.sqrt(var_r).alias("std_correlation"), "mean_std",
    )


def feature_importance(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Features by mean absolute value, largest first."""
    ranked = (
        rows.groupBy("feature")
        .agg(F.avg(F.abs("value")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
    return ranked.limit(k) if k else ranked


def top_features(rows: DataFrame, k: int, by: Sequence[str] = ("instance", "method")) -> DataFrame:
    """The k features with the largest absolute value per instance and method."""
    spec = Window.partitionBy(*by).orderBy(F.desc(F.abs("value")), "feature")
    return rows.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)


def method_comparison(
    rows: DataFrame, instance: int, methods: Sequence[str], k: int = 20
) -> DataFrame:
    """Methods side by side for one instance, over the union of their top-k features."""
    own = rows.filter(F.col("instance") == instance)
    chosen = top_features(own, k).select("feature").distinct()
    wide = (
        own.join(chosen, "feature", "left_semi")
        .groupBy("feature")
        .agg(*[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in methods])
    )
    biggest = F.greatest(*[F.abs(m) for m in methods])
    return wide.orderBy(F.desc(biggest), "feature").limit(k)


def waterfall(rows: DataFrame, base: float) -> DataFrame:
    """Contributions by falling size with the running prediction they lead to.

    A group holds one instance's features, so its size is the model's width.
    """
    order = Window.partitionBy("instance").orderBy(F.desc(F.abs("value")), "feature")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "instance", "feature", "value",
        F.row_number().over(order).alias("step"),
        (F.lit(base) + F.sum("value").over(upto)).alias("cumulative"),
    )


MODULUS = 2_147_483_647


def shuffle_rank(ids: np.ndarray, feature: int, repeat: int, seed: int) -> np.ndarray:
    """Positions of the ids in a pseudo-random order; ties go to the smaller id.

    The square of a linear mix modulo a prime, which any engine can repeat exactly.
    """
    mixed = (ids % MODULUS * 48_271 + (feature * 1_009 + repeat) * 69_621 + seed) % MODULUS
    return np.lexsort((ids, mixed * mixed % MODULUS))


def permutation_importance(
    df: DataFrame, instance: str, vector: str, label: str,
    make_predict: Callable[[], Callable], width: int, threshold: float = 0.5,
    n_repeats: int = 10, seed: int = 42, block_rows: int = 4096,
) -> DataFrame:
    """Loss of accuracy when one feature is shuffled, mean and deviation over repeats.

    Rows are numbered by a hash of their id and cut into blocks of exactly ``block_rows``;
    a feature is shuffled within its block. So the result does not depend on how
    the rows are partitioned. Blocks pass on only their counts of right answers.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        predict = make_predict()
        frame = frame.sort_values("_at")
        x = np.stack([np.asarray(v, dtype=float) for v in frame["_v"]])
        y, ids = frame["_y"].to_numpy(), frame["_id"].to_numpy(np.int64)
        right = int(((np.asarray(predict(x)) > threshold) == (y == 1)).sum())
        out = []
        for feature in range(width):
            kept = x[:, feature].copy()
            for repeat in range(n_repeats):
                x[:, feature] = kept[shuffle_rank(ids, feature, repeat, seed)]
                hits = ((np.asarray(predict(x)) > threshold) == (y == 1)).sum()
                out.append((feature, repeat, len(x), right, int(hits)))
            x[:, feature] = kept
        return pd.DataFrame(out, columns=["feature", "repeat", "n", "plain", "shuffled"])

    rows = df.select(
        F.col(instance).cast("long").alias("_id"),
        F.col(vector).alias("_v"),
        F.col(label).cast("int").alias("_y"),
        unit_hash(seed, F.col(instance)).alias("_u"),
    )
    numbered = row_numbers(rows, [], ["_u", "_id"], "_at")
    blocks = numbered.withColumn("_block", F.floor((F.col("_at") - 1) / block_rows))
    counts = blocks.groupBy("_block").applyInPandas(
        run, "feature int, repeat int, n long, plain long, shuffled long"
    )
    return (
        counts.groupBy("feature", "repeat")
        .agg(((F.sum("plain") - F.sum("shuffled")) / F.sum("n")).alias("drop"))
        .groupBy("feature")
        .agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std"))
    )


def noise_perturb(
    df: DataFrame, instance: str, columns: Sequence[str], sigma: float = 0.01, seed: int = 42
) -> DataFrame:
    """Gaussian noise on each column, drawn from a hash of seed, column and instance.

    A repeated task draws the same noise, whatever the order of its rows.
    """

    def noise(position: int) -> Column:
        u = 1 - unit_hash(seed, F.lit(2 * position), F.col(instance))
        v = unit_hash(seed, F.lit(2 * position + 1), F.col(instance))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)

    return df.withColumns({c: F.col(c) + noise(i) * sigma for i, c in enumerate(columns)})
