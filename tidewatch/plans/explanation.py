"""Scoring, model fitting and attribution over the embedding vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import attribution as a
from tidewatch.operators import metrics, scoring, search, splits
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import query
from tidewatch.session import work_folder
from tidewatch.sources import tables


def vectors(spark, d):
    return i.table(spark, d, "embeddings")


def make_linear(weights=tuple(i.WEIGHTS)):
    """Loader of the fixed linear model, for the batch and sampling operators."""

    def make():
        import numpy as np

        w = np.array(weights)

        def predict(matrix):
            return 1 / (1 + np.exp(-(np.asarray(matrix, dtype=float) @ w)))

        return predict

    return make


@query(
    "batch_score",
    f"SELECT vec_id, round(1 / (1 + exp(-{i.LOGIT_SQL})), 6) AS p FROM embeddings",
)
def batch_score(spark, d):
    rows = scoring.batch_score(vectors(spark, d), "embedding", make_linear(), i.WIDTH)
    return i.finished(rows.select("vec_id", "p"), 6)


CELLS_SQL = (
    f"w AS (SELECT unnest(range(64))::INT AS feature, unnest({i.VECTOR_SQL}) AS w), "
    "x AS (SELECT vec_id AS instance, unnest(range(64))::INT AS feature, "
    "unnest(embedding)::DOUBLE AS x FROM embeddings), "
    f"z AS (SELECT vec_id AS instance, {i.LOGIT_SQL} AS z FROM embeddings), "
    "s AS (SELECT instance, z, exp(-z) / pow(1 + exp(-z), 2) AS slope FROM z)"
)


@query(
    "shapley_linear",
    f"WITH {CELLS_SQL}, m AS (SELECT feature, avg(x) AS m FROM x GROUP BY feature) "
    "SELECT instance, feature, round(w * (x - m), 8) + 0.0 AS value FROM x JOIN w USING (feature) "
    "JOIN m USING (feature)",
)
def shapley_linear(spark, d):
    rows = vectors(spark, d)
    mean = a.mean_baseline(rows, "embedding")
    values = a.shapley_linear(F.col("embedding"), i.WEIGHTS, mean)
    return i.finished(a.long_rows(rows, "vec_id", values), 8)


SALIENCY_SQL = "SELECT instance, feature, abs(w) * slope AS value FROM w CROSS JOIN s"
GRADIENT_SQL = (
    "SELECT instance, feature, x * w * slope AS value FROM x JOIN w USING (feature) "
    "JOIN s USING (instance)"
)
PATH_SQL = (
    "path AS (SELECT instance, avg(exp(-z * a) / pow(1 + exp(-z * a), 2)) AS slope FROM z "
    "CROSS JOIN (SELECT (unnest(range(1, 51)) - 0.5) / 50 AS a) GROUP BY instance)"
)
INTEGRATED_SQL = (
    "SELECT instance, feature, x * w * slope AS value FROM x JOIN w USING (feature) "
    "JOIN path USING (instance)"
)


def _rounded(sql: str) -> str:
    return f"SELECT instance, feature, round(value, 8) + 0.0 AS value FROM ({sql})"


@query("saliency", f"WITH {CELLS_SQL} {_rounded(SALIENCY_SQL)}")
def saliency(spark, d):
    values = a.saliency(F.col("embedding"), i.WEIGHTS)
    return i.finished(a.long_rows(vectors(spark, d), "vec_id", values), 8)


@query("input_x_gradient", f"WITH {CELLS_SQL} {_rounded(GRADIENT_SQL)}")
def input_x_gradient(spark, d):
    values = a.input_x_gradient(F.col("embedding"), i.WEIGHTS)
    return i.finished(a.long_rows(vectors(spark, d), "vec_id", values), 8)


ZEROS = [0.0] * i.WIDTH


@query("integrated_gradients", f"WITH {CELLS_SQL}, {PATH_SQL} {_rounded(INTEGRATED_SQL)}")
def integrated_gradients(spark, d):
    values = a.integrated_gradients(F.col("embedding"), i.WEIGHTS, ZEROS)
    return i.finished(a.long_rows(vectors(spark, d), "vec_id", values), 8)


@query(
    "integrated_gradients_mean",
    f"WITH {CELLS_SQL}, m AS (SELECT feature, avg(x) AS m FROM x GROUP BY feature), "
    "b AS (SELECT sum(m * w) AS zb FROM m JOIN w USING (feature)), "
    "line AS (SELECT instance, zb + a * (z - zb) AS t FROM z CROSS JOIN b "
    "CROSS JOIN (SELECT (unnest(range(1, 51)) - 0.5) / 50 AS a)), "
    "path AS (SELECT instance, avg(exp(-t) / pow(1 + exp(-t), 2)) AS slope FROM line GROUP BY 1) "
    "SELECT instance, feature, round((x - m) * w * slope, 8) + 0.0 AS value FROM x "
    "JOIN w USING (feature) JOIN m USING (feature) JOIN path USING (instance)",
)
def integrated_gradients_mean(spark, d):
    rows = vectors(spark, d)
    mean = a.mean_baseline(rows, "embedding")
    values = a.integrated_gradients(F.col("embedding"), i.WEIGHTS, mean)
    return i.finished(a.long_rows(rows, "vec_id", values), 8)


def _numbers(values) -> str:
    """A list of lists of numbers as SQL text."""
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in values) + "]"


def _hash_sql(*parts: str) -> str:
    """The hash of seed 42 and these SQL texts as a number in [0, 1)."""
    text = " || ".join(f"'|' || ({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5('42' || {text}), 1, 8))::BIGINT / 4294967296.0)"


N_SAMPLES, SIGMA = 50, 0.1


@query(
    "gradient_shap",
    f"WITH {CELLS_SQL}, b AS (SELECT (unnest(range({N_SAMPLES})))::INT AS k, "
    f"unnest({_numbers(a.noise_baselines(i.WIDTH, N_SAMPLES, SIGMA, 42))}::DOUBLE[][]) AS base), "
    f"zb AS (SELECT k, base, list_dot_product(base, {i.VECTOR_SQL}) AS zb FROM b), "
    f"m AS (SELECT instance, k, base, zb + {_hash_sql('instance', 'k')} * (z - zb) AS t "
    "FROM z CROSS JOIN zb), "
    "q AS (SELECT instance, k, base, exp(-t) / pow(1 + exp(-t), 2) AS s FROM m), "
    "f AS (SELECT instance, unnest(range(64))::INT AS feature, unnest(base) AS b, s FROM q) "
    "SELECT instance, 'gradient_shap' AS method, feature, "
    f"round(sum((x - b) * w * s) / {N_SAMPLES}, 8) + 0.0 AS value "
    "FROM f JOIN x USING (instance, feature) JOIN w USING (feature) GROUP BY instance, feature",
)
def gradient_shap(spark, d):
    rows = a.gradient_shap(
        vectors(spark, d), "vec_id", "embedding", i.WEIGHTS, n_samples=N_SAMPLES, sigma=SIGMA
    )
    return i.finished(rows, 8)


N_ORDERS = 20


def _shapley_sql(own: int) -> str:
    """Marginal changes along the fixed orders, features from ``own`` on held at their means."""
    orders = _numbers(a.feature_orders(i.WIDTH, N_ORDERS, 42))
    return (
        f"WITH {CELLS_SQL}, m AS (SELECT feature, avg(x) AS m FROM x GROUP BY feature), "
        f"o AS (SELECT o, unnest(fs)::INT AS feature, unnest(range(64)) AS k FROM (SELECT "
        f"unnest(range({N_ORDERS})) AS o, unnest({orders}) AS fs)), "
        "base AS (SELECT sum(m * w) AS z0 FROM m JOIN w USING (feature)), "
        f"steps AS (SELECT instance, feature, CASE WHEN feature < {own} THEN (x - m) * w ELSE 0 END "
        "AS step FROM x JOIN m USING (feature) JOIN w USING (feature)), "
        "run AS (SELECT instance, o, feature, step, z0 + sum(step) OVER (PARTITION BY instance, o "
        "ORDER BY k ROWS UNBOUNDED PRECEDING) AS z FROM steps JOIN o USING (feature) CROSS JOIN base) "
        "SELECT instance, feature, round(avg(1 / (1 + exp(-z)) - 1 / (1 + exp(step - z))), 8) + 0.0 "
        "AS value, 'shapley' AS method FROM run GROUP BY instance, feature"
    )


@query("shapley_sampled", _shapley_sql(i.WIDTH))
def shapley_sampled(spark, d):
    rows = vectors(spark, d)
    mean = a.mean_baseline(rows, "embedding")
    found = a.shapley_sampled(
        rows, "vec_id", "embedding", make_linear(), mean, n_orders=N_ORDERS
    )
    return i.finished(found, 8)


@query("shapley_component", _shapley_sql(i.WIDTH // 2))
def shapley_component(spark, d):
    """Shapley values of the first half of the features, the rest held at their means."""
    rows = vectors(spark, d)
    mean = a.mean_baseline(rows, "embedding")
    model = a.component_predict(make_linear(), mean, range(i.WIDTH // 2))
    found = a.shapley_sampled(rows, "vec_id", "embedding", model, mean, n_orders=N_ORDERS)
    return i.finished(found, 8)


EXACT_SQL = (
    f"WITH {CELLS_SQL}, m AS (SELECT feature, avg(x) AS m FROM x GROUP BY feature) "
    "SELECT instance, '{}' AS method, feature, round(w * (x - m), 8) + 0.0 AS value FROM x "
    "JOIN w USING (feature) JOIN m USING (feature)"
)


def make_logit(weights=tuple(i.WEIGHTS)):
    """Loader of the fixed linear model before its sigmoid."""

    def make():
        import numpy as np

        return lambda matrix: np.asarray(matrix, dtype=float) @ np.array(weights)

    return make


@query("shapley_kernel", EXACT_SQL.format("shapley_kernel"))
def shapley_kernel(spark, d):
    """The least squares fit over sampled coalitions, which is exact where the model is linear."""
    rows = vectors(spark, d)
    mean = a.mean_baseline(rows, "embedding")
    return i.finished(a.shapley_kernel(rows, "vec_id", "embedding", make_logit(), mean, 512), 8)


@query("attribution_table", EXACT_SQL.format("shapley_linear"))
def attribution_table(spark, d):
    """The long attribution table, written as CSV and read back."""
    rows = vectors(spark, d)
    values = a.shapley_linear(F.col("embedding"), i.WEIGHTS, a.mean_baseline(rows, "embedding"))
    path = work_folder(spark, "attributions")
    a.write_attributions(a.long_rows(rows, "vec_id", values, "shapley_linear"), path)
    return i.finished(a.read_attributions(spark, path), 8)


N_RUNS, SPREAD = 5, 0.01
_U, _V = (_hash_sql("instance", "run", "feature", f"'{c}'") for c in "uv")
_NOISE = f"sqrt(-2 * ln(1 - {_U})) * cos(2 * pi() * {_V})"
_PATH = "(SELECT (unnest(range(1, 51)) - 0.5) / 50 AS a)"


@query(
    "attribution_stability",
    f"WITH {CELLS_SQL}, runs AS (SELECT unnest(range({N_RUNS}))::INT AS run), "
    f"nx AS (SELECT instance, run, feature, x + {SPREAD} * {_NOISE} AS x FROM x CROSS JOIN runs), "
    "nz AS (SELECT instance, run, sum(x * w) AS z FROM nx JOIN w USING (feature) GROUP BY 1, 2), "
    "np AS (SELECT instance, run, avg(exp(-z * a) / pow(1 + exp(-z * a), 2)) AS slope "
    f"FROM nz CROSS JOIN {_PATH} GROUP BY 1, 2), "
    "n AS (SELECT instance, run, feature, x * w * slope AS n FROM nx JOIN w USING (feature) "
    "JOIN np USING (instance, run)), "
    f"{PATH_SQL}, p AS (SELECT instance, feature, value AS p FROM ({INTEGRATED_SQL})), "
    "r AS (SELECT run, corr(p, n) AS r FROM n JOIN p USING (instance, feature) GROUP BY run), "
    "spread AS (SELECT avg(s) AS mean_std FROM (SELECT stddev_pop(n) AS s FROM n "
    "GROUP BY instance, feature)) "
    "SELECT round(avg(r), 6) AS mean_correlation, round(stddev_pop(r), 6) AS std_correlation, "
    "count(*) AS n_runs, round(min(r), 6) AS least_correlation, "
    "round(any_value(mean_std), 6) AS mean_std FROM r CROSS JOIN spread",
)
def attribution_stability(spark, d):
    found = a.attribution_stability(
        vectors(spark, d), "vec_id", "embedding",
        lambda v: a.integrated_gradients(v, i.WEIGHTS, ZEROS), n_runs=N_RUNS, sigma=SPREAD,
    )
    return i.finished(
        found.select(
            "mean_correlation", "std_correlation",
            F.size("correlations").cast("long").alias("n_runs"),
            F.array_min("correlations").alias("least_correlation"), "mean_std",
        ),
        6,
    )


def _gradient_rows(spark, d):
    values = a.input_x_gradient(F.col("embedding"), i.WEIGHTS)
    return a.long_rows(vectors(spark, d), "vec_id", values, "input_x_gradient")


@query(
    "feature_importance",
    f"WITH {CELLS_SQL} SELECT feature, round(avg(abs(value)), 8) AS importance "
    f"FROM ({GRADIENT_SQL}) GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 20",
)
def feature_importance(spark, d):
    folder = work_folder(spark, "importance")
    ranked = i.finished(a.feature_importance(_gradient_rows(spark, d), 20), 8)
    tables.write_manifest(ranked, folder, ["feature", "importance"], single_file=True)
    return tables.read_table(spark, folder, "feature int, importance double", "csv")


@query(
    "topk_per_instance",
    f"WITH {CELLS_SQL} SELECT instance, feature, rank, value FROM (SELECT *, row_number() "
    "OVER (PARTITION BY instance ORDER BY abs(value) DESC, feature)::INT AS rank FROM "
    f"(SELECT instance, feature, round(value, 10) + 0.0 AS value FROM ({GRADIENT_SQL}))) "
    "WHERE rank <= 10",
)
def topk_per_instance(spark, d):
    rows = _gradient_rows(spark, d).withColumn("value", F.round("value", 10) + F.lit(0.0))
    return a.top_features(rows, 10).drop("method")


@query(
    "method_comparison",
    f"WITH {CELLS_SQL}, {PATH_SQL}, r AS (SELECT 'saliency' AS method, * FROM ({SALIENCY_SQL}) "
    f"UNION ALL SELECT 'input_x_gradient', * FROM ({GRADIENT_SQL}) "
    f"UNION ALL SELECT 'integrated_gradients', * FROM ({INTEGRATED_SQL})), "
    "own AS (SELECT method, feature, round(value, 10) AS value FROM r WHERE instance = 7), "
    "chosen AS (SELECT DISTINCT feature FROM (SELECT feature, row_number() OVER "
    "(PARTITION BY method ORDER BY abs(value) DESC, feature) AS rn FROM own) WHERE rn <= 10) "
    "SELECT feature, max(value) FILTER (WHERE method = 'saliency') + 0.0 AS saliency, "
    "max(value) FILTER (WHERE method = 'input_x_gradient') + 0.0 AS input_x_gradient, "
    "max(value) FILTER (WHERE method = 'integrated_gradients') + 0.0 AS integrated_gradients "
    "FROM own JOIN chosen USING (feature) GROUP BY feature "
    "ORDER BY max(abs(value)) DESC, feature LIMIT 10",
)
def method_comparison(spark, d):
    rows = vectors(spark, d)
    v = F.col("embedding")
    parts = {
        "saliency": a.saliency(v, i.WEIGHTS),
        "input_x_gradient": a.input_x_gradient(v, i.WEIGHTS),
        "integrated_gradients": a.integrated_gradients(v, i.WEIGHTS, ZEROS),
    }
    joined = None
    for name, values in parts.items():
        part = a.long_rows(rows, "vec_id", values, name)
        joined = part if joined is None else joined.unionByName(part)
    joined = joined.withColumn("value", F.round("value", 10) + F.lit(0.0))
    return a.method_comparison(joined, 7, list(parts), 10)


@query(
    "waterfall_cumulative",
    f"WITH {CELLS_SQL}, g AS (SELECT instance, feature, round(value, 10) + 0.0 AS value "
    f"FROM ({GRADIENT_SQL})) SELECT instance, feature, value, "
    "row_number() OVER w::INT AS step, round(0.15 + sum(value) OVER w, 10) + 0.0 AS cumulative "
    "FROM g WINDOW w AS (PARTITION BY instance ORDER BY abs(value) DESC, feature)",
)
def waterfall_cumulative(spark, d):
    rows = _gradient_rows(spark, d).withColumn("value", F.round("value", 10) + F.lit(0.0))
    return i.finished(a.waterfall(rows, 0.15), 10)


def _training(spark, d):
    rows = vectors(spark, d).withColumn("y", (F.col("label") < 3).cast("int"))
    rows = rows.withColumn("split", splits.split_of(F.col("vec_id")))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return train, test, splits.class_weights(train, "y", (0, 1))


_SPLIT_U = _hash_sql("vec_id")


@query(
    "fit_risk_model",
    f"WITH t AS (SELECT label < 3 AS y, {_SPLIT_U} AS u FROM embeddings) SELECT "
    "count(*) FILTER (WHERE y AND u >= 0.85) AS n_pos, count(*) FILTER (WHERE NOT y AND u >= 0.85) "
    "AS n_neg, true AS auroc_in_range, true AS at_optimum FROM t",
)
def fit_risk_model(spark, d):
    """A class-weighted logistic model fitted on the train split and tested on the test split.

    At the optimum the weighted residuals sum to zero, as the intercept is not penalised.
    """
    train, test, weights = _training(spark, d)
    rows = scoring.labelled_vectors(train, "embedding", "y", weights)
    model = scoring.fit_risk_model(rows, regParam=0.1, tol=1e-9, maxIter=200)
    residual = model.transform(rows).agg(
        (
            F.sum(F.col("weight") * (vector_to_array("probability")[1] - F.col("label")))
            / F.sum("weight")
        ).alias("r")
    )
    scored = scoring.model_scores(model, scoring.labelled_vectors(test, "embedding", "y"))
    return metrics.areas(scored, "label", "p").select(
        "n_pos", "n_neg",
        F.col("auroc").between(0.0, 1.0).alias("auroc_in_range"),
        (F.abs(residual.scalar()) < 1e-4).alias("at_optimum"),
    )


GRID, MIXES = (0.001, 0.01, 0.1), (0.0, 0.5)


@query(
    "tune_model",
    f"SELECT r AS reg_param, m AS elastic_net, 3 AS n_folds, true AS auroc_in_range FROM "
    f"(SELECT unnest({list(GRID)}::DOUBLE[]) AS r), (SELECT unnest({list(MIXES)}::DOUBLE[]) AS m)",
)
def tune_model(spark, d):
    train, _, weights = _training(spark, d)
    rows = scoring.labelled_vectors(train, "embedding", "y", weights, "vec_id", folds=3)
    found = scoring.tune_risk_model(rows, GRID, MIXES, folds=3)
    return found.select(
        "reg_param", "elastic_net", F.lit(3).alias("n_folds"),
        F.col("auroc").between(0.0, 1.0).alias("auroc_in_range"),
    )


N_DRAWN, RUNGS = 16, 3
SPACE = {
    "scale": search.LogUniform(0.05, 5.0), "shift": search.Uniform(-2.0, 1.0),
    "floor": search.Choice((0.0, 0.01, 0.1)),
}


def _log_loss(s: dict):
    """Cross entropy of the rescaled score, kept ``floor`` away from 0 and 1."""
    p = 1 / (1 + F.exp(-(s["scale"] * F.log(F.col("q") / (1 - F.col("q"))) + s["shift"])))
    held = F.greatest(F.least(p, F.lit(1 - s["floor"])), F.lit(s["floor"]))
    return -F.when(F.col("y") == 1, F.log(held)).otherwise(F.log(1 - held))


def _drawn_sql(name: str) -> str:
    return _hash_sql("candidate", f"'{name}'")


def _rung_sql(rung: int) -> str:
    share = 1 / 2 ** (RUNGS - 1 - rung)
    before = "drawn" if rung == 0 else f"left{rung - 1}"
    kept = -(-N_DRAWN // 2 ** (rung + 1))
    return (
        f"rung{rung} AS (SELECT candidate, any_value(scale) AS scale, any_value(shift) AS shift, "
        f"any_value(floor) AS floor, {rung}::INT AS rung, avg(-CASE WHEN y = 1 THEN ln(h) ELSE ln(1 - h) END) "
        "AS loss FROM (SELECT d.*, y, greatest(least(1 / (1 + exp(-(scale * ln(q / (1 - q)) + shift))), "
        f"1 - floor), floor) AS h FROM scores CROSS JOIN {before} d WHERE {_hash_sql('id', 'q')} < {share}) "
        "GROUP BY candidate), "
        f"left{rung} AS (SELECT candidate, scale, shift, floor FROM rung{rung} ORDER BY loss, candidate LIMIT {kept})"
    )


@query(
    "tune_ranges",
    "WITH " + i.SCORES_SQL + ", n AS (SELECT unnest(range(" + str(N_DRAWN) + ")) AS candidate), "
    f"drawn AS (SELECT candidate, exp(ln(0.05) + {_drawn_sql('scale')} * (ln(5.0) - ln(0.05))) AS scale, "
    f"-2.0 + {_drawn_sql('shift')} * 3.0 AS shift, "
    f"([0.0, 0.01, 0.1]::DOUBLE[])[floor({_drawn_sql('floor')} * 3)::INT + 1] AS floor FROM n), "
    + ", ".join(_rung_sql(k) for k in range(RUNGS))
    + ", every AS ("
    + " UNION ALL ".join(f"SELECT * FROM rung{k}" for k in range(RUNGS))
    + ") SELECT candidate, round(scale, 8) AS scale, round(shift, 8) AS shift, floor, rung, "
    "round(loss, 8) AS loss FROM every QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY rung DESC) = 1",
)
def tune_ranges(spark, d):
    """Scale, shift and floor of a score drawn from ranges, halved on growing shares of the rows."""
    found = search.successive_halving(
        i.scores(spark, d), SPACE, _log_loss, ["id", "q"], N_DRAWN, rungs=RUNGS
    )
    return i.finished(found, 8)


BLOCK_ROWS, N_REPEATS = 128, 10
_MIXED = f"((id % {a.MODULUS} * 48271 + (feature * 1009 + repeat)::BIGINT * 69621 + 42) % {a.MODULUS})"


@query(
    "permutation_importance",
    f"WITH {CELLS_SQL}, u AS (SELECT vec_id AS id, (label < 5) AS y, row_number() OVER (ORDER BY "
    f"{_hash_sql('vec_id')}, vec_id) AS num FROM embeddings), "
    f"b AS (SELECT id, y, (num - 1) // {BLOCK_ROWS} AS block, row_number() OVER (PARTITION BY "
    f"(num - 1) // {BLOCK_ROWS} ORDER BY num) AS pos FROM u), "
    "each AS (SELECT unnest(range(64))::INT AS feature), "
    f"again AS (SELECT unnest(range({N_REPEATS}))::INT AS repeat), "
    "ranked AS (SELECT id, block, feature, repeat, row_number() OVER (PARTITION BY block, feature, "
    f"repeat ORDER BY {_MIXED} * {_MIXED} % {a.MODULUS}, id) AS pos "
    "FROM b CROSS JOIN each CROSS JOIN again), "
    "moved AS (SELECT b.id, b.y, r.feature, r.repeat, o.x AS old, g.x AS given, w, z FROM b "
    "JOIN ranked r ON r.block = b.block AND r.pos = b.pos "
    "JOIN x o ON o.instance = b.id AND o.feature = r.feature "
    "JOIN x g ON g.instance = r.id AND g.feature = r.feature "
    "JOIN w ON w.feature = r.feature JOIN z ON z.instance = b.id), "
    "drops AS (SELECT feature, repeat, (count(*) FILTER (WHERE (z > 0) = y) "
    "- count(*) FILTER (WHERE (z + w * (given - old) > 0) = y)) / count(*)::DOUBLE AS d "
    "FROM moved GROUP BY 1, 2) "
    "SELECT feature, round(avg(d), 8) + 0.0 AS importance, round(stddev_pop(d), 8) + 0.0 "
    "AS importance_std FROM drops GROUP BY feature",
)
def permutation_importance(spark, d):
    rows = vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    found = a.permutation_importance(
        rows, "vec_id", "embedding", "y", make_linear(), i.WIDTH, n_repeats=N_REPEATS,
        block_rows=BLOCK_ROWS,
    )
    return i.finished(found, 8)
