"""Registered queries of layers, losses, metrics, optimisers, budgets and keyed samples, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow, clean, keyed, models
from ..operators import blocks, linear, metrics, networks, pooling, privacy, statistics
from .queries import _B, _SCHEMA, TEST_KEY, _dirty, _hmac_sql, _query, _t, _tree_rows

# --- layers and losses -----------------------------------------------------------------------------------------------------

_X = "x AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, list_reverse(embedding::DOUBLE[]) AS r FROM embeddings)"
_EACH = {
    "tanh": "tanh(a)",
    "elu": "CASE WHEN a > 0 THEN a ELSE exp(a) - 1 END",
    "silu": "a / (1 + exp(-a))",
    "leaky_relu": "CASE WHEN a > 0 THEN a ELSE 0.2 * a END",
    "dropout": "a",
    "affine": "2 * a - 1",
}
_BOTH = {"add": "x[k] + r[k]", "sub": "x[k] - r[k]", "mul": "x[k] * r[k]", "div": "x[k] / CASE WHEN abs(r[k]) >= 1e-6 THEN r[k] WHEN r[k] < 0 THEN -1e-6 ELSE 1e-6 END"}
_R = "round({}, 7) + 0.0"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("x"), F.reverse(x).alias("r"))


def _rounded(c: Column, digits: int = 7) -> Column:
    return F.transform(c, lambda v: F.round(v, digits))


@_query(
    f"""WITH {_X}, s AS (SELECT *, list_sum(x) / 64 AS mean, list_transform(x, lambda a: exp(a - list_max(x))) AS e FROM x), v AS (SELECT *, list_sum(list_transform(x, lambda a: (a - mean) * (a - mean))) / 64 AS var, list_sum(e) AS whole FROM s)
    SELECT vec_id, {', '.join(f"list_transform(x, lambda a: {_R.format(sql)}) AS {name}" for name, sql in _EACH.items())}, list_transform(x, lambda a: {_R.format('(a - mean) / sqrt(var + 1e-5)')}) AS layernorm, list_transform(e, lambda a: {_R.format('a / whole')}) AS softmax FROM v"""
)
def network_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of one input on whole vectors."""
    more = {"leaky_relu": {"negative_slope": 0.2}, "affine": {"scale": 2.0, "shift": -1.0}}
    layer = lambda name: models.build([{"op": name, **more.get(name, {})}], F.col("x"))
    return _vectors(spark, sf_dir).select("vec_id", *[_rounded(layer(name)).alias(name) for name in (*_EACH, "layernorm", "softmax")])


@_query(
    f"""WITH {_X} SELECT vec_id, {', '.join(f"list_transform(range(1, 65), lambda k: {_R.format(f'least(greatest({sql}, -1e6), 1e6)')}) AS {name}" for name, sql in _BOTH.items())},
    list_transform(list_concat(x, r), lambda a: {_R.format('a')}) AS joined, list_transform(range(64), lambda c: {_R.format('x[(c % 8) * 8 + c // 8 + 1]')}) AS turned,
    list_transform(range(16), lambda c: {_R.format('list_sum(list_transform(range(16), lambda k: x[(c // 4) * 16 + k + 1] * r[k * 4 + c % 4 + 1]))')}) AS product FROM x"""
)
def network_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a model graph on two vectors."""
    inputs = {"x": F.col("x"), "r": F.col("r")}
    node = lambda op, takes, **more: models.build_graph([{"name": "out", "op": op, "from": takes, **more}], inputs)
    columns = {name: node(name, ["x", "r"]) for name in _BOTH} | {"joined": node("concat", ["x", "r"]), "turned": node("transpose", ["x"], shape=[8, 8]), "product": node("matmul", ["x", "r"], n=4, k=16, m=4)}
    return _vectors(spark, sf_dir).select("vec_id", *[_rounded(c).alias(name) for name, c in columns.items()])


@_query(
    f"""WITH {_X}, z AS (SELECT *, x[1:9] AS o, list_max(x) AS top FROM x) SELECT vec_id, round(top + ln(list_sum(list_transform(x, lambda a: exp(a - top)))) - x[label + 1], 7) AS cross_entropy,
    round((list_sum(list_transform(x, lambda a: greatest(0, 1 - x[label + 1] + a))) - 1) / 64, 7) AS multi_margin,
    round(list_sum(list_transform(range(1, 10), lambda k: ln(1 + exp(-abs(o[k]))) + greatest(o[k], 0) - CASE WHEN label > k - 1 THEN o[k] ELSE 0 END)) / 9, 7) AS ordinal,
    round(list_sum(list_transform(range(1, 65), lambda k: ln(1 + exp(-abs(x[k]))) + greatest(x[k], 0) - x[k] * ((k + vec_id) % 2))) / 64, 7) AS multilabel_bce FROM z"""
)
def class_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of many outputs: all 64 as classes or labels, the first nine for ten ordered classes."""
    x, y = F.col("x"), F.col("label")
    many, ordered = models.class_losses(x, y, 64), models.class_losses(F.slice(x, 1, 9), y, 10)
    truth = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: ((k + F.col("vec_id")) % 2).cast("double"))
    columns = {"cross_entropy": many["cross_entropy"], "multi_margin": many["multi_margin"], "ordinal": ordered["ordinal"], "multilabel_bce": models.multilabel_bce(x, truth)}
    return _vectors(spark, sf_dir).select("vec_id", *[F.round(c, 7).alias(k) for k, c in columns.items()])


@_query(
    """WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10 AS z, l_linenumber::DOUBLE AS y FROM lineitem), b AS (SELECT *, ln(exp(z) + 2.5) AS b FROM z)
    SELECT l_orderkey, l_linenumber, round(1.5 * (z + y * exp(-z)), 7) AS gamma, round(-(lgamma(y + 2.5) - lgamma(2.5) - lgamma(y + 1) + 2.5 * (ln(2.5) - b) + y * (z - b)), 7) AS negbin FROM b"""
)
def count_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, y = (F.col("l_quantity") - 25) / 10, F.col("l_linenumber").cast("double")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(models.losses(z, y, shape=1.5)["gamma_nll"], 7).alias("gamma"), F.round(arrow.negbin_nll(z, y, 2.5), 7).alias("negbin"))


# --- metrics ---------------------------------------------------------------------------------------------------------------

_SCORES = ", ".join(f"list_sum(list_transform(range({c + 1}, 65, 3), lambda k: embedding[k]::DOUBLE * embedding[k]::DOUBLE))" for c in range(3))
_CURVES = """c AS (SELECT t, bin, pos, neg, sum(pos) OVER w / sum(pos) OVER (PARTITION BY t) AS tpr, sum(neg) OVER w / sum(neg) OVER (PARTITION BY t) AS fpr FROM h WINDOW w AS (PARTITION BY t ORDER BY bin DESC)),
    s AS (SELECT t, (fpr - lag(fpr, 1, 0) OVER v) * (tpr + lag(tpr, 1, 0) OVER v) / 2 AS area FROM c WINDOW v AS (PARTITION BY t ORDER BY bin DESC)), auc AS (SELECT t, sum(area) AS auc FROM s GROUP BY t)"""


@_query(
    f"""WITH e AS (SELECT label % 3 AS y, [{_SCORES}] AS q FROM embeddings), p AS (SELECT y, list_transform(q, lambda v: least(v, 1) / list_sum(list_transform(q, lambda w: least(w, 1)))) AS p FROM e),
    g AS (SELECT y, list_position(p, list_max(p)) - 1 AS k, p FROM p), n AS (SELECT count(*)::DOUBLE AS n, sum((y = k)::INT)::DOUBLE AS hit, sum(abs(y - k))::DOUBLE AS away FROM g),
    b AS (SELECT t, count(*) FILTER (y = t AND k = t)::DOUBLE AS tp, count(*) FILTER (y = t)::DOUBLE AS truth, count(*) FILTER (k = t)::DOUBLE AS said FROM g CROSS JOIN (SELECT unnest(range(3)) AS t) GROUP BY t),
    m AS (SELECT CASE WHEN truth > 0 THEN tp / truth ELSE 0 END AS r, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS q FROM b),
    x AS (SELECT t, least(floor(p[t + 1] * 4), 3) AS bin, count(*) FILTER (y = t)::DOUBLE AS pos, count(*) FILTER (y <> t)::DOUBLE AS neg FROM g CROSS JOIN (SELECT unnest(range(3)) AS t) GROUP BY ALL), h AS (SELECT * FROM x), {_CURVES}
    SELECT n, round(hit / n, 7) AS accuracy, round((SELECT avg(r) FROM m), 7) AS balanced_accuracy, round((SELECT avg(q) FROM m), 7) AS macro_precision, round((SELECT avg(CASE WHEN r + q > 0 THEN 2 * r * q / (r + q) ELSE 0 END) FROM m), 7) AS macro_f1,
    round((SELECT avg(auc) FROM auc), 7) AS macro_roc_auc, round(away / n, 7) AS ordinal_mae FROM n"""
)
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of three ordered classes; the scores are the energies of every third coordinate of a vector."""
    energy = lambda c: F.aggregate(F.filter("x", lambda v, k: k % 3 == c), F.lit(0.0), lambda a, v: a + v * v)
    rows = _vectors(spark, sf_dir).select((F.col("label") % 3).alias("y"), F.array(*[energy(c) for c in range(3)]).alias("p"))
    vector = [r["value"] for r in statistics.multiclass(rows, [], F.col("y"), F.col("p"), 3, 4).orderBy("coord").collect()]
    m = metrics.guarded(metrics.multiclass(vector, 3, 4, ordinal=True))
    names = ("n", "accuracy", "balanced_accuracy", "macro_precision", "macro_f1", "macro_roc_auc", "ordinal_mae")
    return spark.createDataFrame([tuple(round(m[k], 7) for k in names)], ", ".join(f"{k} double" for k in names))


@_query(
    f"""WITH l AS (SELECT unnest([0, 1]) AS t, unnest([quality, toxic]) AS y, unnest([(doc_id % 17) / 16.0, (doc_id % 5) / 4.0])::DOUBLE AS p FROM labels),
    h AS (SELECT t, least(floor(p * 8), 7) AS bin, count(*) FILTER (y = 1)::DOUBLE AS pos, count(*) FILTER (y = 0)::DOUBLE AS neg FROM l GROUP BY ALL), {_CURVES},
    f AS (SELECT t, sum(pos) FILTER (bin >= 4) AS tp, sum(neg) FILTER (bin >= 4) AS fp, sum(pos) FILTER (bin < 4) AS fn FROM h GROUP BY t)
    SELECT round((SELECT avg(auc) FROM auc), 7) AS macro_roc_auc, round(avg(2 * tp / (2 * tp + fp + fn)), 7) AS macro_f1 FROM f"""
)
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two labels of each document."""
    d = F.col("doc_id")
    rows = _t(spark, sf_dir, "labels").select(F.array("quality", "toxic").alias("y"), F.array((d % 17) / 16.0, (d % 5) / 4.0).alias("p"))
    m = metrics.multilabel([r["value"] for r in statistics.multilabel(rows, [], F.col("y"), F.col("p"), 2, 8).orderBy("coord").collect()], 2, 8)
    return spark.createDataFrame([(round(m["macro_roc_auc"], 7), round(m["macro_f1"], 7))], "macro_roc_auc double, macro_f1 double")


@_query(
    """WITH r AS (SELECT l_linenumber::DOUBLE AS y, least(greatest(l_quantity / 7, 1e-8), 7) AS p FROM lineitem), d AS (SELECT *, greatest(0, 2 * (y * ln(y / p) - (y - p))) AS v FROM r)
    SELECT count(*)::DOUBLE AS n, round(avg(abs(y - p)), 6) AS mae, round(avg(least(v / greatest(14, 2 * (7 * ln(7 / 1e-8) - 7)), 1)), 6) AS deviance FROM d"""
)
def count_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = statistics.regression_sums(_t(spark, sf_dir, "lineitem"), [], F.col("l_linenumber"), F.col("l_quantity") / 7, 0, 7, count_task=True).orderBy("coord").collect()
    m = metrics.regression([r["value"] for r in sums], 0, 7)
    return spark.createDataFrame([tuple(round(float(m[k]), 6) for k in ("n", "mae", "mean_poisson_deviance_normalized"))], "n double, mae double, deviance double")


# --- keyed samples, levels and blocks -------------------------------------------------------------------------------------------


_RECORD = "(b0 || ',' || b1 || ',' || b2 || ',' || y)"


@_query(f"WITH r AS (SELECT l_orderkey, l_linenumber, {_B} FROM lineitem) SELECT l_orderkey, l_linenumber, (('0x' || substr({_hmac_sql('record', _RECORD, 'tree/v1')}, 1, 15))::BIGINT % 8)::INT AS tree FROM r")
def record_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree that each record trains."""
    rows = _tree_rows(spark, sf_dir)
    b = [clean.bin_of(F.col(f), c) for f, c in zip(_SCHEMA.features, _SCHEMA.cuts, strict=True)]
    return rows.select("l_orderkey", "l_linenumber", keyed.tree_of(TEST_KEY, b, F.col("y"), 8).alias("tree"))


@_query(f"SELECT o_orderkey, {', '.join(f'''{_hmac_sql('step', f"'{t}:' || o_custkey", 'poisson/v1')} < '{keyed.threshold_hex(1, 10)}' AS step_{t}''' for t in (0, 7))} FROM orders")
def sampled_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a subject is in two of ten steps."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[keyed.in_step(TEST_KEY, clean.unit_id(F.col("o_custkey")), F.lit(t), 10).alias(f"step_{t}") for t in (0, 7)])


@_query(
    f"""WITH r AS (SELECT {_B}, (b1 > 1)::INT AS slot FROM lineitem), f AS ({' UNION ALL '.join(f'SELECT slot, {k} AS feature, b{k} AS bin, y FROM r' for k in range(3))})
    SELECT slot::INT AS slot, feature::INT AS feature, bin::INT AS bin, sum(CASE WHEN y = 1 THEN -524288 ELSE 524288 END)::BIGINT AS g, (count(*) * 262144)::BIGINT AS h, count(*) AS n FROM f GROUP BY ALL"""
)
def sufficient_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of a level of two nodes, which a split of the second feature made."""
    rows = statistics.binned(_tree_rows(spark, sf_dir), dict(zip(_SCHEMA.features, _SCHEMA.cuts, strict=True)))
    g, h = statistics.gradient_columns(F.lit(0.0), F.col("y"), "binary", 1.0, 1.0)
    return statistics.gradient_histogram(rows, (F.col("b_l_discount") > 1).cast("int"), {k: F.col(f"b_{f}") for k, f in enumerate(_SCHEMA.features)}, _SCHEMA.bins - 1, g, h)


def _means(x: np.ndarray, y: np.ndarray, config: dict) -> np.ndarray:
    return np.array([x.mean(), y.mean()]) * config["scale"]


class _Means:
    """The means of x and y, doubled, as a fold: counts and sums."""

    def init(self) -> np.ndarray:
        return np.zeros(3)

    def update(self, state: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return state + [len(x), x.sum(), y.sum()]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> np.ndarray:
        return 2 * state[1:] / state[0]


_BLOCK_MEANS = (
    f"""WITH u AS (SELECT o_totalprice / 100000 AS x, (o_orderstatus = 'F')::INT AS y, ('0x' || substr({_hmac_sql('subject', 'o_custkey::VARCHAR', 'block/v1')}, 1, 15))::BIGINT % 8 AS block FROM orders),
    b AS (SELECT block, 2 * avg(x) AS a, 2 * avg(y) AS c FROM u GROUP BY block), s AS (SELECT least(1, 1 / sqrt(a * a + c * c)) AS s, a, c FROM b)
    SELECT unnest([0, 1])::INT AS coord, unnest([round(sum(a * s) / 8, 7), round(sum(c * s) / 8, 7)])::DOUBLE AS value FROM s"""
)


@_query(_BLOCK_MEANS)
def folded_block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a user's fold, whose states are merged: no task holds a block's rows."""
    o = _t(spark, sf_dir, "orders").select(clean.unit_id(F.col("o_custkey")).alias("unit"), (F.col("o_totalprice") / 100_000).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    mean = np.mean([privacy.clipped(u, 1.0) for u in blocks.folded_updates(o, ["x"], _Means(), TEST_KEY, 8, 2)], axis=0)
    return spark.createDataFrame([(k, round(float(v), 7)) for k, v in enumerate(mean)], "coord int, value double")


@_query(_BLOCK_MEANS)
def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a user's function over eight blocks of subjects, each block's result clipped; before noise."""
    o = _t(spark, sf_dir, "orders").select(clean.unit_id(F.col("o_custkey")).alias("unit"), (F.col("o_totalprice") / 100_000).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    updates = blocks.block_updates(o, ["x"], _means, {"scale": 2.0}, TEST_KEY, 8, 2)
    mean = np.mean([privacy.clipped(u, 1.0) for u in updates], axis=0)
    return spark.createDataFrame([(k, round(float(v), 7)) for k, v in enumerate(mean)], "coord int, value double")


# --- federated models, optimisers, budgets -------------------------------------------------------------------------------------

_SITES = "s AS (SELECT n_regionkey AS site, avg(c_acctbal) / 1000 AS a, avg((c_mktsegment = 'BUILDING')::INT) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), m AS (SELECT avg(a) AS a, avg(b) AS b FROM s)"


@_query(
    f"""WITH {_SITES}, d AS (SELECT 0 AS coord, a AS d FROM m UNION ALL SELECT 1, b FROM m), v AS (SELECT *, 0.99 * 1e-6 + 0.01 * d * d AS v FROM d)
    SELECT coord::INT AS coord, round(d, 7) AS fedavg, round(0.5 * d, 7) AS fedavgm, round(0.1 * 0.1 * d / (sqrt(v) + 1e-3), 7) AS fedadam, round(0.1 * d / (sqrt(1e-6 + d * d) + 1e-3), 7) AS fedadagrad, round(0.1 * 0.1 * d / (sqrt(1e-6 - 0.01 * d * d * sign(1e-6 - d * d)) + 1e-3), 7) AS fedyogi FROM v"""
)
def federated_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One server step of each strategy from zero; a site for each region sends two means."""
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nations are a fixed short list
    sites = joined.groupBy("n_regionkey").agg((F.avg("c_acctbal") / 1000).alias("a"), F.avg((F.col("c_mktsegment") == "BUILDING").cast("int")).alias("b")).orderBy("n_regionkey").collect()
    updates = [[np.array([r["a"], r["b"]])] for r in sites]
    after = {k: pooling.FederatedMean(k, momentum=0.9, server_rate=0.5).step([np.zeros(2)], updates, len(updates))[0] for k in ("fedavg", "fedavgm", "fedadam", "fedadagrad", "fedyogi")}
    return spark.createDataFrame([(k, *[round(float(v[k]), 7) for v in after.values()]) for k in range(2)], "coord int, " + ", ".join(f"{k} double" for k in after))


@_query(
    f"""WITH {_SITES}, g AS (SELECT site, a - 4 AS g FROM s), r AS (SELECT *, 0.1 * 0.5 * (1 + cos(pi() * 3 / 10)) AS rate FROM g),
    w AS (SELECT site, unnest(['sgd', 'adam', 'adamw', 'rmsprop']) AS kind, rate, unnest([1 + g, (1 + g) / (abs(1 + g) + 1e-8), g / (abs(g) + 1e-8) + 1, (1 + g) / (sqrt(0.01 * (1 + g) ** 2) + 1e-8)]) AS move FROM r)
    SELECT site::INT AS site, kind, round(sign(1 - rate * move) * greatest(abs(1 - rate * move) - 0.01 * rate, 0), 7)::DOUBLE AS weight FROM w"""
)
def optimiser_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of each optimiser from a weight of 1, at the fourth of ten epochs of a cosine schedule, with both penalties."""
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    means = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).groupBy("n_regionkey").agg((F.avg("c_acctbal") / 1000).alias("a")).collect()
    rate, rows = linear.learning_rate(0.1, 3, 10, "cosine"), []
    for r in means:
        for kind in ("sgd", "adam", "adamw", "rmsprop"):
            w = linear.Optimiser(kind, l2=1.0, l1=0.01).step(np.ones(1), np.array([r["a"] - 4]), rate)
            rows.append((int(r["n_regionkey"]), kind, round(float(w[0]), 7)))
    return spark.createDataFrame(rows, "site int, kind string, weight double")


@_query(
    """WITH b AS (SELECT r_regionkey::INT AS region, 1 + 0.5 * r_regionkey::DOUBLE AS eps, 1e-6::DOUBLE AS delta, r_regionkey + 2 AS k FROM region)
    SELECT region, round((eps / (sqrt(-ln(delta) + eps) + sqrt(-ln(delta)))) ** 2, 8) AS rho, round(eps / 2, 8) AS half, round(1e6 * delta / (1 + exp(eps / 2)), 8) AS half_delta, round(0.8 * eps, 8) AS train, round(0.2 * eps, 8) AS test,
    round(0.8 * eps / k, 8) AS fold, round(greatest(sqrt(2.0 * (k + 1)), sqrt(k + 1.0)), 8) AS multiclass, round(greatest(2.0, sqrt(k * 3.0)), 8) AS regression, round(sqrt(k * greatest(2 * (1 + 4 + 1.0), 4 * 1 + 4.0)), 8) AS boosting FROM b"""
)
def privacy_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and conversions of a budget of each region, and sensitivities."""
    rows = []
    for r in _t(spark, sf_dir, "region").select("r_regionkey").collect():
        eps, delta, k = 1 + 0.5 * r["r_regionkey"], 1e-6, r["r_regionkey"] + 2
        half, sides = privacy.replace_one_budget(eps, delta), privacy.holdout_budget(eps, delta)
        values = (privacy.zcdp_rho(eps, delta), half[0], 1e6 * half[1], sides["train"][0], sides["test"][0], privacy.fold_budget(eps, delta, k)["fold"][0])
        sizes = (privacy.sensitivity_with_absence("multiclass", 1, classes=k), privacy.sensitivity_with_absence("regression", k * 3), privacy.boosting_sensitivity(k, 1.0, 2.0))
        rows.append((int(r["r_regionkey"]), *[round(float(v), 8) for v in (*values, *sizes)]))
    return spark.createDataFrame(rows, "region int, rho double, half double, half_delta double, train double, test double, fold double, multiclass double, regression double, boosting double")


@_query(
    """WITH x AS (SELECT c_nationkey AS nation, avg(c_acctbal) - 4500 AS x FROM customer GROUP BY 1), d AS (SELECT x, (sum(x) OVER w - 1000) / row_number() OVER w AS over FROM x WINDOW w AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT arg_min(over, x) FILTER (x > over) AS over FROM d) SELECT nation::INT AS nation, round(greatest(x - over, 0), 6) AS projected FROM x CROSS JOIN t"""
)
def projected_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' mean balances, less a constant, on the nearest vector of no negative value and a given sum."""
    rows = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") - 4500).alias("x")).orderBy("c_nationkey").collect()
    projected = privacy.project_to_simplex(np.array([r["x"] for r in rows]), 1000.0)
    return spark.createDataFrame([(int(r["c_nationkey"]), round(float(v), 6)) for r, v in zip(rows, projected, strict=True)], "nation int, projected double")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2) THEN l_linenumber ELSE 2 END::TINYINT AS again, l_linenumber >= 5 AS complete FROM lineitem")
def cleaned_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that were written and read, and the complete-case predicate, which no plan turns on."""
    n = F.col("l_linenumber")
    return _dirty(spark, sf_dir).select("l_orderkey", n, clean.association_again(n).alias("again"), clean.complete(F.col("d")).alias("complete"))


# --- training of networks --------------------------------------------------------------------------------------------------

_NET = networks.Network([{"op": "linear", "weights": [[1.5, -0.5], [-1.0, 2.0]], "bias": [-0.25, 0.125]}, {"op": "tanh"}, {"op": "linear", "weights": [[2.0, -1.0]], "bias": [0.25]}], 2, "bce_logits")
_GRADIENT = ("dh0 * x0", "dh0 * x1", "dh1 * x0", "dh1 * x1", "dh0", "dh1", "dz * h0", "dz * h1", "dz")


@_query(
    f"""WITH x AS (SELECT l_quantity::DOUBLE / 50 AS x0, l_discount::DOUBLE * 10 AS x1, (l_quantity * (1 - 4 * l_discount) > 20)::INT AS y FROM lineitem),
    h AS (SELECT *, tanh(1.5 * x0 - 0.5 * x1 - 0.25) AS h0, tanh(-x0 + 2 * x1 + 0.125) AS h1 FROM x), z AS (SELECT *, 1 / (1 + exp(-(2 * h0 - h1 + 0.25))) - y AS dz FROM h),
    d AS (SELECT *, 2 * dz * (1 - h0 * h0) AS dh0, -dz * (1 - h1 * h1) AS dh1 FROM z),
    c AS (SELECT *, least(1.0, 0.5 / sqrt(dh0 * dh0 * (x0 * x0 + x1 * x1 + 1) + dh1 * dh1 * (x0 * x0 + x1 * x1 + 1) + dz * dz * (h0 * h0 + h1 * h1 + 1))) AS s FROM d),
    q AS (SELECT {', '.join(f'trunc(s * {v} * 262144) / 262144 AS {v}' for v in ('dh0', 'dh1', 'dz'))}, {', '.join(f'trunc({v} * 65536) / 65536 AS {v}' for v in ('x0', 'x1', 'h0', 'h1'))} FROM c)
    {' UNION ALL '.join(f'SELECT {k}::INT AS coord, count(*) AS n, round(sum({v}), 3)::DOUBLE AS value FROM q' for k, v in enumerate(_GRADIENT))}"""
)
def network_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over all lines of the gradient of a two-layer network's loss, each line's clipped to length 0.5: parameters in their layout.
    Slopes and activations are cut to their grids, as training does."""
    rows = _tree_rows(spark, sf_dir).select(F.array((F.col("l_quantity") / 50).cast("double"), (F.col("l_discount") * 10).cast("double")).alias("x"), "y")
    total, n, _ = networks.gradient_sum(rows, _NET, _NET.start, F.col("x"), F.col("y"), 0.5)
    return spark.createDataFrame([(k, n, float(round(v, 3)) + 0.0) for k, v in enumerate(total)], "coord int, n long, value double")
