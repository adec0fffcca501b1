"""Reverse mode against finite differences and against the expressions; clipping, replay and caps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions import models
from sigmaloom.operators import networks, privacy
from sigmaloom.operators.linear import Optimiser

GRAPH = [
    {"name": "a", "op": "linear", "from": ["x"], "width": 6},
    {"name": "b", "op": "gelu", "from": ["a"]},
    {"name": "c", "op": "linear", "from": ["x"], "width": 6},
    {"name": "d", "op": "silu", "from": ["c"]},
    {"name": "e", "op": "mul", "from": ["b", "d", "c"]},
    {"name": "f", "op": "layernorm", "from": ["e"]},
    {"name": "g", "op": "matmul", "from": ["f", "d"], "n": 2, "k": 3, "m": 2},
    {"name": "h", "op": "transpose", "from": ["g"], "shape": [2, 2]},
    {"name": "i", "op": "concat", "from": ["h", "a"]},
    {"name": "j", "op": "elu", "from": ["i"]},
    {"name": "k", "op": "affine", "from": ["j"], "scale": 0.5, "shift": 0.1},
    {"name": "l", "op": "softmax", "from": ["k"]},
    {"name": "m", "op": "sub", "from": ["k", "l"]},
    {"name": "n", "op": "affine", "from": ["l"], "shift": 1.0},
    {"name": "o", "op": "div", "from": ["m", "n"]},
    {"name": "p", "op": "leaky_relu", "from": ["o"], "negative_slope": 0.2},
    {"name": "q", "op": "add", "from": ["p", "o", "k"]},
    {"name": "r", "op": "reshape", "from": ["q"], "shape": [2, 5]},
    {"name": "out", "op": "linear", "from": ["r"], "width": "out"},
]
LAYERS = [{"op": "linear", "width": 5}, {"op": "tanh"}, {"op": "dropout"}, {"op": "linear", "width": 4}, {"op": "sigmoid"}, {"op": "linear", "width": 4}, {"op": "relu"}, {"op": "flatten"}, {"op": "linear", "width": "out"}]
LOSSES = {"bce_logits": 2, "mse": 2, "huber": 2, "quantile": 2, "poisson_nll": 2, "gamma_nll": 2, "cross_entropy": 3, "ordinal": 4, "multilabel_bce": 3}


def targets(rng, loss, classes, n):
    if loss == "multilabel_bce":
        return rng.integers(0, 2, (n, classes)).astype(float)
    return rng.integers(0, classes, n).astype(float) + (0.3 if loss in ("mse", "huber", "quantile", "gamma_nll") else 0)


@pytest.mark.parametrize("loss", sorted(LOSSES))
@pytest.mark.parametrize("spec", [GRAPH, LAYERS])
def test_gradients_equal_finite_differences(loss, spec):
    rng, classes = np.random.default_rng(1), LOSSES[loss]
    net = networks.Network(spec, 3, loss, classes)
    w, x, y = net.start + rng.normal(size=net.size) * 0.1, rng.normal(size=(4, 3)), targets(rng, loss, classes, 4)

    def total(at, rows):
        return networks.loss_and_slope(loss, net.forward(at, x[rows])[0][net.nodes[-1].name], y[rows], classes)[0].sum()

    every, value = net.gradients(w, x, y, math.inf)
    assert value == pytest.approx(total(w, slice(None)))
    for k in rng.choice(net.size, 40, replace=False):
        step = np.zeros(net.size)
        step[k] = 1e-5
        assert every[k] == pytest.approx((total(w + step, slice(None)) - total(w - step, slice(None))) / 2e-5, abs=2e-5, rel=2e-4)
    each = [net.gradients(w, x[i : i + 1], y[i : i + 1], math.inf)[0] for i in range(4)]
    clip = float(np.median([np.linalg.norm(g) for g in each]))
    want = sum(g * min(1.0, clip / np.linalg.norm(g)) for g in each)
    np.testing.assert_allclose(net.gradients(w, x, y, clip)[0], want, rtol=1e-9, atol=1e-12)


def test_sums_on_the_grid_are_exact_and_no_longer():
    rng = np.random.default_rng(6)
    net = networks.Network([{"op": "linear", "width": 7}, {"op": "tanh"}, {"op": "linear", "width": "out"}], 3, "bce_logits")
    x, y = rng.normal(size=(networks.ROWS, 3)), rng.integers(0, 2, networks.ROWS).astype(float)
    whole, _ = net.gradients(net.start, x, y, 0.5, grid=True)
    order = rng.permutation(len(x))
    parts = [net.gradients(net.start, x[p], y[p], 0.5, grid=True)[0] for p in np.split(order, [1, 70, 1000, 1001])]
    assert (sum(parts) == whole).all() and (whole * networks._FIX == np.rint(whole * networks._FIX)).all()
    np.testing.assert_allclose(whole, net.gradients(net.start, x, y, 0.5)[0], atol=len(x) * 2.0**-15)
    assert all(np.linalg.norm(net.gradients(net.start, x[i : i + 1], y[i : i + 1], 0.01, grid=True)[0]) <= 0.01 + 1e-12 for i in range(200))


SHORT = [{"name": "a", "op": "linear", "from": ["x"], "width": 4}, {"name": "b", "op": "gelu", "from": ["a"]}, {"name": "c", "op": "mul", "from": ["b", "a"]}, {"name": "d", "op": "softmax", "from": ["c"]}, {"name": "e", "op": "linear", "from": ["d"], "width": "out"}]


@pytest.mark.parametrize("spec", [SHORT, LAYERS])
def test_forward_equals_the_expressions(spark, spec):
    rng = np.random.default_rng(2)
    net = networks.Network(spec, 3, "mse")
    x = rng.normal(size=(20, 3)) * 2
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    got = [r["z"][0] for r in df.select(models.build_graph(net.trained(net.start), {"x": F.col("x")}).alias("z")).collect()]
    np.testing.assert_allclose(got, net.forward(net.start, x)[0][net.nodes[-1].name][:, 0], rtol=1e-6, atol=1e-7)


def test_predictions_of_a_graph(spark):
    """Batch by batch, in any partitioning, with missing features as 0; keeps columns whatever they are called."""
    rng = np.random.default_rng(4)
    net = networks.Network(GRAPH, 3, "cross_entropy", 3)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, *map(float, r), "k") for i, r in enumerate(x)] + [(50, None, math.nan, 1.0, "k")], "i int, a double, b double, c double, x string").repartition(4)
    got = {r["i"]: (r["x"], r["prediction"]) for r in networks.predict(df, net, net.start, ["a", "b", "c"], ["i", "x"]).collect()}
    want = net.forward(net.start, np.vstack([x, [0, 0, 1]]))[0]["out"]
    assert len(got) == 51 and all(got[i][0] == "k" for i in got)
    np.testing.assert_allclose([got[i][1] for i in range(51)], want, rtol=1e-12)


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (1200, 2))
    return spark.createDataFrame([(str(i), *map(float, r), float(r[0] * r[1] > 0)) for i, r in enumerate(x)], "unit string, a double, b double, y double").repartition(3).cache()


def test_two_layers_learn_what_one_cannot(rings):
    net = networks.Network([{"op": "linear", "width": 8}, {"op": "tanh"}, {"op": "linear", "width": "out"}], 2, "bce_logits")
    out = networks.fit(rings, net, ["a", "b"], "y", b"k", b"", 1200, steps=40, clip=5.0, rate=0.2, optimiser=Optimiser("adam"), sample=False)
    z = models.build_graph(out["nodes"], {"x": F.array("a", "b")})
    assert rings.select(F.avg(((F.get(z, F.lit(0)) > 0) == (F.col("y") > 0)).cast("double"))).first()[0] > 0.9 and "release" not in out


def test_private_training_replays(rings):
    net = networks.Network([{"op": "linear", "width": 4}, {"op": "tanh"}, {"op": "linear", "width": "out"}], 2, "bce_logits")
    fit = lambda secret, df=rings: networks.fit(df, net, ["a", "b"], "y", b"k", secret, 1200, steps=3, epsilon=3.0, delta=1e-5)
    one = fit(b"a")
    assert one["parameters"] == fit(b"a", rings.orderBy("a").coalesce(1))["parameters"] != fit(b"b")["parameters"]
    assert one["release"]["noise"] == privacy.sgd_noise(3.0, 1e-5, 1 / 3, 3)
    assert all(map(math.isfinite, fit(b"a", rings.limit(0))["parameters"]))  # an empty side sends noise
    for bad in ({"secret": b""}, {"epsilon": 99.0}, {"delta": None}):
        with pytest.raises(ValueError):
            networks.fit(rings, net, ["a", "b"], "y", b"k", bad.get("secret", b"a"), 1200, epsilon=bad.get("epsilon", 1.0), delta=bad.get("delta", 1e-5))


def test_wild_rows_have_no_gradient_or_a_clipped_one(spark):
    net = networks.Network([{"op": "linear", "width": 3}, {"op": "relu"}, {"op": "linear", "width": "out"}], 2, "mse")
    rows = spark.createDataFrame([([1.0, 2.0], 1.0), ([1e300, math.inf], -1e308), ([math.nan, None], None), (None, 1.0), ([1.0], 1.0), ([], 0.0)], "x array<double>, y double")
    total, n, loss = networks.gradient_sum(rows, net, net.start, F.col("x"), F.col("y"), 1.0)
    assert n == 6 and np.isfinite(total).all() and np.linalg.norm(total) <= 3 + 1e-6 and math.isfinite(loss)
    assert networks.gradient_sum(rows.limit(0), net, net.start, F.col("x"), F.col("y"), 1.0)[1] == 0


def test_caps(spark):
    deep = [{"op": "relu"}] * 65
    for bad, width in ((deep, 2), ([{"op": "linear", "width": 9000}, {"op": "linear", "width": "out"}], 2), ([{"op": "linear", "width": 8000}, {"op": "linear", "width": 8000}, {"op": "linear", "width": "out"}], 2), ([{"op": "relu"}], 2), ([], 1), ([{"op": "linear", "width": "out"}], 9000), ([{"name": "a", "op": "add", "from": ["x"] * 65}], 1), ([{"name": "a", "op": "add", "from": ["x", "later"]}], 1)):
        with pytest.raises(ValueError):
            networks.Network(bad, width, "mse")
    x = F.array(F.lit(1.0))
    for bad in (deep, [{"op": "affine", "scale": 1e9}], [{"op": "linear", "weights": [[1.0]] * 8193}]):
        with pytest.raises(ValueError):
            models.build(bad, x)
    with pytest.raises(ValueError):
        models.build_graph([{"name": "m", "op": "matmul", "from": ["x", "x"], "n": 64, "k": 64, "m": 64}], {"x": x})
    assert models.output_width([{"op": "linear", "weights": [[0.0]] * 8192}], 1) == 8192
    assert [models.loss_width(*a) for a in (("cross_entropy", 3), ("ordinal", 4), ("mse", 9), ("multilabel_bce", 5))] == [3, 3, 1, 5]
