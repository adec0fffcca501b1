"""Layers, graphs and losses against NumPy; checks of labels and rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions import models
from sigmaloom.operators import units
from sigmaloom.sources import store


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def doubles(x):
    return F.array(*[F.lit(float(v)) for v in np.ravel(x)])


def test_gelu_and_slopes(spark):
    x = np.linspace(-5, 5, 41)
    got = value(spark, models.build([{"op": "gelu"}], doubles(x)))
    assert got == pytest.approx([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x], abs=1e-6)
    assert value(spark, models.build([{"op": "leaky_relu", "negative_slope": 0.2}], doubles([-1, 2]))) == [-0.2, 2.0]
    assert value(spark, models.build([{"op": "leaky_relu"}], doubles([-1, 2]))) == [-0.01, 2.0]
    assert value(spark, models.build([{"op": "affine", "scale": 2.0, "shift": 1.0}], doubles([-1, 2]))) == [-1.0, 5.0]
    e = np.exp([1.0, 2.0, 4.0])
    assert value(spark, models.build([{"op": "softmax"}], doubles([1, 2, 4]))) == pytest.approx((e / e.sum()).tolist())


def test_graphs(spark):
    a, b = np.arange(6.0).reshape(2, 3), np.arange(6.0).reshape(3, 2) - 2
    nodes = [
        {"name": "m", "op": "matmul", "from": ["a", "b"], "n": 2, "k": 3, "m": 2},
        {"name": "t", "op": "transpose", "from": ["m"], "shape": [2, 2]},
        {"name": "s", "op": "add", "from": ["m", "t"]},
        {"name": "c", "op": "concat", "from": ["s", "a"]},
        {"name": "r", "op": "relu", "from": ["c"]},
    ]
    m = a @ b
    want = np.maximum(np.concatenate([(m + m.T).ravel(), a.ravel()]), 0)
    assert value(spark, models.build_graph(nodes, {"a": doubles(a), "b": doubles(b)})) == pytest.approx(want.tolist())
    for bad in ([], [{"name": "x", "op": "relu", "from": ["later"]}], [{"name": "a", "op": "relu", "from": ["a"]}], [{"name": "x", "op": "relu", "from": ["a", "b"]}]):
        with pytest.raises(ValueError):
            models.build_graph(bad, {"a": doubles(a), "b": doubles(b)})


def test_widths():
    spec = [{"op": "linear", "weights": [[1, 2, 3]] * 4}, {"op": "gelu"}, {"op": "reshape", "shape": [2, 2]}, {"op": "transpose", "shape": [2, 2]}, {"op": "softmax"}]
    assert models.output_width(spec, 3) == 4
    for bad, width in ((spec, 2), ([{"op": "reshape", "shape": [3]}], 4), ([{"op": "nothing"}], 4), ([], models.MOST_WIDTH + 1), ([{"op": "relu"}] * 65, 2), ([{"op": "linear", "weights": [[1.0]], "bias": [1.0, 2.0]}], 1)):
        with pytest.raises(ValueError):
            models.output_width(bad, width)


def test_class_losses(spark):
    z, k = np.array([0.5, -1.0, 2.0]), 2
    got = models.class_losses(doubles(z), F.lit(k), 3)
    assert value(spark, got["cross_entropy"]) == pytest.approx(math.log(np.exp(z).sum()) - z[k])
    assert value(spark, got["multi_margin"]) == pytest.approx(sum(max(0, 1 - z[k] + z[j]) for j in range(3) if j != k) / 3)
    bce = lambda v, t: math.log1p(math.exp(-abs(v))) + max(v, 0) - v * t
    cuts = np.array([1.0, -0.5])
    assert value(spark, models.class_losses(doubles(cuts), F.lit(1), 3)["ordinal"]) == pytest.approx((bce(1.0, 1) + bce(-0.5, 0)) / 2)
    assert value(spark, models.multilabel_bce(doubles(z), doubles([1, 0, 1]))) == pytest.approx(np.mean([bce(v, t) for v, t in zip(z, [1, 0, 1], strict=True)]))


def test_checks(spark):
    df = spark.createDataFrame([(0,), (2,)], "y int")
    assert units.check_label_range(df, "y", 3) is df and units.check_least_rows(df, 2) is df and units.check_least_rows(df.limit(0), 0).count() == 0
    for check in (lambda: units.check_label_range(df, "y", 2), lambda: units.check_label_range(spark.createDataFrame([(None,)], "y int"), "y", 2), lambda: units.check_label_range(spark.createDataFrame([(0.5,)], "y double"), "y", 2), lambda: units.check_least_rows(df, 3)):
        with pytest.raises(ValueError):
            check()
    rows = spark.createDataFrame([("b", 1.0, 1), ("a", None, 0), ("a", 2.0, 1), (None, 1.0, 0)], "t string, x double, y int")
    assert [tuple(r) for r in units.canonical_order(rows, "t", ["x"], "y").collect()] == [(None, 1.0, 0), ("a", None, 0), ("a", 2.0, 1), ("b", 1.0, 1)]


def test_cleanup(spark):
    kept = store.staged(spark.range(5).toDF("x"), "gone")
    path = store._PATHS[-1].removeprefix("file://")
    import os

    assert kept.count() == 5 and os.path.isdir(path) and store.cleanup(spark) >= 1 and not os.path.exists(path) and store.cleanup(spark) == 0
