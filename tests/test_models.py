import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions import models
from sigmaloom.operators import blocks, linear, privacy, trees

KEY = bytes(range(32))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (3000, 3))
    data = [(i, *map(float, r), int(r[0] + 0.35 * r[1] > 0), float(np.clip(0.9 * r[0] - 0.25 * r[1], -2, 2))) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "i int, a double, b double, c double, y int, z double").repartition(4).cache()


CUTS = tuple(float(v) for v in np.linspace(-1.75, 1.75, 8))
BINARY = trees.TreeSchema(("a", "b", "c"), (CUTS,) * 3)
NUMERIC = trees.TreeSchema(("a", "b", "c"), (CUTS,) * 3, "regression", -2.0, 2.0)
PARAMETERS = {
    "extra_trees": {"trees": 16, "depth": 4},
    "random_forest": {"trees": 4, "depth": 3, "max_features": 2},
    "lightgbm": {"trees": 2, "depth": 4, "leaves": 6, "rate": 0.8, "max_step": 4.0},
    "catboost": {"trees": 2, "depth": 3, "rate": 0.8, "max_step": 4.0},
    "xgboost": {"trees": 2, "depth": 3, "rate": 0.8, "max_step": 4.0},
}


@pytest.mark.parametrize("engine", PARAMETERS)
def test_engines_learn(rows, engine):
    model = trees.sanitised(trees.train(engine, rows, BINARY, "y", key=KEY, **PARAMETERS[engine]), BINARY)
    p = trees.predict(rows, [model], BINARY, ["y"]).toPandas()
    assert ((p["prediction"] >= 0.5) == (p["y"] == 1)).mean() > (0.75 if engine == "extra_trees" else 0.8)


@pytest.mark.parametrize("engine", ["random_forest", "lightgbm"])
def test_regression(rows, engine):
    model = trees.train(engine, rows, NUMERIC, "z", key=KEY, **PARAMETERS[engine])
    p = trees.predict(rows, [model], NUMERIC, ["z"]).toPandas()
    assert np.sqrt(((p["prediction"] - p["z"]) ** 2).mean()) < 0.75 * p["z"].std()


def test_training_does_not_depend_on_order(rows):
    one = trees.train("lightgbm", rows, BINARY, "y", **PARAMETERS["lightgbm"])
    assert one == trees.train("lightgbm", rows.orderBy(F.desc("a")).repartition(7), BINARY, "y", **PARAMETERS["lightgbm"])


def test_expression_equals_batch_prediction(rows):
    model = trees.train("xgboost", rows, BINARY, "y", **PARAMETERS["xgboost"])
    from sigmaloom.functions.clean import bin_of

    some = rows.withColumn("a", F.when(F.col("i") % 5 == 0, None).otherwise(F.col("a")))
    b = F.array(*[bin_of(F.col(f), c) for f, c in zip(BINARY.features, BINARY.cuts, strict=True)])
    left = {r["i"]: r["m"] for r in some.select("i", b.alias("b")).select("i", models.sigmoid(trees.margin(model, F.col("b"))).alias("m")).collect()}
    right = {r["i"]: r["prediction"] for r in trees.predict(some, [model], BINARY, ["i"]).collect()}
    assert all(abs(left[i] - right[i]) < 1e-12 for i in right)


def test_noise_is_asked_for_once_a_release(rows, tmp_path):
    seen = []
    trees.train("extra_trees", rows, BINARY, "y", noise=lambda v, label: seen.append((label, len(v))) or v, **PARAMETERS["extra_trees"])
    assert seen == [("leaves", 16 * 16 * 2)]
    # a level's noise is drawn where each tree's histogram lies: one disjoint part for each tree
    tell = lambda v, label: (tmp_path / label).write_text(str(len(v))) and v
    trees.train("random_forest", rows, BINARY, "y", key=KEY, noise=tell, **PARAMETERS["random_forest"])
    told = {f.name.split(" tree ")[0] for f in tmp_path.iterdir()}
    assert len(told) == privacy.forest_releases("random_forest", "binary", 4, 3)["releases"] and len(list(tmp_path.iterdir())) == 4 * len(told)


def test_broken_models_are_refused(rows):
    model = trees.train("extra_trees", rows, BINARY, "y", trees=1, depth=2)
    for key, value in (("features", [9, 0, 0]), ("cuts", [99, 0, 0]), ("default_left", [1, True, True]), ("leaves", [float("nan")] * 4), ("leaves", [0.1])):
        with pytest.raises(ValueError):
            trees.sanitised(model | {"trees": [model["trees"][0] | {key: value}]}, BINARY)


def test_empty_training_side(rows):
    assert trees.train("extra_trees", rows.limit(0), BINARY, "y", trees=2, depth=2)["trees"][0]["leaves"] == [0.5] * 4


def test_logistic_steps(rows):
    r = rows.select(F.col("i").cast("string").alias("unit"), "y", (F.col("a") / 2).alias("a"), (F.col("b") / 2).alias("b"))
    w = linear.fit(r, ["a", "b"], "binary", KEY, KEY, 3000, steps=6, rate=4.0, sample=False)
    assert w[0] > w[1] > 0
    noisy = linear.fit(r, ["a", "b"], "binary", KEY, KEY, 3000, steps=3, noise=1.0)
    assert np.array_equal(noisy, linear.fit(r, ["a", "b"], "binary", KEY, KEY, 3000, steps=3, noise=1.0))
    assert linear.learning_rate(1.0, 2, 4, "step") == 0.25 and linear.learning_rate(1.0, 2, 4, "cosine") == pytest.approx(0.5)
    for kind in ("sgd", "adam", "adamw", "rmsprop"):
        assert (linear.Optimiser(kind, l2=0.1, l1=0.01).step(np.ones(2), np.ones(2), 0.1) < 1).all()


def test_block_functions(rows):
    frame = rows.select(F.col("i").cast("string").alias("unit"), "y", "a", "b")

    def update(x, y, config):
        if config["fail"]:
            raise RuntimeError
        return x.mean(0)

    good = blocks.block_updates(frame, ["a", "b"], update, {"fail": False}, KEY, 4, 2)
    assert len(good) == 4 and all(np.any(u) for u in good)
    assert not np.any(blocks.block_updates(frame, ["a", "b"], update, {"fail": True}, KEY, 4, 2))
    one = blocks.private_update(frame, ["a", "b"], update, {"fail": False}, KEY, KEY, 4, 2, 1.0, 1.0, 1e-6)
    assert one.shape == (2,)


def test_folds_of_blocks(rows):
    """Equal to the function on whole blocks in any partitioning; one block's failure leaves the others."""
    from pyspark import cloudpickle

    class Mean:
        bad, wrong = None, False

        def init(self):
            return np.zeros(3)

        def update(self, state, x, y):
            if self.bad is not None and (x[:, 0] == self.bad).any():
                raise RuntimeError
            return state + [len(x), *x.sum(0)]

        def merge(self, a, b):
            return a + b

        def finish(self, state):
            return np.zeros(9) if self.wrong else state[1:] / state[0]

    assert cloudpickle.dumps(Mean)
    frame = rows.select(F.col("i").cast("string").alias("unit"), "y", "a", "b")
    want = blocks.block_updates(frame, ["a", "b"], lambda x, y, config: x.mean(0), {}, KEY, 4, 2)
    fold = Mean()
    for df in (frame.coalesce(1), frame.repartition(40)):
        np.testing.assert_allclose(blocks.folded_updates(df, ["a", "b"], fold, KEY, 4, 2), want, rtol=1e-12)
    fold.bad = float(frame.where("unit = '7'").first()["a"])
    got = blocks.folded_updates(frame, ["a", "b"], fold, KEY, 4, 2)
    assert sum(not np.any(u) for u in got) == 1 and all(not np.any(g) or np.allclose(g, w) for g, w in zip(got, want, strict=True))
    fold.bad, fold.wrong = None, True
    assert not np.any(blocks.folded_updates(frame, ["a", "b"], fold, KEY, 4, 2)) and not np.any(blocks.folded_updates(frame.limit(0), ["a", "b"], Mean(), KEY, 4, 2))
    assert blocks.private_fold(frame, ["a", "b"], Mean(), KEY, KEY, 4, 2, 1.0, 1.0, 1e-6).shape == (2,)


def test_links(spark):
    df = spark.createDataFrame([([0.5, -0.5, 2.0],)], "z array<double>")
    for loss in ("cross_entropy", "ordinal"):
        p = df.select(models.predictions(F.col("z"), loss)).first()[0]
        assert sum(p) == pytest.approx(1) and min(p) >= 0


def test_functions_beyond_spark(spark):
    import math

    from sigmaloom.functions import arrow

    df = spark.createDataFrame([(0.5, 3.0), (-1.0, 0.0)], "z double, y double")
    got = df.select(arrow.gelu(F.col("z")).alias("g"), arrow.lgamma(F.col("y")).alias("l"), arrow.negbin_nll(F.col("z"), F.col("y"), 2.0).alias("n")).collect()
    assert got[0]["g"] == pytest.approx(0.5 * 0.5 * (1 + math.erf(0.5 / math.sqrt(2)))) and got[0]["l"] == pytest.approx(math.log(2)) and got[1]["l"] is None
    mu = math.exp(0.5)
    p = math.gamma(5) / (math.gamma(2) * math.gamma(4)) * (2 / (2 + mu)) ** 2 * (mu / (2 + mu)) ** 3
    assert got[0]["n"] == pytest.approx(-math.log(p))


def test_the_input_of_a_layer_is_evaluated_once(spark):
    """An input that differs at each evaluation: the layers' sums hold only if all of a layer sees one."""
    x = F.array(*[F.rand(k) for k in range(5)])
    layers = {k: models.build([{"op": k}], x) for k in ("layernorm", "softmax")} | {"twice": models.build([{"op": "linear", "weights": [[1.0] * 5, [-1.0] * 5]}], x)}
    for row in spark.range(20).select(*[models.total(c).alias(k) for k, c in layers.items()]).collect():
        assert abs(row["layernorm"]) < 1e-9 and abs(row["softmax"] - 1) < 1e-9 and abs(row["twice"]) < 1e-9
