"""Cross-validation in shared scans, sharded forest levels, bounded private training, and the sanitiser."""

import copy
import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions import keyed
from sigmaloom.operators import forests, privacy, trees, validation

KEY = bytes(range(32))
CUTS = tuple(float(v) for v in np.linspace(-1.5, 1.5, 5))
BINARY = trees.TreeSchema(("a", "b"), (CUTS, CUTS[:3]))
NUMERIC = trees.TreeSchema(("a", "b"), (CUTS, CUTS[:3]), "regression", -2.0, 2.0)
PARAMETERS = {
    "extra_trees": {"trees": 6, "depth": 3},
    "random_forest": {"trees": 3, "depth": 3, "max_features": 2},
    "lightgbm": {"trees": 1, "depth": 3, "leaves": 4, "rate": 0.8},
    "catboost": {"trees": 1, "depth": 2, "rate": 0.8},
    "xgboost": {"trees": 1, "depth": 2, "rate": 0.8},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (1500, 2))
    data = [(str(i % 500), *map(float, r), int(r[0] + 0.35 * r[1] > 0), float(np.clip(0.9 * r[0] - 0.25 * r[1], -2, 2))) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "unit string, a double, b double, y int, z double").withColumn("fold", keyed.fold(KEY, F.col("unit"), 3)).repartition(3).cache()


@pytest.mark.parametrize("engine", ["extra_trees", "random_forest", "catboost"])
@pytest.mark.parametrize("schema", [BINARY, NUMERIC])
def test_folds_equal_models_of_the_other_rows(rows, engine, schema):
    target = "y" if schema.task == "binary" else "z"
    together = validation.train_folds(engine, rows, schema, target, "fold", 3, KEY, **PARAMETERS[engine])
    more = {"key": KEY} if engine == "random_forest" else {}
    alone = [trees.train(engine, rows.where(F.col("fold") != k), schema, target, **more, **PARAMETERS[engine]) for k in (1, 2, 3)]
    assert together == alone and len({trees.canonical(m) for m in alone}) == 3
    got = {tuple(r)[:3]: r["prediction"] for r in validation.out_of_fold(rows, together, schema, "fold", ["a", "b", "fold"]).collect()}
    assert len(got) == 1500
    for k in (1, 2, 3):
        for r in trees.predict(rows.where(F.col("fold") == k), [alone[k - 1]], schema, ["a", "b", "fold"]).collect():
            assert got[tuple(r)[:3]] == r["prediction"]


def test_jobs_do_not_grow_with_folds(spark, rows):
    def jobs(folds):
        group = f"folds {folds} {time.time()}"
        spark.sparkContext.setJobGroup(group, "")
        validation.train_folds("random_forest", rows.withColumn("fold", keyed.fold(KEY, F.col("unit"), folds)), BINARY, "y", "fold", folds, KEY, **PARAMETERS["random_forest"])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    jobs(2)  # the rows are cached now
    assert jobs(8) <= jobs(2) + 1


def test_released_validation(rows):
    exact = validation.cross_validated("extra_trees", rows, BINARY, "y", "unit", KEY, 3, bins=16, **PARAMETERS["extra_trees"])
    assert exact["metrics"]["n"] == 500 and exact["metrics"]["roc_auc"] > 0.8 and exact["sigma"] == 0
    private = lambda secret: validation.cross_validated("extra_trees", rows, BINARY, "y", "unit", KEY, 3, 3.0, 1e-5, secret, bins=16, **PARAMETERS["extra_trees"])
    one = private(b"a")
    assert one == private(b"a") != private(b"b") and one["sigma"] == pytest.approx(privacy.gaussian_sigma(0.6, 0.2e-5, math.sqrt(2)))
    numeric = validation.cross_validated("random_forest", rows, NUMERIC, "z", "unit", KEY, 3, **PARAMETERS["random_forest"])
    assert numeric["metrics"]["n"] == 500 and numeric["metrics"]["rmse"] < 1
    with pytest.raises(ValueError):
        validation.train_folds("extra_trees", rows.withColumn("fold", F.lit(None).cast("int")), BINARY, "y", "fold", 3, **PARAMETERS["extra_trees"])


def keeper(folder):
    """Noise that is none, and keeps the exact vectors that would be released, by label; a local class, so that tasks get it by value."""

    class Keep(trees.Exact):
        def __call__(self, vector, label):
            np.save(f"{folder}/{label}.npy", np.asarray(vector, float))
            return vector

        integers = __call__

    folder.mkdir()
    return Keep()


def vectors(folder):
    return {f.name: np.load(f) for f in sorted(folder.iterdir())}


@pytest.mark.parametrize("engine", sorted(PARAMETERS))
@pytest.mark.parametrize("schema", [BINARY, NUMERIC])
def test_no_unit_moves_a_statistic_by_more_than_its_sensitivity(spark, rows, tmp_path, engine, schema):
    """One unit of many rows is replaced by another one at will; what stays fixed are the splits, as the plan composes releases."""
    target = "y" if schema.task == "binary" else "z"
    base = rows.select("unit", "a", "b", F.col(target).cast("double").alias("t")).where(F.col("unit").cast("int") < 60)
    wild = [(5, 1e9), (5, -1e9), (5, None), (5, math.nan), (5, math.inf)] * 3
    first = base.where("unit != '5'").union(spark.createDataFrame([("5", 0.1, 0.2, 0.0)], base.schema))
    other = base.where("unit != '5'").union(spark.createDataFrame([("5", float(k) if k % 2 else None, -9.0, v) for k, v in wild] + [("5", math.inf, 1e300, 1e12)] * 4, base.schema))
    p = PARAMETERS[engine] | ({"key": KEY} if engine == "random_forest" else {})
    plan = trees.release_plan(engine, schema, 1.0, 1e-6, PARAMETERS[engine])
    for k, df in enumerate((first, other)):
        trees.train(engine, df, schema, "t", noise=keeper(tmp_path / str(k)), unit="unit", **p)
    one, two = (vectors(tmp_path / str(k)) for k in range(2))
    first_release = {label: v for label, v in one.items() if label.startswith(("leaves",) if engine == "extra_trees" else ("level 0", "tree 0 step 0"))}
    moved = math.sqrt(sum(((v - two[label]) ** 2).sum() for label, v in first_release.items()))
    most = float(plan.get("sensitivity", plan.get("sensitivity_root", 0)))
    assert first_release and 0 < moved <= most + 1e-9


def test_missing_and_wild_targets_train(spark):
    df = spark.createDataFrame([(0.1, 0.2, None), (0.3, None, math.nan), (-1.0, 1.0, math.inf), (None, 0.0, 1000.0), (0.0, 0.0, -5.0)], "a double, b double, t double")
    for engine, schema in itertools.product(sorted(PARAMETERS), (BINARY, NUMERIC)):
        more = {"key": KEY} if engine == "random_forest" else {}
        model = trees.sanitised(trees.train(engine, df, schema, "t", **more, **PARAMETERS[engine]), schema)
        p = [r["prediction"] for r in trees.predict(df, [model], schema, []).collect()]
        assert all(schema.lower <= v <= schema.upper for v in p)


def test_splits_equal_an_exhaustive_search():
    rng = np.random.default_rng(4)
    cuts = np.array([3, 5, 1])
    for task in ("binary", "regression"):
        for _ in range(30):
            h = rng.integers(0, 4, (4, 2, 7, 2)).astype(float)
            if task == "regression":
                h[..., 1] = np.minimum(h[..., 1], h[..., 0])
            chosen = np.array([[0, 1], [0, 2], [1, 2], [0, 1]], np.int16)
            feature, cut, left = forests.best_splits(h, chosen, cuts, task)
            for node in range(4):
                best = None
                for k, f in enumerate(chosen[node]):
                    part, missing = h[node, k, : cuts[f] + 1], h[node, k, -1]
                    for c, side in itertools.product(range(cuts[f]), (False, True)):
                        a, z = part[: c + 1].sum(0) + missing * side, part[c + 1 :].sum(0) + missing * (not side)
                        if task == "binary":
                            worth = sum(float((x**2).sum() / max(x.sum(), np.finfo(float).tiny)) for x in (a, z))
                        else:
                            worth = sum(float(x[1] ** 2 / max(x[0], np.finfo(float).tiny)) for x in (a, z))
                        order = (-worth, int(f), c, side)
                        best = order if best is None or order[0] < best[0] - 1e-12 else best
                assert (feature[node], cut[node], left[node]) == best[1:]


def test_a_forest_of_public_limits_plans_at_once(spark):
    """512 trees of depth 12: candidates are drawn in seconds, and levels have no literal of them."""
    began = time.time()
    for level in (0, 5, 11):
        drawn = [forests.candidates(BINARY, 512, 12, 1, level, t) for t in range(512)]
        assert len(drawn[0]) == 1 << level
    assert time.time() - began < 30
    df = spark.range(2000).select((F.randn(1)).alias("a"), F.randn(2).alias("b")).withColumn("y", (F.col("a") > 0).cast("int"))
    model = trees.train("random_forest", df, BINARY, "y", key=KEY, trees=64, depth=8, max_features=2)
    assert len(trees.sanitised(model, BINARY)["trees"]) == 64


def test_sanitiser_refuses_what_no_engine_makes(rows):
    forest = trees.train("extra_trees", rows, BINARY, "y", trees=2, depth=2)
    boosted = trees.train("xgboost", rows, BINARY, "y", **PARAMETERS["xgboost"])
    for model in (forest, boosted):
        assert trees.sanitised(model, BINARY) == model

    def change(model, *path_and_value):
        out = copy.deepcopy(model)
        at, (*path, last, value) = out, path_and_value
        for p in path:
            at = at[p]
        at[last] = value
        return out

    one = {"features": [0], "cuts": [0], "default_left": [True], "leaves": [0.5, 0.5]}
    bad = [forest | {"depth": 12}, forest | {"depth": 12, "trees": [one]}, forest | {"x": 1}, forest | {"trees": []}, forest | {"depth": True}, forest | {"task": "regression"}, forest | {"engine": "depthwise"}, {"kind": "forest"}, [], None, forest | {"trees": forest["trees"] * 300}]
    bad += [change(forest, "trees", 0, k, 0, v) for k, v in (("leaves", 7e9), ("leaves", -3.0), ("leaves", 1), ("leaves", math.nan), ("features", 2), ("features", True), ("features", 0.0), ("cuts", 5), ("cuts", -1), ("default_left", 1))]
    bad += [change(forest, "trees", 0, "note", "x"), change(forest, "trees", 0, "leaves", [0.5]), change(forest, "release", {"epsilon": "x"}), change(forest, "release", {"epsilon": math.inf})]
    bad += [boosted | {"start": 1e300}, boosted | {"start": 0}, boosted | {"upper": 9.0}, change(boosted, "trees", 0, "leaf", 0, 1e200), change(boosted, "trees", 0, "left", 0, 0), change(boosted, "trees", 0, "left", 0, -1), change(boosted, "trees", 0, "right", 0, boosted["trees"][0]["left"][0]), change(boosted, "trees", 0, "left", 0, 1.0), change(boosted, "trees", 0, "left", [])]
    for k, model in enumerate(bad):
        with pytest.raises(ValueError):
            trees.sanitised(model, BINARY)
            pytest.fail(f"{k} was accepted")
