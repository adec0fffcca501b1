"""Private training, the durable guard, row places and blocks, and small-cell rules."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.operators import privacy, trees, units

SCHEMA = trees.TreeSchema(("x0", "x1"), ((-1.0, -0.5, 0.0, 0.5, 1.0), (-1.0, -0.5, 0.0, 0.5, 1.0)))
ENGINES = {
    "extra_trees": {"trees": 32, "depth": 4},
    "random_forest": {"trees": 4, "depth": 3, "max_features": 2},
    "lightgbm": {"trees": 2, "depth": 3, "leaves": 4, "rate": 0.5},
    "catboost": {"trees": 2, "depth": 2, "rate": 0.5},
    "xgboost": {"trees": 2, "depth": 2, "rate": 0.5},
}


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(20_000).select(F.randn(1).alias("x0"), F.randn(2).alias("x1")).withColumn("x0", F.when(F.rand(3) < 0.05, None).otherwise(F.col("x0")))
    return x.withColumn("y", (F.coalesce("x0", F.lit(0.4)) + 0.5 * F.col("x1") > 0).cast("int"))


@pytest.mark.parametrize("engine", sorted(ENGINES))
def test_private_models_replay(spark, rows, engine):
    p, train = ENGINES[engine], lambda secret, epsilon: trees.train(engine, rows, SCHEMA, "y", key=b"k", epsilon=epsilon, delta=1e-6, secret=secret, **ENGINES[engine])
    one = train(b"a", 3.0)
    assert trees.canonical(one) == trees.canonical(train(b"a", 3.0)) != trees.canonical(train(b"b", 3.0))
    assert trees.canonical(one) != trees.canonical(trees.train(engine, rows, SCHEMA, "y", key=b"k", **p))
    trees.sanitised(one, SCHEMA)
    assert one["release"]["epsilon"] == 3.0 and one["release"]["releases"] == {"extra_trees": 1, "random_forest": 4, "lightgbm": 6, "catboost": 4, "xgboost": 4}[engine]
    scored = trees.predict(rows, [one], SCHEMA, ["y"]).agg(F.avg(((F.col("prediction") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]
    assert scored > (0.75 if engine in ("extra_trees", "random_forest") else 0.6)
    with pytest.raises(ValueError):
        trees.train(engine, rows, SCHEMA, "y", key=b"k", epsilon=3.0, delta=1e-6, **p)
    with pytest.raises(ValueError):
        trees.train(engine, rows, SCHEMA, "y", key=b"k", epsilon=3.0, **p)


def test_plans_follow_the_published_formulas():
    z = lambda e, d: 2 * e / (math.sqrt(2 * math.log(1 / d) + 2 * e) + math.sqrt(2 * math.log(1 / d)))
    plan = lambda engine, **more: trees.release_plan(engine, SCHEMA, 2.0, 1e-5, ENGINES[engine] | more)
    assert plan("extra_trees")["sigma"] == pytest.approx(math.sqrt(2 * 32) / z(2.0, 1e-5))
    forest = plan("random_forest")
    assert forest["sigma"] == pytest.approx(math.sqrt(2 * 2 * 4) / z(2.0, 1e-5)) and forest["sigma_leaf"] == pytest.approx(math.sqrt(2 * 4) / z(2.0, 1e-5))
    assert plan("lightgbm", g_clip=1.0, h_clip=0.5)["sigma"] == pytest.approx(math.sqrt(2 * max(2 * (1 + 0.25 + 1), 4.25) * 6) / z(2.0, 1e-5))
    deep = plan("xgboost")
    assert deep["rho"] == Fraction(4) / (4 * (17 + 2)) and deep["rho_level"] == deep["rho"] / 4
    for name, groups in (("root", 3), ("level", 2)):
        d = math.isqrt(5 * groups * trees.SCALE**2 - 1) + 1
        assert deep[f"sensitivity_{name}"] == d
        least = math.ceil(Fraction(d * d) / (2 * deep["rho_level"]))
        assert deep[f"sigma_{name}"] == math.isqrt(least - 1) + 1


def test_missing_bins_are_what_is_left():
    fixed = np.zeros((1, 2, 4, 3), np.int64)
    fixed[0, 0, :, 0], fixed[0, 0, :, 1] = [10, -4, 3, 7], [5, 6, 7, 8]
    fixed[0, 1, :, 0], fixed[0, 1, :, 1] = [16, 0, 0, 0], [26, 0, 0, 0]
    p = trees.Boosting("depthwise", 1, 1, g_clip=float(trees.SCALE), h_clip=float(trees.SCALE))
    hist = trees._released_pairs(fixed, [None], trees.no_noise, "", p)
    assert hist[0, 0, :, 0].tolist() == [10, -4, 3, 7] and hist[0, 1, :, 1].tolist() == [26, 0, 0, 0] and not hist[..., 2].any()
    seen = []

    class Spy(trees.Exact):
        def integers(self, vector, label):
            seen.append(len(vector))
            return vector

    trees._released_pairs(fixed, [None], Spy(), "", p)
    trees._released_pairs(fixed, [np.array([16.0, 26.0, 0.0])], Spy(), "", p)
    assert seen == [2 + 2 * 3 * 2, 2 * 3 * 2]  # a root's total pair, and observed bins only
    with pytest.raises(ValueError):
        trees.Boosting("depthwise", 1, 1, min_count=1.0)


def test_leaf_sums_equal_the_expressions(spark, rows):
    topology = trees.random_topology(SCHEMA, 5, 3)
    b = trees.binned_rows(rows, SCHEMA, "y")
    got = {r["coord"]: (r["n"], r["s"]) for r in trees._leaf_sums(b.select("b", F.col("y").cast("long").alias("s")), topology, 3).collect()}
    at = F.posexplode(F.array(*[trees.heap_leaf(t, 3) for t in topology])).alias("t", "leaf")
    want = b.select("y", at).groupBy((F.col("t") * 8 + F.col("leaf")).alias("coord")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("s")).collect()
    assert got == {r["coord"]: (r["n"], r["s"]) for r in want}


def test_empty_sides(spark, rows):
    model = trees.train("extra_trees", rows, SCHEMA, "y", trees=2, depth=1)
    none = trees.empty_side(SCHEMA, "extra_trees")
    few = rows.limit(5)
    assert [r["prediction"] for r in trees.predict(few, [model, none], SCHEMA, []).collect()] == [r["prediction"] for r in trees.predict(few, [model], SCHEMA, []).collect()]
    with pytest.raises(ValueError):
        trees.predict(few, [none], SCHEMA, [])


def test_the_guard_outlives_its_process(tmp_path):
    calls = []
    answer = lambda v: (calls.append(v), {"v": v})[1]
    folder = str(tmp_path / "guard")
    assert privacy.ReplayGuard(folder).claim("op", 1, 2, {"a": 1}, lambda: answer(1)) == {"v": 1}
    assert privacy.ReplayGuard(folder).claim("op", 1, 2, {"a": 1}, lambda: answer(2)) == {"v": 1}
    with pytest.raises(ValueError):
        privacy.ReplayGuard(folder).claim("op", 1, 2, {"a": 2}, lambda: answer(3))
    assert privacy.ReplayGuard(folder).claim("op", 1, 3, {"a": 2}, lambda: answer(4)) == {"v": 4} and calls == [1, 4]

    def fails():
        raise OSError("lost")

    with pytest.raises(OSError):
        privacy.ReplayGuard(folder).claim("op", 2, 1, {"a": 5}, fails)
    with pytest.raises(ValueError):  # the claim stands
        privacy.ReplayGuard(folder).claim("op", 2, 1, {"a": 6}, lambda: answer(6))
    assert privacy.ReplayGuard(folder).claim("op", 2, 1, {"a": 5}, lambda: answer(5)) == {"v": 5}


def test_places_of_many_rows_with_a_payload(spark):
    """More rows than a range's sample, and other columns beside the key."""
    n = 600_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.col("id").alias("p"))
    got = units.numbered(df.repartition(16), ["k"])
    row = got.agg(F.count(F.lit(1)), F.count_distinct("ordinal"), F.count_if(F.col("ordinal") == F.col("k")), F.count_if((F.col("p") * 7919) % n == F.col("k"))).first()
    assert tuple(row) == (n, n, n, n)


def test_row_blocks(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), F.lit("x").alias("block_of"))
    for blocks in (1, 7, 64, 2000):
        got = {r["k"]: r["block"] for r in units.row_blocks(df, b"key", ["k"], blocks).collect()}
        sizes = np.bincount(list(got.values()), minlength=blocks)
        assert len(got) == 1003 and sizes.tolist() == [1003 // blocks + (i < 1003 % blocks) for i in range(blocks)]
    again = {r["k"]: r["block"] for r in units.row_blocks(df.repartition(5), b"key", ["k"], 7).collect()}
    assert again == {r["k"]: r["block"] for r in units.row_blocks(df, b"key", ["k"], 7).collect()} != {r["k"]: r["block"] for r in units.row_blocks(df, b"other", ["k"], 7).collect()}
    assert units.row_blocks(df.limit(0), b"key", ["k"], 3).count() == 0
