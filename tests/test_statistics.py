"""Known answers of the sufficient statistics, their pooling and their metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions import clean
from sigmaloom.operators import joins, metrics, pooling, statistics, units


def vector(df, size):
    out = [0.0] * size
    for r in df.collect():
        out[r["coord"]] = float(r["value"])
    return out


def test_association_rows(spark):
    df = spark.createDataFrame([("0", "0"), ("1", "1"), (None, "1"), ("9", None), ("NaN", "0")], "o string, e string")
    codes = df.select(clean.association_code(F.col("e"), (0, 1)).alias("e"), clean.association_code(F.col("o"), (0, 1)).alias("o"))
    assert vector(statistics.association(codes, [], "e", "o"), 9) == [1, 0, 1, 0, 1, 1, 0, 0, 1]
    assert vector(statistics.association(codes.limit(0), [], "e", "o"), 9) == [0] * 9


def test_association_subjects(spark):
    rows = [("no", "control", "a"), ("yes", "control", "a"), ("?", "treated", "a"), ("no", "control", "b"), ("?", "?", "b"), ("?", "?", "c")]
    df = spark.createDataFrame(rows, "o string, e string, unit string")
    codes = df.select("unit", clean.association_code(F.col("e"), ("control", "treated")).alias("e"), clean.association_code(F.col("o"), ("no", "yes")).alias("o"))
    for part in (codes, codes.orderBy(F.desc("o")), codes.union(codes)):
        assert vector(statistics.association(units.ever_positive(part, ["unit"], ["e", "o"]), [], "e", "o"), 9) == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_measures(spark):
    cells = spark.createDataFrame([(k, float(v)) for k, v in enumerate([80, 20, 5, 60, 40, 3, 2, 1, 4])], "coord int, value double")
    m = metrics.association_measures(cells, []).first()
    assert m["prevalence_unexposed"] == pytest.approx(0.2) and m["prevalence_exposed"] == pytest.approx(0.4) and m["prevalence_ratio"] == pytest.approx(2) and m["odds_ratio"] == pytest.approx(8 / 3)
    none = metrics.association_measures(cells.withColumn("value", F.lit(-1.0)), []).first()
    assert all(v is None for v in none)


def test_pooling_is_all_or_nothing(spark):
    rows = [(s, k, float(k + s)) for s in (0, 1) for k in range(9)]
    df = spark.createDataFrame(rows, "site int, coord int, value double")
    assert all(r["available"] and r["value"] == 2 * r["coord"] + 1 for r in pooling.pooled(df, "site", 2, 9).collect())
    broken = [df.where("not (site = 1 and coord = 8)"), df.withColumn("value", F.when(F.col("coord") == 3, float("nan")).otherwise(F.col("value"))), df.union(df.where("coord = 0")), df.limit(0)]
    for bad in [*broken, df]:
        got = pooling.pooled(bad, "site", 3 if bad is df else 2, 9).collect()
        assert len(got) == 9 and not any(r["available"] for r in got) and all(r["value"] is None for r in got)
    assert pooling.pooled_noise(spark.createDataFrame([(2.0,), (3.0,)], "sigma double")).first()[0] == pytest.approx(math.sqrt(13))
    assert pooling.pooled_noise(spark.createDataFrame([(2.0,), (0.0,)], "sigma double")).first()[0] is None


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.05), (0.0, 0.2), (1.0, 0.8), (1.0, 0.95)], "y double, p double")
    h = statistics.score_histogram(df, [], F.col("y"), F.col("p"), 16)
    m = metrics.binary(vector(h, 32), 16)
    assert m["accuracy"] == 1 and m["roc_auc"] == 1 and m["brier"] < 0.05
    assert metrics.roc_auc(h, [], 16).first()[0] == pytest.approx(1)
    empty = metrics.binary([0.0] * 32, 16)
    assert empty["accuracy"] == 0 and empty["roc_auc"] is None and empty["f1"] is None


def test_multiclass_and_multilabel(spark):
    df = spark.createDataFrame([(k, [float(k == j) for j in range(3)]) for k in range(3)], "y int, p array<double>")
    v = vector(statistics.multiclass(df, [], F.col("y"), F.col("p"), 3, 8), 9 + 48)
    m = metrics.multiclass(v, 3, 8, ordinal=True)
    assert m["accuracy"] == 1 and m["ordinal_mae"] == 0 and m["macro_roc_auc"] == 1
    two = spark.createDataFrame([([0, 1], [0.0, 1.0]), ([1, 0], [1.0, 0.0])], "y array<int>, p array<double>")
    assert metrics.multilabel(vector(statistics.multilabel(two, [], F.col("y"), F.col("p"), 2, 8), 32), 2, 8)["macro_f1"] == 1


def test_regression_and_count(spark):
    df = spark.createDataFrame([(0.0, 1.0), (5.0, 5.0), (10.0, 9.0)], "y double, p double")
    m = metrics.regression(vector(statistics.regression_sums(df, [], F.col("y"), F.col("p"), 0, 10), 5), 0, 10)
    assert m["mae"] == pytest.approx(2 / 3) and m["rmse"] == pytest.approx(math.sqrt(2 / 3))
    same = df.select("y", F.col("y").alias("p"))
    c = metrics.regression(vector(statistics.regression_sums(same, [], F.col("y"), F.col("p"), 0, 10, True), 6), 0, 10)
    assert c["rmse"] == 0 and c["mean_poisson_deviance_normalized"] == pytest.approx(0, abs=1e-9)  # a target of 0 is predicted at the floor 1e-8


def test_a_unit_has_a_mass_of_one(spark):
    many = spark.range(100_000).select(F.lit("a").alias("unit"), (F.col("id") % 7).alias("c"))
    assert sum(vector(statistics.unit_mass(many, [], "unit", F.col("c"), 8), 8)) == 1.0
    two = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "unit string, c int")
    assert vector(statistics.unit_mass(two, [], "unit", F.col("c"), 2), 2) == [0.5, 1.5]


def test_tie_rules(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("b", 2, 1), ("b", 2, 1), ("b", 1, 0)], "unit string, y int, l int")
    assert {r["unit"]: r["y"] for r in units.pooled_mode(df, "unit", "y").collect()} == {"a": 0, "b": 2}
    assert {r["unit"]: r["l"] for r in units.pooled_multilabel(df, "unit", ["l"]).collect()} == {"a": 1, "b": 1}
    assert {r["unit"]: r["l"] for r in units.pooled_tree_units(df, "unit", {}, "l", "binary").collect()} == {"a": 0, "b": 1}


def test_label_join_keeps_cardinality(spark):
    s = spark.createDataFrame([(0, "p2"), (1, " "), (2, "p1"), (3, "p1")], "i int, sample_id string")
    labels = spark.createDataFrame([("p1", 1), ("p2", 1), ("p2", 0), (None, 1)], "sample_id string, target int")
    assert [r["target"] for r in joins.label_join(s, labels, "sample_id", ["target"]).orderBy("i").collect()] == [None, None, 1, 1]


def test_ordinals(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"))
    got = [r["ordinal"] for r in units.numbered(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1000))


def test_federated_mean():
    f = pooling.FederatedMean()
    assert np.allclose(f.step([np.zeros(2)], [[np.array([1.0, 3.0])], [np.array([3.0, 5.0])]], 2)[0], [2, 4])
    with pytest.raises(ValueError):
        f.step([np.zeros(2)], [[np.ones(2)]], 2)
    for kind in ("fedavgm", "fedadam", "fedadagrad", "fedyogi"):
        assert pooling.FederatedMean(kind).step([np.zeros(2)], [[np.ones(2)]], 1)[0][0] > 0


def test_results_name_no_site():
    with pytest.raises(ValueError):
        metrics.guarded({"a": [{"per_fold": 1}]})
    assert metrics.guarded({"a": float("nan"), "b": [1.0]}) == {"a": None, "b": [1.0]}
