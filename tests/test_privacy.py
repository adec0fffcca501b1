import hashlib
import hmac
import json
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigmaloom.functions import keyed
from sigmaloom.operators import privacy
from sigmaloom.plans import contract

KEY = bytes(range(32))


def test_hmac_expression(spark):
    texts = ["", "a", "päng", "x" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (KEY, b"k" * 100):
        got = {r["t"]: r["h"] for r in df.select("t", keyed.hmac_hex(key, F.col("t")).alias("h")).collect()}
        assert got == {t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts}


def test_partitions_are_sticky_nested_and_coherent(spark):
    df = spark.range(2000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("u"))
    u = F.col("u")
    rows = df.union(df).select("u", keyed.holdout(KEY, u, 200_000).alias("a"), keyed.holdout(KEY, u, 300_000).alias("b"), keyed.fold(KEY, u, 5).alias("f5"), keyed.fold(KEY, u, 10).alias("f10"), keyed.block(KEY, u, 8).alias("k")).collect()
    assert len({tuple(r) for r in rows}) == 2000
    assert all(not r["a"] or r["b"] for r in rows) and all(r["f5"] == (r["f10"] + 1) // 2 for r in rows)
    assert 0.15 < sum(r["a"] for r in rows) / 4000 < 0.25 and {r["k"] for r in rows} == set(range(8))
    for k in (1, 11):
        with pytest.raises(ValueError):
            keyed.fold(KEY, u, k)


def test_calibration():
    assert privacy.gaussian_sigma(1, 1e-6, math.sqrt(2)) == pytest.approx(7.566014362072543, rel=1e-9)
    assert privacy.gaussian_sigma(3, 1e-5, 1) == pytest.approx(1.697681730543086, rel=1e-9)
    assert privacy.gaussian_sigma(1, 1e-6, 2, 5) == pytest.approx(23.925838193695114, rel=1e-9)
    for bad in ((0, 1e-6, 1), (1, 1, 1), (1, 1e-6, 0)):
        with pytest.raises(ValueError):
            privacy.gaussian_sigma(*bad)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=4), st.integers(0, 3), st.integers(0, 5))
def test_binary_sensitivity_holds(labels, at, new):
    """Replacing one unit moves a histogram of unit masses by the square root of two at most."""
    other = list(labels)
    other[at % len(labels)] = new
    a, b = (np.bincount(x, minlength=6) for x in (labels, other))
    assert np.linalg.norm(a - b) <= privacy.sensitivity("binary") + 1e-12


def test_releases_replay():
    v = [10.0, 0.0, 3.0]
    a = privacy.release(v, 2.0, KEY, "m", {"x": 1})
    assert np.array_equal(a, privacy.release(v, 2.0, KEY, "m", {"x": 1}))
    for other in (privacy.release([10.0, 0.0, 4.0], 2.0, KEY, "m", {"x": 1}) - [0, 0, 1], privacy.release(v, 2.0, KEY, "n", {"x": 1}), privacy.release(v, 2.0, b"k", "m", {"x": 1})):
        assert not np.allclose(a, other)


def test_streams_are_distributed_as_said():
    s = privacy.KeyedStream(b"seed")
    x = s.normal(20_000)
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03
    d = [s.discrete_gaussian(3) for _ in range(2000)]
    assert abs(np.mean(d)) < 0.3 and abs(np.std(d) - 3) < 0.3
    assert sorted(s.permutation(50)) == list(range(50))


def test_discrete_allocation_is_within_budget():
    a = privacy.discrete_allocation(Fraction(1), Fraction(1, 10**6), 4, 3, 5, "binary", 1 << 10)
    spent = 4 * (Fraction(a["sensitivity_root"]) ** 2 / (2 * a["sigma_root"] ** 2) + 2 * Fraction(a["sensitivity_level"]) ** 2 / (2 * a["sigma_level"] ** 2))
    assert spent <= a["rho"]


def test_gradient_noise_meets_its_budget():
    z = privacy.sgd_noise(2.0, 1e-5, 0.1, 20)
    e0, d0 = privacy.replace_one_budget(2.0, 1e-5)
    assert privacy.sampled_gaussian_epsilon(0.1, z, 20, d0) <= e0 < privacy.sampled_gaussian_epsilon(0.1, 0.9 * z, 20, d0)


def test_projection_and_clipping():
    p = privacy.project_to_simplex(np.array([3.0, -1.0, 1.0]), 2.0)
    assert p.min() >= 0 and p.sum() == pytest.approx(2)
    assert np.linalg.norm(privacy.clipped(np.array([3.0, 4.0]), 1.0)) == pytest.approx(1) and not privacy.clipped(np.array([np.nan]), 1.0).any()


def test_budgets_and_replay_guard():
    f = privacy.fold_budget(1.0, 1e-6, 5)
    assert 5 * f["fold"][0] + f["out_of_fold"][0] == pytest.approx(1)
    g, calls = privacy.ReplayGuard(), []
    answer = lambda: calls.append(1) or 7
    assert g.claim("fit", 1, 1, {"a": 1}, answer) == g.claim("fit", 1, 1, {"a": 1}, answer) == 7 and calls == [1]
    with pytest.raises(ValueError):
        g.claim("fit", 1, 1, {"a": 2}, answer)


def test_contracts():
    c = contract.Contract("y", ("a", "b"), subject="b")
    assert c.model_features == ("a",) and c.columns == ["y", "a", "b"] and len(c.sha256()) == 64
    assert c.sha256() != contract.Contract("y", ("a",), subject="b").sha256()
    for bad in ({"epsilon": 11}, {"delta": 0.1}, {"features": ("y",)}, {"bounds": {"a": (2, 1)}}, {"task": "regression"}, {"levels": ("x",)}):
        with pytest.raises(ValueError):
            contract.Contract(**({"target": "y", "features": ("a",)} | bad))
    assert contract.check_params({"a": [1, 2, {"b": "c"}]}) == 5
    for bad in ({"seed": 1}, {"a": float("inf")}, {"a": object()}, json.loads("[" * 12 + "]" * 12)):
        with pytest.raises(ValueError):
            contract.check_params(bad)
