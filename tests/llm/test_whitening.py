"""Bit-sliced whitening against sums in Python integers."""

import math

import numpy as np
import pytest

from sigmaloom.llm import whitening


def brute(rows, most=8):
    """n, deviations and covariance by plain integers, and whitened values by an eigendecomposition of it."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    cross = [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    cov = np.array([[c / n**2 for c in r] for r in cross])
    values, vectors = np.linalg.eigh(cov)
    z = np.array([[a - s / n for a, s in zip(r, sums, strict=True)] for r in x]) @ vectors[:, ::-1][:, :most] / np.sqrt(values[::-1][:most])
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x], z, values[::-1] / sum(cov[i][i] for i in range(d))


@pytest.mark.parametrize("scale", [0.3, 40.0, 3e9])
def test_equals_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(10, 10))
    vectors = (rng.normal(size=(300, 10)) @ mix * scale).astype(np.float32)
    vectors[7] = vectors[8]
    rows = [(i if i != 9 else None, [float(c) for c in v], 1, 2.0) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, []), (902, [None] + [0.0] * 9), (903, [math.nan] * 10), (904, [math.inf] + [0.0] * 9), (905, [1e300] * 10)]
    df = spark.createDataFrame([*rows, *((i, v, 1, 2.0) for i, v in bad)], "vec_id long, embedding array<double>, n long, whitened double").repartition(3)
    out = whitening.whiten(df.withColumn("embedding", df["embedding"].cast("array<double>"))).collect()
    n, deviations, z, share = brute(vectors)
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], []).append(r)
    assert len(out) == 300 * 8 and set(got) == {None if i == 9 else i for i in range(300)}
    for i in range(300):
        each = sorted(got[None if i == 9 else i], key=lambda r: r["component"])
        assert [r["component"] for r in each] == list(range(1, 9))
        assert {r["deviation_digits"] for r in each} == {str(deviations[i])} and {r["n"] for r in each} == {300}
        assert {r["deviation"] for r in each} == {deviations[i] if deviations[i] < 2**63 else None}
        np.testing.assert_allclose(np.abs([r["whitened"] for r in each]), np.abs(z[i]), rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose([r["explained"] for r in each], share[:8], rtol=1e-9)
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-6
    for k in range(8):  # one sign for all rows
        signs = {np.sign(sorted(got[i], key=lambda r: r["component"])[k]["whitened"] * z[i][k]) for i in range(9)}
        assert len(signs) == 1


def test_products_are_exact(spark, monkeypatch):
    """Sums over many blocks and wide entries equal Python's integers."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-(2**40), 2**40, (200, 2)), rng.integers(0, 3, (200, 1)), np.full((200, 1), 5)], 1)
    df = spark.createDataFrame([(i, [float(c) for c in v / 1024]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    vectors = whitening.usable(df)
    n, least, most = whitening.ranges(vectors)
    sums, cross = whitening.products(vectors, least, most)
    y = [[int(c) + 100_000 - int(a) for c, a in zip(r, least, strict=True)] for r in x]
    assert n == 200 and sums == [sum(r[j] for r in y) for j in range(4)]
    assert all(cross[i][j] == sum(r[i] * r[j] for r in y) for i in range(4) for j in range(i, 4))


def test_blocks_of_planes():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, (whitening.ROWS // 64 + 3, 5))
    bits = np.array([10, 10, 10, 10, 10])
    counts = whitening.popcounts(whitening.planes(x, np.zeros(5, np.int64), bits))
    total = sum(v << whitening.LIMB * k for k, v in enumerate(whitening.limbs(counts, bits).astype(object)))
    assert (np.triu(total) == np.triu(x.astype(object).T @ x)).all()


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [8.0, 2.0])], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(df.union(spark.createDataFrame([(3, [1.0])], df.schema))).count()
