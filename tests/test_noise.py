"""The exact discrete Gaussian that is addressed by coordinate: against a sampler of one value, its distribution, and partitionings."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.operators import privacy


class One:
    """The words of one coordinate, and the published sampler in fractions."""

    def __init__(self, seed, coord):
        self.seed, self.coord, self.words = seed, coord, []
        self.block = 0

    def word(self):
        if not self.words:
            data = hashlib.shake_128(self.seed + self.block.to_bytes(8, "big") + self.coord.to_bytes(8, "big", signed=True)).digest(8 * privacy.Lanes.WORDS)
            self.words = [int.from_bytes(data[i : i + 8], "big") for i in range(0, len(data), 8)]
            self.block += 1
        return self.words.pop(0)

    def below(self, n):
        while (w := self.word()) >= (1 << 64) // n * n:
            pass
        return w % n

    def bernoulli(self, x):
        if x >= 1:
            return True
        while True:
            x *= 1 << 64
            first, w = math.floor(x), self.word()
            if w != first:
                return w < first
            x -= first

    def exp(self, x):
        for _ in range(math.floor(x)):
            if not self.exp_of_fraction(Fraction(1)):
                return False
        return self.exp_of_fraction(x - math.floor(x))

    def exp_of_fraction(self, x):
        k = 1
        while self.bernoulli(x / k):
            k += 1
        return k % 2 == 1

    def gaussian(self, sigma):
        t = sigma + 1
        while True:
            u = self.below(t)
            if not self.exp_of_fraction(Fraction(u, t)):
                continue
            v = 0
            while self.exp_of_fraction(Fraction(1)):
                v += 1
            y, negative = u + t * v, self.below(2) == 1
            if negative and y == 0:
                continue
            y = -y if negative else y
            if self.exp((abs(y) - Fraction(sigma * sigma, t)) ** 2 / (2 * sigma * sigma)):
                return y


@pytest.mark.parametrize("sigma", [1, 3, 1000, (1 << 31) + 7])
def test_equals_one_at_a_time(sigma):
    seed, coords = b"s" * 32, np.array([0, 1, 2, 77, -5, 1 << 40, *range(1000, 1300)])
    got = privacy.discrete_gaussians(seed, coords, sigma)
    assert got.tolist() == [One(seed, int(c)).gaussian(sigma) for c in coords]
    assert privacy.discrete_gaussians(seed, coords[::-1], sigma)[::-1].tolist() == got.tolist()


def test_distribution():
    sigma, n = 3, 60_000
    x = privacy.discrete_gaussians(b"d" * 32, np.arange(n), sigma).astype(int)
    p = {k: math.exp(-k * k / (2 * sigma**2)) for k in range(-40, 41)}
    whole = sum(p.values())
    chi = sum((np.sum(x == k) - n * p[k] / whole) ** 2 / (n * p[k] / whole) for k in range(-9, 10))
    assert chi < 45 and abs(x.mean()) < 0.06 and abs(x.std() - 3) < 0.05  # 19 cells: 45 is beyond 0.9997


def test_ties_go_on_with_the_next_bits():
    """A fraction whose first 64 bits equal the word is decided by the word after it."""
    lanes = privacy.Lanes(b"t" * 32, np.arange(4))
    first = privacy.Lanes(b"t" * 32, np.arange(4)).take(np.arange(4)).astype(object)
    p, q = np.array([int(w) * 2 + 1 for w in first], object), np.full(4, 1 << 65, object)  # the word, and half a unit of its last bit
    second = privacy.Lanes(b"t" * 32, np.arange(4))
    second.take(np.arange(4))
    assert lanes.bernoulli(np.arange(4), p, q).tolist() == (second.take(np.arange(4)) < np.uint64(1 << 63)).tolist()


def test_cells_in_any_partitioning(spark):
    cells = spark.range(5000).select(F.col("id").alias("coord"), F.when(F.col("id") % 7 != 0, F.col("id") * 3).alias("value"), F.lit(1).alias("n"))
    release = lambda df, secret=b"k", sigma=1000: {r["coord"]: r["value"] for r in privacy.release_cells(df, sigma, secret, "m", {"x": 1}).collect()}
    one = release(cells.coalesce(1))
    assert one == release(cells.orderBy(F.rand(1)).repartition(7))
    noise = np.array([one[k] - (3 * k if k % 7 else 0) for k in range(5000)])
    assert abs(noise.std() - 1000) < 50 and abs(noise.mean()) < 60
    other = release(cells.withColumn("value", F.when(F.col("coord") == 9, 1).otherwise(F.col("value"))))
    assert sum(one[k] == other[k] for k in range(5000)) < 50 and release(cells, b"other") != one
    assert release(cells.limit(0)) == {}
    top = spark.createDataFrame([(0, (1 << 63) - 1), (1, -(1 << 63))], "coord long, value long")
    assert all(abs(v) >= (1 << 63) - 10**7 for v in release(top).values())
    for bad in (cells.union(cells), cells.withColumn("coord", F.when(F.col("coord") > 0, F.col("coord")))):
        with pytest.raises(ValueError):
            privacy.release_cells(bad, 10, b"k", "m", {})
