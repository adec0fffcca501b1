"""Pooling over sites: all or nothing. The frames here have a row for each site and coordinate of a fixed layout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled(vectors: DataFrame, site: str, sites: int, size: int) -> DataFrame:
    """coord, value, available: sums over sites. If not exactly `sites` sites sent exactly coordinates 0 .. size - 1, all finite, then
    `available` is false and every value is null."""
    x = F.col("value").cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & F.col("coord").between(0, size - 1)
    by_site = vectors.groupBy(site).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("coord").alias("d"), F.count_if(good).alias("g"))
    state = by_site.agg((F.count(F.lit(1)) == sites).alias("roster"), F.coalesce(F.bool_and((F.col("n") == size) & (F.col("d") == size) & (F.col("g") == size)), F.lit(False)).alias("whole"))
    state = state.select((F.col("roster") & F.col("whole")).alias("available"))
    sums = vectors.where(good).groupBy("coord").agg(F.sum(x).alias("value"))
    layout = vectors.sparkSession.range(size).select(F.col("id").cast("int").alias("coord"))
    # one row, so the product has `size` rows
    return layout.join(sums, "coord", "left").crossJoin(F.broadcast(state)).select("coord", F.when(F.col("available"), F.col("value")).alias("value"), "available")


def pooled_noise(sigmas: DataFrame) -> DataFrame:
    """The standard deviation of the sum of independent noises; null unless every one is positive and finite."""
    s = F.col("sigma")
    ok = F.bool_and(s.isNotNull() & ~F.isnan(s) & (s > 0) & (s != F.lit(float("inf"))))
    return sigmas.agg(F.when(ok, F.sqrt(F.sum(s * s))).alias("noise_sd_pooled"))


def accumulated_folds(vectors: DataFrame, folds: int) -> DataFrame:
    """Out-of-fold vectors (fold, coord, value) added up over folds 1 .. folds; null unless each fold is there."""
    n = vectors.agg(F.count_distinct("fold").alias("n")).select((F.col("n") == folds).alias("available"))
    return vectors.groupBy("coord").agg(F.sum("value").alias("value")).crossJoin(F.broadcast(n)).select("coord", F.when(F.col("available"), F.col("value")).alias("value"), "available")


class FederatedMean:
    """The unweighted mean of sites' model arrays, and server optimisers on it. Models are small and on the driver."""

    def __init__(self, strategy: str = "fedavg", rate: float = 0.1, beta_1: float = 0.9, beta_2: float = 0.99, tau: float = 1e-3, momentum: float = 0.0, server_rate: float = 1.0) -> None:
        if strategy not in ("fedavg", "fedavgm", "fedadam", "fedadagrad", "fedyogi"):
            raise ValueError(f"no such strategy: {strategy}")
        self.strategy, self.rate, self.b1, self.b2, self.tau, self.momentum, self.server_rate = strategy, rate, beta_1, beta_2, tau, momentum, server_rate
        self.m: list[np.ndarray] | None = None
        self.v: list[np.ndarray] | None = None

    def step(self, current: list[np.ndarray], updates: list[list[np.ndarray]], sites: int) -> list[np.ndarray]:
        """The next model; every site must have sent one."""
        if len(updates) != sites:
            raise ValueError("the roster is not complete")
        mean = [np.mean(a, axis=0) for a in zip(*updates, strict=True)]
        if self.strategy == "fedavg":
            return mean
        delta = [a - b for a, b in zip(mean, current, strict=True)]
        self.m = self.m or [np.zeros_like(d) for d in delta]
        if self.strategy == "fedavgm":
            self.m = [self.momentum * m + d for m, d in zip(self.m, delta, strict=True)]
            return [c + self.server_rate * m for c, m in zip(current, self.m, strict=True)]
        self.v = self.v or [np.full_like(d, self.tau**2) for d in delta]
        keep = 0.0 if self.strategy == "fedadagrad" else self.b1
        self.m = [keep * m + (1 - keep) * d for m, d in zip(self.m, delta, strict=True)]
        square = [d * d for d in delta]
        if self.strategy == "fedadagrad":
            self.v = [v + s for v, s in zip(self.v, square, strict=True)]
        elif self.strategy == "fedadam":
            self.v = [self.b2 * v + (1 - self.b2) * s for v, s in zip(self.v, square, strict=True)]
        else:
            self.v = [v - (1 - self.b2) * s * np.sign(v - s) for v, s in zip(self.v, square, strict=True)]
        return [c + self.rate * m / (np.sqrt(v) + self.tau) for c, m, v in zip(current, self.m, self.v, strict=True)]
