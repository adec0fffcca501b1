"""Linear and logistic models by private gradient steps, and private validation of scores.

A step is one pass: keyed Poisson sampling, clipped per-unit gradients as expressions, one fixed-point sum of features + 1
coordinates; the driver adds the noise, averages over the expected batch and moves the weights by an optimiser and a schedule.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..functions.models import sigmoid
from .privacy import release

_FIX = float(1 << 30)


def learning_rate(base: float, epoch: int, epochs: int, schedule: str = "none", gamma: float = 0.5, every: int = 1) -> float:
    return {
        "none": base,
        "step": base * gamma ** (epoch // every),
        "exponential": base * gamma**epoch,
        "cosine": base * 0.5 * (1 + math.cos(math.pi * epoch / max(1, epochs))),
    }[schedule]


class Optimiser:
    """sgd (momentum, nesterov), adam, adamw or rmsprop, with L2 decay and an L1 proximal step."""

    def __init__(self, kind: str = "sgd", momentum: float = 0.0, nesterov: bool = False, l2: float = 0.0, l1: float = 0.0) -> None:
        if kind not in ("sgd", "adam", "adamw", "rmsprop"):
            raise ValueError(f"no such optimiser: {kind}")
        self.kind, self.momentum, self.nesterov, self.l2, self.l1 = kind, momentum, nesterov, l2, l1
        self.m = self.v = np.zeros(1)
        self.t = 0

    def step(self, w: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        if self.kind != "adamw":
            g = g + self.l2 * w
        if self.kind == "sgd":
            self.m = self.momentum * self.m + g
            move = g + self.momentum * self.m if self.nesterov else self.m
        elif self.kind == "rmsprop":
            self.v = 0.99 * self.v + 0.01 * g * g
            move = g / (np.sqrt(self.v) + 1e-8)
        else:
            self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
            move = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
            move = move + (self.l2 * w if self.kind == "adamw" else 0)
        w = w - rate * move
        return np.sign(w) * np.maximum(np.abs(w) - self.l1 * rate, 0)


def score(features: list[str], w: np.ndarray) -> Column:
    out = F.lit(float(w[-1]))
    for f, v in zip(features, w, strict=False):
        out = out + F.col(f) * float(v)
    return out


def gradient_sum(rows: DataFrame, features: list[str], w: np.ndarray, task: str, clip: float) -> np.ndarray:
    """The sum of gradients, each clipped to `clip` in L2 norm: one aggregation of fixed-point terms."""
    z = score(features, w)
    residual = (sigmoid(z) if task == "binary" else z) - F.col("y")
    one = [*(residual * F.col(f) for f in features), residual]
    norm = F.sqrt(sum((g * g for g in one), F.lit(0.0)))
    shrink = F.when(norm > clip, F.lit(clip) / norm).otherwise(F.lit(1.0))
    safe = rows.select(*[F.nanvl(g * shrink, F.lit(0.0)).alias(f"g{k}") for k, g in enumerate(one)])
    sums = safe.agg(*[F.coalesce(F.sum(F.rint(F.col(f"g{k}") * _FIX).cast("long").cast("decimal(38,0)")), F.lit(0)).cast("double").alias(f"g{k}") for k in range(len(one))]).first()
    return np.array([sums[k] / _FIX for k in range(len(one))])


def fit(rows: DataFrame, features: list[str], task: str, key: bytes, secret: bytes, units: int, steps: int = 20, noise: float = 0.0, clip: float = 1.0, rate: float = 0.5, optimiser: Optimiser | None = None, schedule: str = "none", sample: bool = True) -> np.ndarray:
    """Weights and the bias, last. rows: unit, y and features on the unit interval, one row for each unit. Each unit is in each step with
    chance 1 / steps; without noise (multiplier 0) the result must not leave the site."""
    w, optimiser = np.zeros(len(features) + 1), optimiser or Optimiser()
    expected = max(1.0, units / steps if sample else units)
    for t in range(steps):
        part = rows.where(keyed.in_step(key, F.col("unit"), F.lit(t), steps)) if sample else rows
        total = gradient_sum(part, features, w, task, clip)
        if noise > 0:
            total = release(total, noise * clip, secret, "gradient", {"step": t, "weights": w.tolist()})
        w = optimiser.step(w, total / expected, learning_rate(rate, t, steps, schedule))
    return np.clip(w, -1e6, 1e6)
