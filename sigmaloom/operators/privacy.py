"""Noise for a release: calibration, keyed replay-stable streams, samplers, budgets and the replay guard.

Vectors of floating point are small and on the driver; integer sums may stay where they lie (`release_cells`). A stream is a function of the site's secret, the mechanism and the exact
vector: asking again gives the same answer, another vector gives independent noise. Gaussian noise of floating point is not
an exact Gaussian; the discrete sampler is exact. Workers and logs see raw data: the curator is trusted.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import os
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of a policy.
MAX_EPSILON, MAX_DELTA, MAX_CLIP = 10.0, 1e-3, 100.0


def check_policy(epsilon: float = 1.0, delta: float = 1e-6, clip: float = 1.0) -> tuple[float, float, float]:
    if not (0 < epsilon <= MAX_EPSILON and 0 < delta <= MAX_DELTA and 0 < clip <= MAX_CLIP):
        raise ValueError("epsilon, delta or the clipping norm is outside its limits")
    return float(epsilon), float(delta), float(clip)


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float, releases: int = 1) -> float:
    """The deviation of each of `releases` Gaussian releases by Renyi composition in closed form, rounded up."""
    if not (epsilon > 0 and 0 < delta < 1 and sensitivity > 0 and releases >= 1 and math.isfinite(epsilon + sensitivity)):
        raise ValueError("no such budget")
    log = 2 * math.log(1 / delta)
    z = 2 * epsilon / (math.sqrt(log + 2 * epsilon) + math.sqrt(log))
    return math.nextafter(sensitivity * math.sqrt(releases) / z * (1 + 1e-12), math.inf)


def sensitivity(task: str, classes: int = 2, labels: int = 1) -> float:
    """The L2 sensitivity of a validation vector when one unit is replaced."""
    return {"association": math.sqrt(2), "binary": math.sqrt(2), "multiclass": math.sqrt(2 * (classes + 1)), "ordinal": math.sqrt(2 * (classes + 1)), "multilabel": math.sqrt(2 * labels), "regression": 2.0, "count": math.sqrt(5)}[task]


def sensitivity_with_absence(task: str, size: int, classes: int = 2, labels: int = 1) -> float:
    """For subjects that may be on neither side of a holdout: a unit may also vanish."""
    absent = {"binary": 1.0, "multiclass": math.sqrt(classes + 1), "ordinal": math.sqrt(classes + 1), "multilabel": math.sqrt(labels)}.get(task, math.sqrt(size))
    return max(sensitivity(task, classes, labels), absent)


def forest_releases(kind: str, task: str, trees: int, depth: int, max_features: int = 1) -> dict[str, float]:
    """Sensitivities and the number of releases of a forest: complete random trees in one, adaptive disjoint trees in depth + 1."""
    root = math.sqrt(2.0) if task == "binary" else 2.0
    if kind == "extra_trees":
        return {"leaf": root * math.sqrt(trees), "releases": 1}
    return {"level": root * math.sqrt(max_features), "leaf": root, "releases": depth + 1}


def boosting_sensitivity(features: int, g_clip: float, h_clip: float) -> float:
    g, h = g_clip**2, h_clip**2
    return math.sqrt(features * max(2 * (g + h + 1), 4 * g + h))


def boosting_releases(kind: str, trees: int, leaves: int = 2, depth: int = 1) -> int:
    return trees * (leaves - 1 if kind == "leafwise" else depth)


def _root_up(x: Fraction) -> int:
    n = -(-x.numerator // x.denominator)
    r = math.isqrt(n)
    return r if r * r == n else r + 1


def discrete_allocation(epsilon: Fraction, delta: Fraction, trees: int, depth: int, features: int, task: str, scale: int) -> dict[str, object]:
    """Zero-concentrated budget of depth-wise boosting, in exact arithmetic: rho in all and a level, and the integer
    sensitivity and deviation of a root and of another level."""
    bits = 0
    while Fraction(1, 1 << bits) > delta:
        bits += 1
    rho = epsilon**2 / (4 * (bits + epsilon))
    level = rho / (trees * depth)
    out: dict[str, object] = {"rho": rho, "rho_level": level}
    for name, groups in (("root", features + 1), ("level", features)):
        d = _root_up(Fraction((5 if task == "binary" else 4) * groups * scale * scale))
        out[f"sensitivity_{name}"], out[f"sigma_{name}"] = d, _root_up(Fraction(math.ceil(Fraction(d * d) / (2 * level))))
    return out


def zcdp_rho(epsilon: float, delta: float) -> float:
    """The rho whose usual conversion gives epsilon at delta."""
    log = math.log(1 / delta)
    return (epsilon / (math.sqrt(log + epsilon) + math.sqrt(log))) ** 2


def replace_one_budget(epsilon: float, delta: float) -> tuple[float, float]:
    """The add-or-remove budget of which two steps make a replacement within (epsilon, delta)."""
    return epsilon / 2, delta / (1 + math.exp(epsilon / 2))


def sampled_gaussian_epsilon(q: float, noise: float, steps: int, delta: float, orders: Sequence[int] = tuple(range(2, 129))) -> float:
    """Upper bound on epsilon of `steps` Poisson-sampled Gaussian steps, by Renyi differential privacy at integer orders."""
    best = math.inf
    for a in orders:
        if q >= 1:
            rdp = a / (2 * noise**2)
        else:
            terms = [math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1) + k * math.log(q) + (a - k) * math.log1p(-q) + k * (k - 1) / (2 * noise**2) for k in range(a + 1)]
            top = max(terms)
            rdp = (top + math.log(sum(math.exp(t - top) for t in terms))) / (a - 1)
        best = min(best, steps * rdp + math.log1p(-1 / a) - math.log(delta * a) / (a - 1))
    return best


def sgd_noise(epsilon: float, delta: float, q: float, steps: int) -> float:
    """The noise multiplier of sampled gradient steps for a replace-one budget; raises ValueError if none up to 10 000 does."""
    e0, d0 = replace_one_budget(epsilon, delta)
    low, high = 0.05, 0.1
    while sampled_gaussian_epsilon(q, high, steps, d0) > e0:
        low, high = high, 2 * high
        if high > 10_000:
            raise ValueError("no noise meets this budget")
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sampled_gaussian_epsilon(q, mid, steps, d0) > e0 else (low, mid)
    return high


def semantic_seed(secret: bytes, *parts: object) -> bytes:
    """HMAC of a digest over length-framed parts; dicts as canonical JSON, arrays with their type and shape."""
    digest = hashlib.sha256()
    for p in parts:
        if isinstance(p, np.ndarray):
            p = f"{p.dtype.str}{p.shape}".encode() + np.ascontiguousarray(p).tobytes()
        elif not isinstance(p, bytes):
            p = json.dumps(p, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()
        digest.update(len(p).to_bytes(8, "big") + p)
    return hmac.new(secret, digest.digest(), hashlib.sha256).digest()


def sub_seed(seed: bytes, label: str) -> bytes:
    return hmac.new(seed, label.encode(), hashlib.sha256).digest()


class KeyedStream:
    """Random numbers from HMAC-SHA256 in counter mode."""

    def __init__(self, seed: bytes) -> None:
        self.seed, self.counter, self.held = seed, 0, b""

    def take(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            parts.append(hmac.new(self.seed, self.counter.to_bytes(16, "big"), hashlib.sha256).digest())
            self.counter, size = self.counter + 1, size + 32
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def below(self, n: int) -> int:
        size = (n.bit_length() + 7) // 8 + 8
        limit = (1 << 8 * size) // n * n
        while (v := int.from_bytes(self.take(size), "big")) >= limit:
            pass
        return v % n

    def uniform(self, n: int) -> np.ndarray:
        """In (0, 1], of 53 bits."""
        return ((np.frombuffer(self.take(8 * n), ">u8") >> np.uint64(11)).astype(float) + 1) / (1 << 53)

    def normal(self, n: int) -> np.ndarray:
        """Means of four Box-Muller draws, scaled to unit variance."""
        u = self.uniform(8 * n).reshape(2, 4, n)
        return (np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])).sum(0) / 2

    def bernoulli(self, p: Fraction) -> bool:
        return self.below(p.denominator) < p.numerator

    def bernoulli_exp(self, x: Fraction) -> bool:
        """True with chance exp(-x), x 0 or more, exactly."""
        while x > 1:
            if not self.bernoulli_exp(Fraction(1)):
                return False
            x -= 1
        k = 1
        while self.bernoulli(x / k):
            k += 1
        return k % 2 == 1

    def discrete_laplace(self, t: int) -> int:
        while True:
            u = self.below(t)
            if not self.bernoulli_exp(Fraction(u, t)):
                continue
            v = 0
            while self.bernoulli_exp(Fraction(1)):
                v += 1
            x, negative = u + t * v, self.below(2) == 1
            if not (negative and x == 0):
                return -x if negative else x

    def discrete_gaussian(self, sigma: int) -> int:
        """Exact discrete Gaussian by rejection from a discrete Laplace."""
        t = sigma + 1
        while True:
            y = self.discrete_laplace(t)
            if self.bernoulli_exp((abs(y) - Fraction(sigma * sigma, t)) ** 2 / (2 * sigma * sigma)):
                return y

    def permutation(self, n: int) -> list[int]:
        out = list(range(n))
        for i in range(n - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


def release(vector: Sequence[float], sigma: float, secret: bytes, mechanism: str, layout: dict) -> np.ndarray:
    """The vector with Gaussian noise that is bound to (secret, mechanism, layout, sigma, vector)."""
    exact = np.asarray(vector, "<f8")
    if not np.isfinite(exact).all() or not sigma > 0:
        raise ValueError("the vector or its noise is not finite")
    seed = semantic_seed(secret, mechanism, layout, repr(float(sigma)), exact)
    return exact + sigma * KeyedStream(sub_seed(seed, "noise")).normal(len(exact))


def release_integers(vector: Sequence[int], sigma: int, secret: bytes, mechanism: str, layout: dict) -> list[int]:
    """Exact discrete Gaussian noise, saturating at 64 bits; that of a coordinate follows from the binding and its place alone."""
    seed = sub_seed(semantic_seed(secret, mechanism, layout, int(sigma), np.asarray(vector, "<i8")), "noise")
    out: list[int] = []
    for lo in range(0, len(vector), LANES_AT_ONCE):
        part = vector[lo : lo + LANES_AT_ONCE]
        noise = discrete_gaussians(seed, np.arange(lo, lo + len(part)), sigma)
        out += [_saturated(int(v) + x) for v, x in zip(part, noise, strict=True)]
    return out


class Lanes:
    """64-bit words of a stream for each coordinate: the words of coordinate i follow from the seed and i alone, so noise does not depend on
    how coordinates are grouped or ordered."""

    WORDS = 32

    def __init__(self, seed: bytes, coords: np.ndarray) -> None:
        self.seed, self.coords = seed, [int(c).to_bytes(8, "big", signed=True) for c in coords.tolist()]
        self.words = np.zeros((len(coords), 0), np.uint64)
        self.at = np.zeros(len(coords), np.int64)

    def take(self, lanes: np.ndarray) -> np.ndarray:
        """The next word of each of the given, distinct, lanes."""
        while len(lanes) and int(self.at[lanes].max()) >= self.words.shape[1]:
            block = (self.words.shape[1] // self.WORDS).to_bytes(8, "big")
            more = b"".join([hashlib.shake_128(self.seed + block + c).digest(8 * self.WORDS) for c in self.coords])
            self.words = np.concatenate([self.words, np.frombuffer(more, ">u8").astype(np.uint64).reshape(-1, self.WORDS)], 1)
        out = self.words[lanes, self.at[lanes]]
        self.at[lanes] += 1
        return out

    def below(self, lanes: np.ndarray, n: int) -> np.ndarray:
        """Uniform integers below n, 1 to 2^62."""
        out, limit, left = np.zeros(len(lanes), np.int64), (1 << 64) // n * n, np.arange(len(lanes))
        while len(left):
            w = self.take(lanes[left])
            fine = np.ones(len(left), bool) if limit == 1 << 64 else w < np.uint64(limit)
            out[left[fine]] = (w[fine] % np.uint64(n)).astype(np.int64)
            left = left[~fine]
        return out

    def bernoulli(self, lanes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """True with chance p / q of Python integers, p from 0 to q, exactly: a word is compared with the first 64 bits of the
        fraction, and where they are equal the next one with the next bits."""
        out, left = np.zeros(len(lanes), bool), np.arange(len(lanes))
        p, q = np.asarray(p, object), np.asarray(q, object)
        sure = np.array(p >= q, bool)
        out[sure] = True
        left = left[~sure]
        while len(left):
            scaled = p[left] << 64
            first, rest = scaled // q[left], scaled % q[left]
            w, first = self.take(lanes[left]), first.astype(np.uint64)
            out[left] = w < first
            tied = w == first
            p[left[tied]] = rest[tied]
            left = left[tied]
        return out

    def exp_of_fraction(self, lanes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """True with chance exp(-p / q), p from 0 to q: whether the first failure of draws at p / (q k), k = 1, 2, ..., has an odd k."""
        out, left, k = np.zeros(len(lanes), bool), np.arange(len(lanes)), 1
        p, q = np.asarray(p, object), np.asarray(q, object)
        while len(left):
            went_on = self.bernoulli(lanes[left], p[left], q[left] * k)
            out[left[~went_on]] = k % 2 == 1
            left, k = left[went_on], k + 1
        return out

    def exp(self, lanes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """True with chance exp(-p / q) for any p from 0 on."""
        p, q = np.asarray(p, object), np.asarray(q, object)
        whole, out, left = p // q, np.ones(len(lanes), bool), np.arange(len(lanes))
        turn = 0
        while len(left := left[np.array(whole[left] > turn, bool)]):
            one = np.ones(len(left), object)
            out[left] = self.exp_of_fraction(lanes[left], one, one)
            left, turn = left[out[left]], turn + 1
        alive = np.flatnonzero(out)
        out[alive] = self.exp_of_fraction(lanes[alive], (p % q)[alive], q[alive])
        return out

    def laplace(self, lanes: np.ndarray, t: int) -> np.ndarray:
        """Discrete Laplace values of scale t."""
        out, left = np.zeros(len(lanes), object), np.arange(len(lanes))
        while len(left):
            u = self.below(lanes[left], t).astype(object)
            fine = self.exp_of_fraction(lanes[left], u, np.full(len(left), t, object))
            here, u = left[fine], u[fine]
            v, on = np.zeros(len(here), object), np.arange(len(here))
            while len(on):
                one = np.ones(len(on), object)
                on = on[self.exp_of_fraction(lanes[here[on]], one, one)]
                v[on] += 1
            x = u + t * v
            negative = self.below(lanes[here], 2) == 1
            kept = ~(negative & np.array(x == 0, bool))
            out[here[kept]] = np.where(negative, -x, x)[kept]
            left = np.concatenate([left[~fine], here[~kept]])
        return out


def discrete_gaussians(seed: bytes, coords: np.ndarray, sigma: int) -> np.ndarray:
    """An exact discrete Gaussian for each distinct coordinate, by rejection from discrete Laplace values, in steps over all of them."""
    lanes, t = Lanes(seed, np.asarray(coords, np.int64)), int(sigma) + 1
    out, left, square = np.zeros(len(coords), object), np.arange(len(coords)), int(sigma) ** 2
    while len(left):
        y = lanes.laplace(left, t)
        gap = abs(y) * t - square
        fine = lanes.exp(left, gap * gap, np.full(len(left), 2 * square * t * t, object))
        out[left[fine]] = y[fine]
        left = left[~fine]
    return out


def _saturated(x: object) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def release_cells(cells: DataFrame, sigma: int, secret: bytes, mechanism: str, layout: dict) -> DataFrame:
    """coord, value: exact integer sums of a public layout, a row for each coordinate, with exact discrete Gaussian noise, where they lie. The
    noise is bound to (secret, mechanism, layout, sigma, all cells): the binding is the exclusive or of keyed digests of the cells, so it
    is the same in any partitioning and order. A coordinate that is null or comes twice raises ValueError; a null value counts as 0."""
    import pyarrow as pa

    from ..functions import keyed
    from ..sources import store

    total = store.staged(cells.select(F.col("coord").cast("long").alias("coord"), F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value")), "cells")
    digest = keyed.hmac_hex(sub_seed(secret, f"cells/{mechanism}"), F.concat_ws(":", "coord", "value"))
    part = lambda k: F.coalesce(F.bit_xor(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")), F.lit(0)).alias(f"d{k}")
    bound = total.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("coord").alias("distinct"), *map(part, range(4))).first()
    if bound["n"] != bound["distinct"]:
        raise ValueError("a coordinate is null or comes twice")
    seed = sub_seed(semantic_seed(secret, mechanism, layout, int(sigma), [bound["n"], *(bound[f"d{k}"] for k in range(4))]), "noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coord, value = (batch.column(k).to_numpy() for k in (0, 1))
            for lo in range(0, len(coord), LANES_AT_ONCE):
                part = slice(lo, lo + LANES_AT_ONCE)
                noise = discrete_gaussians(seed, coord[part], sigma)
                yield pa.RecordBatch.from_arrays([pa.array(coord[part]), pa.array([_saturated(v + x) for v, x in zip(value[part].tolist(), noise, strict=True)], pa.int64())], names=["coord", "value"])

    return total.mapInArrow(run, "coord bigint, value bigint")


#: Coordinates whose noise is drawn in one step: their words take 8 MB or a little more.
LANES_AT_ONCE = 32_768


def project_to_simplex(x: np.ndarray, total: float) -> np.ndarray:
    """The nearest point with no negative coordinate and the given sum."""
    if total <= 0:
        return np.zeros_like(x)
    down = np.sort(x)[::-1]
    over = (down.cumsum() - total) / np.arange(1, len(x) + 1)
    return np.maximum(x - over[np.flatnonzero(down > over)[-1]], 0)


def clipped(update: np.ndarray, norm: float) -> np.ndarray:
    """At most `norm` long; not finite: zero."""
    update = np.asarray(update, float)
    if not np.isfinite(update).all():
        return np.zeros_like(update)
    size = float(np.linalg.norm(update))
    return update if size <= norm else update * (norm / size)


def perturbed_output(update: np.ndarray, norm: float, epsilon: float, delta: float, secret: bytes, label: str) -> np.ndarray:
    return release(clipped(update, norm).ravel(), gaussian_sigma(epsilon, delta, 2 * norm), secret, "output", {"label": label}).reshape(np.shape(update))


def sample_and_aggregate(updates: list[np.ndarray], norm: float, epsilon: float, delta: float, secret: bytes, label: str) -> np.ndarray:
    """The mean of block updates, each clipped; one unit moves it by min(2 norm, 4 norm / blocks)."""
    mean = np.mean([clipped(u, norm).ravel() for u in updates], axis=0)
    return release(mean, gaussian_sigma(epsilon, delta, min(2 * norm, 4 * norm / len(updates))), secret, "blocks", {"label": label}).reshape(np.shape(updates[0]))


def holdout_budget(epsilon: float, delta: float) -> dict[str, tuple[float, float]]:
    return {"train": (0.8 * epsilon, 0.8 * delta), "test": (0.2 * epsilon, 0.2 * delta)}


def fold_budget(epsilon: float, delta: float, folds: int) -> dict[str, tuple[float, float]]:
    return {"fold": (0.8 * epsilon / folds, 0.8 * delta / folds), "out_of_fold": (0.2 * epsilon, 0.2 * delta)}


class ReplayGuard:
    """One answer for each operation, fold and round: the same request is replayed, another one under the same name is refused before
    any data are read. With a folder, claims and answers are files there and outlive the process: a claim is made by exclusive
    creation, so of two processes one answers; an answer is written whole and then named. A claim whose process ended before it
    answered is answered again for the same request only, with the same noise, as that follows from secret and vector."""

    def __init__(self, folder: str | None = None) -> None:
        self.seen: dict[tuple, tuple[str, object]] = {}
        self.folder = folder
        if folder:
            os.makedirs(folder, exist_ok=True)

    def claim(self, operation: str, fold: int, round_: int, request: object, answer: Callable[[], object]) -> object:
        name, digest = (operation, fold, round_), hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()
        if self.folder:
            return self._claim_file(name, digest, answer)
        if name in self.seen and self.seen[name][0] != digest:
            raise ValueError("this round was answered for another request")
        if name not in self.seen:
            self.seen[name] = (digest, answer())
        return self.seen[name][1]

    def _claim_file(self, name: tuple, digest: str, answer: Callable[[], object]) -> object:
        path = os.path.join(self.folder, hashlib.sha256(json.dumps(name).encode()).hexdigest())
        temporary = f"{path}.{os.getpid()}.{id(answer)}"
        with open(temporary, "w") as f:
            f.write(digest)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, path + ".claim")  # exclusive, and never half written
        except FileExistsError:
            with open(path + ".claim") as f:
                if f.read() != digest:
                    raise ValueError("this round was answered for another request") from None
        finally:
            os.unlink(temporary)
        try:
            with open(path + ".json") as f:
                return json.load(f)
        except FileNotFoundError:
            text = json.dumps(answer(), sort_keys=True, separators=(",", ":"), allow_nan=False)
        with open(temporary, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path + ".json")
        return json.loads(text)
