"""Training of declarative networks by reverse mode, with clipped gradients of units.

A network is a list of layers or a graph of nodes, as `functions.models.build` and `build_graph` evaluate it; the same rules hold here,
in NumPy over Arrow batches: every node's output is made finite. Each node has an adjoint, and one pass back over the nodes gives, for every
unit, the gradient of the loss at each linear layer's output.

A unit's gradient of a linear layer is the outer product of that and the layer's input, so its norm is the product of two norms, and the
sum of clipped gradients is one matrix product: no unit's gradient is ever written out, and a batch needs memory for its activations only.
A step is one scan of the sampled units. Both factors of a product are cut to a grid, towards zero, so that no norm grows and sums of up to ROWS
products are exact in doubles, whatever their order; further sums are of integers. So the sum, and with it the noise that is bound to it, does not
depend on batches or partitions (but for an activation that two shapes of the same matrix product round to different sides of a
grid line). The coordinates are summed with map-side combination. Parameters, MOST_PARAMETERS at most, and their noise are on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed, models
from ..functions.clean import FEATURE_LIMIT, LOGIT_LIMIT
from . import privacy
from .linear import Optimiser, learning_rate

#: Numbers of a batch's activations in one node, and rows of a batch. Bits of the grids of slopes and activations: ROWS gradients of length
#: privacy.MAX_CLIP add up to less than 2^19, and 19 + 18 + 16 is 53.
AT_ONCE, ROWS, GRID = 1 << 21, 4096, (18, 16)
MOST_PARAMETERS = models.MOST_PARAMETERS
_FIX = float(1 << sum(GRID))


def _finite(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """x with NaN as 0 and clamped, and where its slope is 1."""
    inside = np.abs(x) <= limit  # false for NaN
    return np.clip(np.nan_to_num(x, nan=0.0, posinf=limit, neginf=-limit), -limit, limit), inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _gelu(x: np.ndarray) -> np.ndarray:
    a = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    # fixed values: coefficients of the approximation
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-a * a)
    return 0.5 * x * (1 + np.where(x < 0, -erf, erf))


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    at = np.where(np.abs(x) > 1e-12, _gelu(x) / np.where(np.abs(x) > 1e-12, x, 1.0), 0.5)
    return at + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


#: Value and slope of each activation, by its input and output.
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "relu": (lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float)),
    "tanh": (np.tanh, lambda x, y: 1 - y * y),
    "sigmoid": (_sigmoid, lambda x, y: y * (1 - y)),
    "elu": (lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), lambda x, y: np.where(x > 0, 1.0, y + 1)),
    "silu": (lambda x: x * _sigmoid(x), lambda x, y: _sigmoid(x) * (1 + x * (1 - _sigmoid(x)))),
    "gelu": (_gelu, lambda x, y: _gelu_slope(x)),
    "dropout": (lambda x: x, lambda x, y: np.ones_like(x)),
}


def _divisor(b: np.ndarray) -> np.ndarray:
    return np.where(np.abs(b) >= 1e-6, b, np.where(b < 0, -1e-6, 1e-6))


@dataclass
class _Node:
    name: str
    op: dict
    sources: list[str]
    width: int
    at: int = -1  # of a linear layer: the place of its first weight


class Network:
    """Nodes with their widths, and the layout of their parameters in one vector. spec: a list of layers on the input `x`, or of nodes with
    `name` and `from`. A linear layer has `weights` and `bias`, or a `width` and parameters that a public seed starts."""

    def __init__(self, spec: list[dict], width: int, loss: str, classes: int = 2, seed: bytes = b"public") -> None:
        self.loss, self.classes, self.inputs = loss, classes, width
        self.out = models.loss_width(loss, classes)
        self.limit = FEATURE_LIMIT if loss in ("mse", "huber", "quantile") else LOGIT_LIMIT
        if not spec or not 1 <= width <= models.MOST_WIDTH or len(spec) > models.MOST_LAYERS:
            raise ValueError("the network is empty or too large")
        graph = [{"name": f"layer {k}", "from": ["x" if not k else f"layer {k - 1}"]} | op for k, op in enumerate(spec)]
        self.nodes: list[_Node] = []
        widths, self.size, starts = {"x": width}, 0, []
        for k, op in enumerate(graph):
            name, sources = op["name"], op["from"]
            if name in widths or not sources or len(sources) > models.MOST_INPUTS or any(s not in widths for s in sources):
                raise ValueError("a node has a name twice, or takes from one that is not before it")
            node = _Node(name, op, sources, 0)
            node.width = self._width(op, [widths[s] for s in sources], last=k == len(graph) - 1)
            if op["op"] == "linear":
                node.at, fan = self.size, widths[sources[0]]
                self.size += node.width * (fan + 1)
                if self.size > MOST_PARAMETERS:
                    raise ValueError("the network has too many parameters")
                starts.append((node, fan))
            widths[name] = node.width
            self.nodes.append(node)
        if self.nodes[-1].width != self.out:
            raise ValueError(f"the loss needs {self.out} outputs")
        self.start = np.zeros(self.size)
        for node, fan in starts:
            if "weights" in node.op:
                w, b = np.array(node.op["weights"], float), np.array(node.op.get("bias") or [0.0] * node.width, float)
            else:
                u = privacy.KeyedStream(privacy.semantic_seed(seed, "network", node.name, node.width, fan)).uniform(node.width * (fan + 1))
                w, b = np.split((2 * u - 1) / math.sqrt(fan), [node.width * fan])
            self.start[node.at : node.at + node.width * (fan + 1)] = np.concatenate([w.ravel(), b.ravel()])
        self.widths = widths

    def _width(self, op: dict, sources: list[int], last: bool) -> int:
        kind = op["op"]
        if kind == "matmul":
            n, k, m = op["n"], op["k"], op["m"]
            if len(sources) != 2 or sources != [n * k, k * m] or n * m > models.MOST_WIDTH:
                raise ValueError("a product does not fit its inputs")
            return n * m
        if kind in models.JOINS or kind == "concat":
            if kind != "concat" and len(set(sources)) != 1:
                raise ValueError("inputs of different widths")
            return models.checked_width(sum(sources) if kind == "concat" else sources[0])
        if len(sources) != 1:
            raise ValueError("a layer takes from one node")
        if kind == "linear" and "weights" not in op:
            return models.checked_width(self.out if op["width"] == "out" else int(op["width"]))
        return models.output_width([op], sources[0])

    def arrays(self, parameters: np.ndarray, node: _Node) -> tuple[np.ndarray, np.ndarray]:
        fan = self.widths[node.sources[0]]
        part = parameters[node.at : node.at + node.width * (fan + 1)]
        return part[: node.width * fan].reshape(node.width, fan), part[node.width * fan :]

    def forward(self, parameters: np.ndarray, x: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """The output of every node for rows x, and where each is inside its bounds."""
        at, inside = {"x": x}, {}
        for node in self.nodes:
            limit = self.limit if node is self.nodes[-1] else FEATURE_LIMIT
            with np.errstate(all="ignore"):
                at[node.name], inside[node.name] = _finite(self._value(parameters, node, [at[s] for s in node.sources]), limit)
        return at, inside

    def _value(self, parameters: np.ndarray, node: _Node, x: list[np.ndarray]) -> np.ndarray:
        op, kind, a = node.op, node.op["op"], x[0]
        if kind == "linear":
            w, b = self.arrays(parameters, node)
            return a @ w.T + b
        if kind == "affine":
            return a * float(op.get("scale", 1.0)) + float(op.get("shift", 0.0))
        if kind == "layernorm":
            return (a - a.mean(1, keepdims=True)) / np.sqrt(a.var(1, keepdims=True) + 1e-5)
        if kind == "softmax":
            e = np.exp(a - a.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)
        if kind == "transpose":
            return a.reshape(-1, *op["shape"]).transpose(0, 2, 1).reshape(len(a), -1)
        if kind == "leaky_relu":
            return np.where(a > 0, a, float(op.get("negative_slope", 0.01)) * a)
        if kind in ACTIVATIONS:
            return ACTIVATIONS[kind][0](a)
        if kind == "matmul":
            return np.einsum("rnk,rkm->rnm", a.reshape(-1, op["n"], op["k"]), x[1].reshape(-1, op["k"], op["m"])).reshape(len(a), -1)
        if kind == "concat":
            return np.concatenate(x, 1)
        for other in x[1:]:
            a = a + other if kind == "add" else a - other if kind == "sub" else a * other if kind == "mul" else a / _divisor(other)
            a = _finite(a, FEATURE_LIMIT)[0] if kind in models.JOINS else a
        return a

    def _adjoint(self, parameters: np.ndarray, node: _Node, x: list[np.ndarray], y: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """The gradient at each source, for one at the node's output."""
        op, kind, a = node.op, node.op["op"], x[0]
        if kind == "linear":
            return [g @ self.arrays(parameters, node)[0]]
        if kind == "affine":
            return [g * float(op.get("scale", 1.0))]
        if kind == "layernorm":
            return [(g - g.mean(1, keepdims=True) - y * (g * y).mean(1, keepdims=True)) / np.sqrt(a.var(1, keepdims=True) + 1e-5)]
        if kind == "softmax":
            return [y * (g - (g * y).sum(1, keepdims=True))]
        if kind == "transpose":
            return [g.reshape(-1, *op["shape"][::-1]).transpose(0, 2, 1).reshape(len(a), -1)]
        if kind == "leaky_relu":
            return [np.where(a > 0, g, float(op.get("negative_slope", 0.01)) * g)]
        if kind in ACTIVATIONS:
            return [g * ACTIVATIONS[kind][1](a, y)]
        if kind == "matmul":
            p, q, r = a.reshape(-1, op["n"], op["k"]), x[1].reshape(-1, op["k"], op["m"]), g.reshape(-1, op["n"], op["m"])
            return [np.einsum("rnm,rkm->rnk", r, q).reshape(len(a), -1), np.einsum("rnk,rnm->rkm", p, r).reshape(len(a), -1)]
        if kind == "concat":
            return np.split(g, np.cumsum([v.shape[1] for v in x])[:-1], axis=1)
        if kind in ("add", "sub"):
            return [g, *[g if kind == "add" else -g for _ in x[1:]]]
        if kind in ("mul", "div"):
            out = []
            for k in range(len(x)):
                rest = np.ones_like(g)
                for j, v in enumerate(x):
                    if j != k:
                        rest = rest * v if kind == "mul" or j == 0 else rest / _divisor(v)
                if kind == "div" and k:
                    d = _divisor(x[k])
                    rest = np.where(np.abs(x[k]) >= 1e-6, -rest / (d * d), 0.0)
                out.append(g * rest)
            return out
        return [g]  # flatten, reshape: arrays are flat

    def gradients(self, parameters: np.ndarray, x: np.ndarray, y: np.ndarray, clip: float, grid: bool = False) -> tuple[np.ndarray, float]:
        """The sum over rows of the loss's gradient, each row's at most `clip` long, and the sum of losses. grid: factors are cut to GRID."""
        cut = (lambda v, bits: np.trunc(v * float(1 << bits)) / float(1 << bits)) if grid else (lambda v, _: v)
        at, inside = self.forward(parameters, x)
        loss, g = loss_and_slope(self.loss, at[self.nodes[-1].name], y, self.classes)
        flows: dict[str, np.ndarray] = {self.nodes[-1].name: g}
        slopes: list[tuple[_Node, np.ndarray]] = []
        square = np.zeros(len(x))
        with np.errstate(all="ignore"):
            for node in reversed(self.nodes):
                g = flows.pop(node.name, None)
                if g is None:
                    continue
                g = np.where(inside[node.name], g, 0.0)
                if node.at >= 0:
                    a = at[node.sources[0]]
                    square += (g * g).sum(1) * ((a * a).sum(1) + 1)
                    slopes.append((node, g))
                for source, back in zip(node.sources, self._adjoint(parameters, node, [at[s] for s in node.sources], at[node.name], g), strict=True):
                    if source != "x":
                        flows[source] = flows[source] + back if source in flows else back
            norm = np.sqrt(square)
            shrink = np.where(np.isfinite(norm), np.minimum(1.0, clip / np.maximum(norm, 1e-300)), 0.0)  # not finite: no gradient
            total = np.zeros(self.size)
            for node, g in slopes:
                g = cut(np.where(shrink[:, None] > 0, g, 0.0) * shrink[:, None], GRID[0])
                fan = self.widths[node.sources[0]]
                total[node.at : node.at + node.width * (fan + 1)] = np.concatenate([(g.T @ cut(at[node.sources[0]], GRID[1])).ravel(), g.sum(0)])
        return total, float(loss.sum())

    def trained(self, parameters: np.ndarray) -> list[dict]:
        """The nodes with these parameters, as `models.build_graph` evaluates them."""
        out = []
        for node in self.nodes:
            op = {k: v for k, v in node.op.items() if k != "width"} | {"name": node.name, "from": node.sources}
            if node.at >= 0:
                w, b = self.arrays(parameters, node)
                op |= {"weights": w.tolist(), "bias": b.tolist()}
            out.append(op)
        return out


def loss_and_slope(loss: str, z: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row and its gradient at the outputs z [rows, outputs]. y: [rows], or [rows, outputs] for multilabel_bce."""
    softplus = lambda v: np.log1p(np.exp(-np.abs(v))) + np.maximum(v, 0)
    if loss == "multilabel_bce":
        return (softplus(z) - z * y).mean(1), (_sigmoid(z) - y) / z.shape[1]
    if loss == "cross_entropy":
        own = (np.arange(classes) == y[:, None]).astype(float)
        top = z.max(1, keepdims=True)
        e = np.exp(z - top)
        return (top[:, 0] + np.log(e.sum(1)) - (z * own).sum(1)), e / e.sum(1, keepdims=True) - own
    if loss == "ordinal":
        above = (y[:, None] > np.arange(classes - 1)).astype(float)
        return (softplus(z) - z * above).mean(1), (_sigmoid(z) - above) / (classes - 1)
    v, r = z[:, 0], y - z[:, 0]
    value, slope = {
        "bce_logits": lambda: (softplus(v) - v * y, _sigmoid(v) - y),
        "mse": lambda: (r * r, -2 * r),
        "huber": lambda: (np.where(np.abs(r) <= 1, 0.5 * r * r, np.abs(r) - 0.5), -np.clip(r, -1, 1)),
        "quantile": lambda: (np.maximum(0.5 * r, -0.5 * r), np.where(r > 0, -0.5, 0.5)),
        "poisson_nll": lambda: (np.exp(v) - y * v, np.exp(v) - y),
        "gamma_nll": lambda: (v + y * np.exp(-v), 1 - y * np.exp(-v)),
    }[loss]()
    return value, slope[:, None]


def gradient_sum(rows: DataFrame, network: Network, parameters: np.ndarray, x: Column, y: Column, clip: float) -> tuple[np.ndarray, int, float]:
    """The sum of clipped gradients, the number of rows and the sum of losses: one scan. x: an array of doubles; rows where it is null or of
    another length have a zero gradient, values that are not finite count as 0."""
    import pyarrow as pa

    if not 0 < clip <= privacy.MAX_CLIP:
        raise ValueError("the clipping norm is outside its limits")
    session, most = rows.sparkSession, max(1, min(ROWS, AT_ONCE // max(network.widths.values())))
    known = session.sparkContext.broadcast((network, np.asarray(parameters, float)))
    many = network.loss == "multilabel_bce"
    empty = F.array_repeat(F.lit(float("nan")), network.inputs)
    safe = F.transform(x.cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    target = F.transform(y.cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))) if many else F.coalesce(F.nanvl(y.cast("double"), F.lit(0.0)), F.lit(0.0))
    fits = F.size(x) == network.inputs
    work = rows.select(F.when(fits, safe).otherwise(empty).alias("x"), (F.when(F.size(y) == network.out, target).otherwise(F.array_repeat(F.lit(0.0), network.out)) if many else target).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, at = known.value
        total, n, loss = np.zeros(net.size, np.int64), 0, 0.0

        def out() -> pa.RecordBatch:
            used = np.flatnonzero(total)
            coord = np.concatenate([used, [net.size, net.size + 1]])
            value = np.concatenate([total[used], [n, round(min(max(loss, -1e12), 1e12) * 1024)]])
            return pa.RecordBatch.from_arrays([pa.array(coord), pa.array(value.astype(np.int64))], names=["coord", "value"])

        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                a = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                b = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) if many else part.column(1).to_numpy()
                whole = ~np.isnan(a).any(1)
                n += part.num_rows
                if whole.any():
                    g, more = net.gradients(at, np.clip(a[whole], -FEATURE_LIMIT, FEATURE_LIMIT), b[whole], clip, grid=True)
                    total += np.rint(g * _FIX).astype(np.int64)
                    loss += more
            if n * clip > 1 << 26:  # sums of a task stay far below 63 bits
                yield out()
                total, n, loss = np.zeros(net.size, np.int64), 0, 0.0
        yield out()

    found = work.mapInArrow(run, "coord bigint, value bigint").groupBy("coord").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value")).toArrow()
    out = np.zeros(network.size + 2)
    out[found.column("coord").to_numpy()] = found.column("value").to_numpy()
    return out[:-2] / _FIX, int(out[-2]), float(out[-1]) / 1024


def predict(df: DataFrame, network: Network, parameters: np.ndarray, features: list[str], keep: list[str]) -> DataFrame:
    """keep and prediction, an array of the outputs, of every row, batch by batch: a graph whose nodes are used again would repeat them in an
    expression. Missing features and those that are not finite count as 0."""
    import pyarrow as pa

    known = df.sparkSession.sparkContext.broadcast((network, np.asarray(parameters, float)))
    safe = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    rows = df.select(*keep, F.array(*safe).alias("_x"))
    most = max(1, AT_ONCE // max(network.widths.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, at = known.value
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                x = np.clip(part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), -FEATURE_LIMIT, FEATURE_LIMIT)
                z = net.forward(at, x)[0][net.nodes[-1].name]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * net.out, pa.int32()), pa.array(z.ravel()))], names=[*keep, "prediction"])

    fields = "".join(f"`{c}` {t}, " for c, t in rows.select(*keep).dtypes) if keep else ""
    return rows.mapInArrow(run, f"{fields}prediction array<double>")


def fit(rows: DataFrame, network: Network, features: list[str], target: str, key: bytes, secret: bytes, units: int, steps: int = 20, epsilon: float | None = None, delta: float | None = None, clip: float = 1.0, rate: float = 0.5, optimiser: Optimiser | None = None, schedule: str = "none", sample: bool = True) -> dict:
    """Trains by private gradient steps. rows: unit, features and target, one row for each unit; each unit is in each step with chance 1 / steps.
    units: their public number. With epsilon and delta the noise of every step follows from the budget and the number of steps, and the same
    call gives the same model; without them the result is exact and must not leave the site. A site without rows sends zeros with the same noise.
    Returns nodes, parameters, and under `release` the budget and the noise multiplier."""
    if (epsilon is None) != (delta is None):
        raise ValueError("a budget has an epsilon and a delta")
    noise = 0.0
    if epsilon is not None:
        privacy.check_policy(epsilon, delta, clip)
        if not secret:
            raise ValueError("a release needs the secret of its site")
        noise = privacy.sgd_noise(epsilon, delta, 1 / steps if sample else 1.0, steps)
    at, optimiser = network.start.copy(), optimiser or Optimiser()
    expected = max(1.0, units / steps if sample else units)
    x = F.array(*[F.col(f).cast("double") for f in features]) if len(features) != 1 or dict(rows.dtypes)[features[0]] == "double" else F.col(features[0])
    for t in range(steps):
        part = rows.where(keyed.in_step(key, F.col("unit"), F.lit(t), steps)) if sample else rows
        total, _, _ = gradient_sum(part, network, at, x, F.col(target), clip)
        if noise:
            total = privacy.release(total, noise * clip, secret, "network", {"step": t, "loss": network.loss, "parameters": privacy.semantic_seed(b"public", at).hex()})
        at = np.clip(optimiser.step(at, total / expected, learning_rate(rate, t, steps, schedule)), -FEATURE_LIMIT, FEATURE_LIMIT)
    out = {"nodes": network.trained(at), "parameters": at.tolist()}
    return out | ({"release": {"epsilon": epsilon, "delta": delta, "noise": noise, "steps": steps}} if noise else {})
