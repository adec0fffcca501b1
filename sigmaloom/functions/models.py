"""Losses, links and activations as expressions; layers over arrays of doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import FEATURE_LIMIT, LOGIT_LIMIT, clamp, saturated


def held(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is evaluated once for a row, however often `use` names it, inside lambdas too."""
    return F.get(F.transform(F.array(x), lambda v: use(v)), F.lit(0))


def softplus(z: Column) -> Column:
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -700, 700)))


def losses(z: Column, y: Column, delta: float = 1.0, tau: float = 0.5, shape: float = 1.0) -> dict[str, Column]:
    """The loss of one output z for a target y, by name. Count models have a log link."""
    r = y - z
    return {
        "bce_logits": softplus(z) - z * y,
        "mse": r * r,
        "poisson_nll": F.exp(z) - y * z,
        "gamma_nll": shape * (z + y * F.exp(-z)),
        "huber": F.when(F.abs(r) <= delta, 0.5 * r * r).otherwise(delta * (F.abs(r) - 0.5 * delta)),
        "quantile": F.greatest(tau * r, (tau - 1) * r),
        "hinge": F.greatest(F.lit(0.0), 1 - (2 * y - 1) * z),
    }


def class_losses(z: Column, y: Column, classes: int, margin: float = 1.0) -> dict[str, Column]:
    """The loss of an array of outputs z by name. y: a class for cross_entropy, multi_margin and ordinal (whose z has one output less than
    classes, for a class above each of the first ones), an array of 0 and 1 for multilabel_bce."""
    safe = F.transform(z, lambda v: saturated(v, LOGIT_LIMIT))
    own = F.get(safe, y.cast("int"))
    above = F.transform(safe, lambda v, k: softplus(v) - F.when(y > k, v).otherwise(F.lit(0.0)))
    others = lambda mine: F.transform(safe, lambda v, k: F.when(k == y, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(float(margin)) - mine + v)))
    return {
        "cross_entropy": F.array_max(safe) + F.log(total(_exponentials(safe))) - own,
        "multi_margin": held(own, lambda mine: total(others(mine))) / classes,
        "ordinal": total(above) / (classes - 1),
    }


def multilabel_bce(z: Column, y: Column) -> Column:
    """The mean over labels of the binary cross entropy of logits z for an array y of 0 and 1."""
    safe = F.transform(z, lambda v: saturated(v, LOGIT_LIMIT))
    return total(F.zip_with(safe, y, lambda a, b: softplus(a) - a * b)) / F.size(z)


def predictions(logits: Column, loss: str) -> Column:
    """Outputs of a model whose last layer gives an array of logits: identity, exp, sigmoid, softmax, or ordinal differences."""
    z = F.transform(logits, lambda v: saturated(v, LOGIT_LIMIT))
    if loss in ("mse", "huber", "quantile"):
        return F.transform(logits, lambda v: saturated(v, FEATURE_LIMIT))
    if loss in ("poisson_nll", "negbin_nll", "gamma_nll"):
        return F.transform(z, F.exp)
    if loss in ("multilabel_bce", "bce_logits"):
        return F.transform(z, sigmoid)
    if loss == "ordinal":
        above = F.transform(z, sigmoid)
        falling = F.transform(above, lambda v, i: F.array_min(F.slice(above, F.lit(1), i + 1)))
        edges = F.concat(F.array(F.lit(1.0)), falling, F.array(F.lit(0.0)))
        parts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.greatest(edges[k - 1] - edges[k], F.lit(0.0)))
        return normalised(parts)
    return normalised(_exponentials(z))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def normalised(x: Column) -> Column:
    """Shares of the sum; equal shares if the sum is 0."""
    shares = lambda y, s: F.transform(y, lambda v: F.when(s > 0, v / s).otherwise(F.lit(1.0) / F.size(y)))
    return held(x, lambda y: held(total(y), lambda s: shares(y, s)))


def _exponentials(x: Column) -> Column:
    """exp(v - the largest) of each element."""
    return held(x, lambda y: held(F.array_max(y), lambda top: F.transform(y, lambda v: F.exp(v - top))))


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    rows = lambda y: [total(F.zip_with(y, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b)) + F.lit(float(bias[k]) if bias else 0.0) for k, row in enumerate(weights)]
    return held(x, lambda y: F.array(*rows(y)))


def gelu(v: Column) -> Column:
    """x times the normal distribution function at x, by its error function to 1.5e-7 (a published rational approximation)."""
    x = F.abs(v) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: coefficients of the approximation
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - series * F.exp(-x * x)
    return 0.5 * v * (1 + F.when(v < 0, -erf).otherwise(erf))


#: Elements that a layer may have, layers of a model, inputs of a node, parameters in all, and the size of a public scalar.
MOST_WIDTH, MOST_LAYERS, MOST_INPUTS, MOST_PARAMETERS, MOST_SCALAR = 8192, 64, 64, 8_000_000, 1e6
#: Products that a matmul may spell out: each is a term of the expression.
MOST_TERMS = 4096


def checked_width(width: int) -> int:
    if not 1 <= width <= MOST_WIDTH:
        raise ValueError("a layer is too wide")
    return width


def loss_width(loss: str, classes: int = 2, labels: int = 1) -> int:
    """The outputs that a loss needs: a logit for each class, one less for ordinal levels, one for each label (given as classes or
    labels), else one."""
    return {"cross_entropy": max(2, classes), "multi_margin": max(2, classes), "ordinal": max(1, classes - 1), "multilabel_bce": max(classes, labels)}.get(loss, 1)


def check_model(spec: list[dict]) -> None:
    """ValueError if there are too many layers, inputs or parameters, a layer is too wide, or a number of the spec is too large."""
    if len(spec) > MOST_LAYERS:
        raise ValueError("the model is too large")
    parameters = 0
    for op in spec:
        rows = op.get("weights") or []
        parameters += sum(map(len, rows)) + len(op.get("bias") or [])
        if len(rows) > MOST_WIDTH or any(len(r) > MOST_WIDTH for r in rows) or len(op.get("from") or []) > MOST_INPUTS or parameters > MOST_PARAMETERS:
            raise ValueError("the model is too large")
        if not all(abs(float(op.get(k, 0.0))) <= MOST_SCALAR for k in ("scale", "shift", "negative_slope")):
            raise ValueError("a number of the model is too large")
        if op["op"] == "matmul" and op["n"] * op["k"] * op["m"] > MOST_TERMS:
            raise ValueError("a product is too large for an expression")


def output_width(spec: list[dict], width: int) -> int:
    """The elements of a model's output for an input of `width`; ValueError if a layer does not fit or the model is too large."""
    if not 1 <= width <= MOST_WIDTH or len(spec) > MOST_LAYERS:
        raise ValueError("the model is too large")
    for op in spec:
        kind = op["op"]
        if kind == "linear":
            rows = op["weights"]
            if not rows or any(len(r) != width for r in rows) or len(rows) > MOST_WIDTH or len(op.get("bias") or rows) != len(rows):
                raise ValueError("a linear layer does not fit its input")
            width = len(rows)
        elif kind == "reshape":
            if math.prod(op["shape"]) != width:
                raise ValueError("a reshape changes the number of elements")
        elif kind not in ("affine", "layernorm", "softmax", "flatten", "leaky_relu", "transpose") and kind not in ACTIVATIONS:
            raise ValueError(f"no such layer: {kind}")
        elif kind == "transpose" and math.prod(op["shape"]) != width:
            raise ValueError("a transpose does not fit its input")
    return width


def matmul(a: Column, b: Column, n: int, k: int, m: int) -> Column:
    """The product of an n by k and a k by m matrix, both as arrays by rows."""
    cell = lambda i, j: sum((F.get(a, F.lit(i * k + x)) * F.get(b, F.lit(x * m + j)) for x in range(k)), F.lit(0.0))
    return F.array(*[cell(i, j) for i in range(n) for j in range(m)])


def transposed(x: Column, rows: int, columns: int) -> Column:
    return F.array(*[F.get(x, F.lit(i * columns + j)) for j in range(columns) for i in range(rows)])


ACTIVATIONS = {
    "gelu": gelu,
    "relu": lambda v: F.greatest(v, F.lit(0.0)),
    "tanh": F.tanh,
    "sigmoid": sigmoid,
    "elu": lambda v: F.when(v > 0, v).otherwise(F.expm1(v)),
    "silu": lambda v: v * sigmoid(v),
    "leaky_relu": lambda v: F.when(v > 0, v).otherwise(0.01 * v),
    "dropout": lambda v: v,
}


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    var = lambda y, mean: total(F.transform(y, lambda v: (v - mean) * (v - mean))) / F.size(y)
    scaled = lambda y, mean, root: F.transform(y, lambda v: (v - mean) / root)
    return held(x, lambda y: held(total(y) / F.size(y), lambda mean: held(F.sqrt(var(y, mean) + eps), lambda root: scaled(y, mean, root))))


def _divide(a: Column, b: Column) -> Column:
    return a / F.when(F.abs(b) >= 1e-6, b).otherwise(F.when(b < 0, F.lit(-1e-6)).otherwise(F.lit(1e-6)))


JOINS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": _divide,
}


def _leaky(x: Column, slope: float) -> Column:
    return F.transform(x, lambda v: F.when(v > 0, v).otherwise(slope * v))


def _affine(x: Column, scale: float, shift: float) -> Column:
    return F.transform(x, lambda v: v * scale + shift)


def _softmax(x: Column) -> Column:
    return normalised(_exponentials(x))


def build(spec: list[dict], x: Column) -> Column:
    """Evaluates a declarative list of layers on an array column; every layer's output is made finite. Too large a model raises
    ValueError; see output_width for a check of the widths."""
    check_model(spec)
    for op in spec:
        kind = op["op"]
        if kind == "linear":
            x = linear(x, op["weights"], op.get("bias"))
        elif kind == "affine":
            x = _affine(x, float(op.get("scale", 1.0)), float(op.get("shift", 0.0)))
        elif kind == "layernorm":
            x = layer_norm(x)
        elif kind == "softmax":
            x = _softmax(x)
        elif kind in ("flatten", "reshape"):
            pass  # arrays are flat
        elif kind == "transpose":
            x = transposed(x, *op["shape"])
        elif kind == "leaky_relu":
            x = _leaky(x, float(op.get("negative_slope", 0.01)))
        elif kind in ACTIVATIONS:
            x = F.transform(x, ACTIVATIONS[kind])
        else:
            raise ValueError(f"no such layer: {kind}")
        x = F.transform(x, lambda v: saturated(v, FEATURE_LIMIT))
    return x


def build_graph(nodes: list[dict], inputs: dict[str, Column]) -> Column:
    """Evaluates a graph: each node has a name, an `op` and the names it takes from (`from`), which come before it: layers take one, add, sub,
    mul, div and concat two or more, matmul two and n, k, m. The last node is the output."""
    check_model(nodes)
    at, last = dict(inputs), None
    for node in nodes:
        name, sources = node["name"], [at.get(f) for f in node["from"]]
        if name in at or not sources or any(c is None for c in sources):
            raise ValueError("a node has a name twice, or takes from one that is not before it")
        if node["op"] == "matmul":
            last = F.transform(matmul(*sources, node["n"], node["k"], node["m"]), lambda v: saturated(v, FEATURE_LIMIT))
        elif node["op"] in JOINS or node["op"] == "concat":
            last = sources[0]
            for other in sources[1:]:
                last = join_arrays(node["op"], last, other)
        elif len(sources) == 1:
            last = build([node], sources[0])
        else:
            raise ValueError("a layer takes from one node")
        at[name] = last
    if last is None:
        raise ValueError("an empty graph")
    return last


def join_arrays(kind: str, a: Column, b: Column) -> Column:
    """Two arrays by an operation of a model graph: add, sub, mul, div or concat."""
    out = F.concat(a, b) if kind == "concat" else F.zip_with(a, b, JOINS[kind])
    return F.transform(out, lambda v: saturated(v, FEATURE_LIMIT))
