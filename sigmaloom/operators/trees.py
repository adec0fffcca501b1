"""Tree models from histograms: five engines over one machine.

Rows are binned by public cuts once and kept in a table of small integers. A level or a leaf-wise step is one
aggregation with map-side combination, its histogram of fixed public size goes to the driver, gets its noise there, and
the chosen split comes back as an expression over the bins; no tree state is joined to the rows. Lineage is cut by
tables in the shared folder. Models are plain dicts; predictions are generated CASE-free array expressions.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..sources import store
from . import forests, privacy, statistics
from .privacy import KeyedStream, project_to_simplex, semantic_seed
from .statistics import SCALE

@dataclass(frozen=True)
class TreeSchema:
    """Ordered features with cuts strictly between public bounds, a task and, for regression, target bounds."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    task: str = "binary"
    lower: float = 0.0
    upper: float = 1.0

    def __post_init__(self) -> None:
        if len(self.features) != len(self.cuts) or not all(self.cuts) or sum(map(len, self.cuts)) > 16_384:
            raise ValueError("each feature needs cuts, 16 384 in all at most")
        if any(list(c) != sorted(set(c)) or not all(map(math.isfinite, c)) for c in self.cuts) or self.task not in ("binary", "regression"):
            raise ValueError("cuts must rise, and the task be binary or regression")

    @property
    def bins(self) -> int:
        return max(map(len, self.cuts)) + 2  # and one for missing values

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps([self.features, self.cuts, self.task, self.lower, self.upper]).encode()).hexdigest()

    def unit_target(self, y: Column) -> Column:
        return y.cast("double") if self.task == "binary" else (y - self.lower) / (self.upper - self.lower)


class Exact:
    """No noise: for tests and for statistics that never leave the site."""

    def __call__(self, vector: np.ndarray, label: str) -> np.ndarray:
        return vector

    def integers(self, vector: np.ndarray, label: str) -> np.ndarray:
        return vector


no_noise = Exact()
Noise = Exact


class Released(Exact):
    """The noise of a whole training run for one budget: the release is planned before any data are read, from the engine, the public
    schema and the parameters alone. Each released vector gets the deviation of its kind, from a stream that is bound to the secret, the
    plan, the label and the exact vector, so a replay gives the same model and another input gives independent noise."""

    def __init__(self, engine: str, schema: TreeSchema, epsilon: float, delta: float, secret: bytes, parameters: dict) -> None:
        privacy.check_policy(epsilon, delta)
        if not secret:
            raise ValueError("a release needs the secret of its site")
        self.secret = secret
        self.plan = release_plan(engine, schema, epsilon, delta, parameters)
        self.layout = {"plan": {k: repr(v) for k, v in self.plan.items()}, "schema": schema.sha256(), "parameters": {k: repr(v) for k, v in sorted(parameters.items())}}

    def __call__(self, vector: np.ndarray, label: str) -> np.ndarray:
        sigma = self.plan["sigma_leaf" if label.startswith("leaves") and "sigma_leaf" in self.plan else "sigma"]
        return privacy.release(vector, sigma, self.secret, f"trees/{label}", self.layout)

    def integers(self, vector: np.ndarray, label: str) -> np.ndarray:
        sigma = self.plan["sigma_root" if label.endswith("step 0") else "sigma_level"]
        return np.array(privacy.release_integers([int(v) for v in vector], sigma, self.secret, f"trees/{label}", self.layout), float)


def release_plan(engine: str, schema: TreeSchema, epsilon: float, delta: float, parameters: dict) -> dict:
    """The number of releases of a training run, and the sensitivity and the deviation of each kind of vector when one unit is replaced."""
    trees, depth = int(parameters["trees"]), int(parameters["depth"])
    if engine == "extra_trees":
        x = privacy.forest_releases("extra_trees", schema.task, trees, depth)
        return {"releases": 1, "sensitivity": x["leaf"], "sigma": privacy.gaussian_sigma(epsilon, delta, x["leaf"])}
    if engine == "random_forest":
        x = privacy.forest_releases("random_forest", schema.task, trees, depth, int(parameters["max_features"]))
        sigma = {k: privacy.gaussian_sigma(epsilon, delta, x[k], int(x["releases"])) for k in ("level", "leaf")}
        return {"releases": int(x["releases"]), "sensitivity": x["level"], "sensitivity_leaf": x["leaf"], "sigma": sigma["level"], "sigma_leaf": sigma["leaf"]}
    how = Boosting(ENGINES[engine], **parameters)
    features = how.features_a_step or len(schema.features)
    releases = privacy.boosting_releases(how.growth, trees, how.leaves, depth)
    if how.growth == "depthwise":
        x = privacy.discrete_allocation(Fraction(repr(float(epsilon))), Fraction(repr(float(delta))), trees, depth, features, schema.task, SCALE)
        return {"releases": releases, **x}
    size = privacy.boosting_sensitivity(features, how.g_clip, how.h_clip)
    return {"releases": releases, "sensitivity": size, "sigma": privacy.gaussian_sigma(epsilon, delta, size, releases)}


def units_of(df: DataFrame, schema: TreeSchema, target: str, unit: str) -> DataFrame:
    """A row for each unit: means of the observed features, clamped just beyond the outer cuts, which no bin tells apart; and the majority
    of a binary target, a tie counting as 0, or the clamped mean of a continuous one."""
    from ..functions.clean import binary_tree_target, regression_target, tree_feature
    from .units import pooled_tree_units

    bounds = {f: (c[0] - 1, c[-1] + 1) for f, c in zip(schema.features, schema.cuts, strict=True)}
    y = binary_tree_target(F.col(target)) if schema.task == "binary" else regression_target(F.col(target), schema.lower, schema.upper)
    total = df.select(unit, *[tree_feature(F.col(f), *bounds[f], single=False).alias(f) for f in schema.features], y.alias(target))
    return pooled_tree_units(total, unit, bounds, target, schema.task, (schema.lower, schema.upper))


def binned_rows(df: DataFrame, schema: TreeSchema, target: str, fold: Column | None = None) -> DataFrame:
    """b (an array of bins; null where missing), y, and fold (0: none), written to the shared folder. Targets are made total: a binary one is 1 from 0.5
    on and 0 otherwise, a continuous one is clamped to its bounds, the middle if it is no finite number."""
    from ..functions.clean import bin_of, binary_tree_target, regression_target

    b = F.array(*[bin_of(F.col(f), c).cast("short") for f, c in zip(schema.features, schema.cuts, strict=True)])
    y = binary_tree_target(F.col(target)) if schema.task == "binary" else regression_target(F.col(target), schema.lower, schema.upper)
    return store.staged(df.select(b.alias("b"), y.cast("double").alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold")), "binned")


def _lookup(values: list, at: Column, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at)


def _goes_right(bin_: Column, cut: Column, default_left: Column) -> Column:
    return F.when(bin_.isNull(), ~default_left).otherwise(bin_ > cut)


def heap_leaf(tree: dict, depth: int, b: Column | None = None) -> Column:
    """The leaf, from 0, of a complete tree in heap order. The walk is a fold, so the expression does not grow with the depth."""
    bins = F.col("b") if b is None else b

    def step(node: Column, _: Column) -> Column:
        feature, cut, left = (_lookup(tree[k], node, t) for k, t in (("features", "int"), ("cuts", "int"), ("default_left", "boolean")))
        return 2 * node + 1 + _goes_right(F.get(bins, feature), cut, left).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) - ((1 << depth) - 1)


def random_topology(schema: TreeSchema, trees: int, depth: int, domain: str = "topology/v1") -> list[dict]:
    """Public complete trees: features, cuts and default sides drawn from a stream that only the schema seeds."""
    stream = KeyedStream(semantic_seed(b"public", domain, schema.sha256(), trees, depth))
    out = []
    for _ in range(trees):
        f = [stream.below(len(schema.features)) for _ in range((1 << depth) - 1)]
        out.append({"features": f, "cuts": [stream.below(len(schema.cuts[k])) for k in f], "default_left": [bool(stream.below(2)) for _ in f]})
    return out


def _vector(df: DataFrame, size: int, *names: str) -> np.ndarray:
    """Sums by coordinate as a dense array; the layout is public and bounded."""
    out = np.zeros((size, len(names)))
    for row in df.collect():
        out[row["coord"]] = [row[n] for n in names]
    return out


def leaf_values(stats: np.ndarray, schema: TreeSchema) -> np.ndarray:
    """(n1 + 1) / (n0 + n1 + 2), or the shrunk mean on the target's bounds, of statistics [..., 2]."""
    s = np.clip(stats, 0, None)
    if schema.task == "binary":
        return (s[..., 1] + 1) / (s.sum(-1) + 2)
    return schema.lower + (np.minimum(s[..., 1], s[..., 0]) + 0.5) / (s[..., 0] + 1) * (schema.upper - schema.lower)


def heap_leaves(topology: list[dict], depth: int, b: np.ndarray) -> np.ndarray:
    """The leaf, from 0, of each row of bins [rows, features], -1 where missing, in each complete tree: [trees, rows]."""
    rows, out = np.arange(len(b)), np.empty((len(topology), len(b)), np.int64)
    for t, tree in enumerate(topology):
        node = np.zeros(len(b), np.int64)
        feature, cut, left = (np.array(tree[k]) for k in ("features", "cuts", "default_left"))
        for _ in range(depth):
            x = b[rows, feature[node]]
            node = 2 * node + 1 + np.where(x < 0, ~left[node], x > cut[node])
        out[t] = node - ((1 << depth) - 1)
    return out


def _leaf_sums(rows: DataFrame, topology: list[dict], depth: int, folds: int = 0) -> DataFrame:
    """coord (fold, tree and leaf), n, s: counts and sums over the leaves of complete trees. rows: b, an array of bins, s, and with folds
    the row's fold. Each task adds up its own batches in one vector of the public layout, whose cells are then summed."""
    import pyarrow as pa

    size = len(topology) << depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((folds + 1) * size, np.int64), np.zeros((folds + 1) * size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.array(batch.column(0).flatten().fill_null(-1), np.int64).reshape(batch.num_rows, -1)
            coord = (heap_leaves(topology, depth, b) + (np.arange(len(topology)) << depth)[:, None] + batch.column(2).to_numpy().astype(np.int64) * size).ravel()
            value = np.tile(batch.column(1).to_numpy(), len(topology))
            n += np.bincount(coord, minlength=len(n))
            order = np.argsort(coord, kind="stable")  # sums in integers: bincount's weights are floating
            at = np.flatnonzero(np.diff(coord[order], prepend=-1))
            if len(at):
                s[coord[order][at]] += np.add.reduceat(value[order], at)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(s[used])], names=["coord", "n", "s"])

    rows = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(0))
    return rows.select("b", "s", "fold").mapInArrow(run, "coord bigint, n bigint, s bigint").groupBy("coord").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def extra_trees_models(rows: DataFrame, schema: TreeSchema, trees: int, depth: int, noise: Noise = no_noise, folds: int = 0) -> list[dict]:
    """Random public trees for all rows, or for each fold those of the other folds' rows. rows: binned. All leaves of all trees of all models
    are one aggregation by the rows' own folds; a model's statistics are those of all folds less its own."""
    if not (1 <= depth <= 12 and 1 <= trees <= 512):
        raise ValueError("depth up to 12, trees up to 512")
    topology, leaves = random_topology(schema, trees, depth), 1 << depth
    y = schema.unit_target(F.col("y"))
    second = y.cast("long") if schema.task == "binary" else F.rint(y * SCALE).cast("long")
    sums = _leaf_sums(rows.select("b", second.alias("s"), "fold"), topology, depth, folds)
    n, s = _vector(sums, (folds + 1) * trees * leaves, "n", "s").T.reshape(2, folds + 1, -1)
    out = []
    for k in range(1, folds + 1) if folds else (0,):
        others = [f for f in range(folds + 1) if not folds or f != k]
        nk, sk = n[others].sum(0), s[others].sum(0)
        stats = np.stack([nk - sk, sk] if schema.task == "binary" else [nk, sk / SCALE], -1)
        stats = noise(stats.ravel(), f"leaves fold {k}" if folds else "leaves").reshape(trees, leaves, 2)
        out.append({"kind": "forest", "engine": "extra_trees", "task": schema.task, "depth": depth, "trees": [t | {"leaves": v} for t, v in zip(topology, leaf_values(stats, schema).tolist(), strict=True)]})
    return out


def extra_trees(df: DataFrame, schema: TreeSchema, target: str, trees: int, depth: int, noise: Noise = no_noise) -> dict:
    """Random public trees; all leaves of all trees are one aggregation and one release."""
    return extra_trees_models(binned_rows(df, schema, target), schema, trees, depth, noise)[0]


def candidate_features(schema: TreeSchema, trees: int, depth: int, max_features: int) -> list[list[list[list[int]]]]:
    """Of each level, tree and node the features that may split it."""
    return [[forests.candidates(schema, trees, depth, max_features, level, t).tolist() for t in range(trees)] for level in range(depth)]


def random_forest_models(rows: DataFrame, schema: TreeSchema, trees: int, depth: int, max_features: int, key: bytes, noise: Noise = no_noise, folds: int = 0) -> list[dict]:
    """Each record trains one tree, chosen by a keyed hash of its bins and target; depth + 1 aggregations in all, however many folds' models
    are grown. rows: binned."""
    if not (1 <= depth <= 12 and 1 <= trees <= 512 and 1 <= max_features <= len(schema.features)):
        raise ValueError("depth up to 12, trees up to 512, features up to their number")
    models = forests.grow(forests.assigned(rows, schema, key, trees), schema, trees, depth, max_features, noise, max(1, folds))
    return [{"kind": "forest", "engine": "random_forest", "task": schema.task, "depth": depth, "trees": m} for m in models]


def random_forest(df: DataFrame, schema: TreeSchema, target: str, trees: int, depth: int, max_features: int, key: bytes, noise: Noise = no_noise) -> dict:
    return random_forest_models(binned_rows(df, schema, target), schema, trees, depth, max_features, key, noise)[0]


@dataclass(frozen=True)
class Boosting:
    """Parameters of a boosted engine: leafwise, oblivious or depthwise trees."""

    growth: str
    trees: int
    depth: int
    leaves: int = 31
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    max_step: float = 1.0
    min_count: float = 0.0
    min_gain: float = 0.0
    min_hessian: float = 0.0
    g_clip: float = 1.0
    h_clip: float = 1.0
    features_a_step: int | None = None

    def __post_init__(self) -> None:
        limits = {"leafwise": 32, "oblivious": 16, "depthwise": 30}
        if self.growth == "depthwise" and self.min_count:
            raise ValueError("depth-wise trees release no counts")
        if self.growth not in limits or not (1 <= self.depth <= limits[self.growth] and self.trees >= 1 and 2 <= self.leaves <= 256 and 0 < self.rate <= 1 and self.l2 > 0 and self.max_step > 0):
            raise ValueError("a parameter is outside its range")


def _score(s: np.ndarray, p: Boosting) -> np.ndarray:
    return np.maximum(np.abs(s[..., 0]) - p.l1, 0) ** 2 / (np.maximum(s[..., 1], 0) + p.l2)


def _weight(s: np.ndarray, p: Boosting) -> float:
    g = math.copysign(max(abs(float(s[0])) - p.l1, 0.0), float(s[0]))
    return p.rate * min(max(-g / (max(float(s[1]), 0.0) + p.l2), -p.max_step), p.max_step)


def _clean(s: np.ndarray) -> np.ndarray:
    return np.concatenate([s[..., :1], np.maximum(s[..., 1:], 0)], -1)


def _children(h: np.ndarray, cuts: int, default_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Statistics [cuts, 3] of both sides of each cut of a histogram [bins, 3] whose last bin holds missing values."""
    low = h[: cuts + 1].cumsum(0)
    left, right = low[:cuts], low[cuts] - low[:cuts]
    return (_clean(left + h[-1]), _clean(right)) if default_left else (_clean(left), _clean(right + h[-1]))


def boost(df: DataFrame, schema: TreeSchema, target: str, p: Boosting, noise: Noise = no_noise) -> dict:
    """Gradient boosting on released histograms. Each step is one aggregation of fixed-point sums, so its result does not depend on
    the order of rows; the margins are written to the shared folder once a tree."""
    start = 0.0 if schema.task == "binary" else (schema.lower + schema.upper) / 2
    rows = store.staged(binned_rows(df, schema, target).withColumn("margin", F.lit(start)), "margins")
    names, trees, step = range(len(schema.features)), [], 0
    for t in range(p.trees):
        g, h = statistics.gradient_columns(F.col("margin"), F.col("y"), schema.task, p.g_clip, p.h_clip)
        work = rows.withColumns({"g": g, "h": h})
        nodes = [{"depth": 0, "stats": None, "left": -1, "right": -1, "feature": 0, "cut": 0, "default_left": False}]
        node: Column = F.lit(0)
        rounds = p.leaves - 1 if p.growth == "leafwise" else p.depth
        for r in range(rounds):
            take = p.features_a_step or len(schema.features)
            chosen = keyed.ranked_features(schema.sha256(), len(schema.features), take, step)
            step += 1
            active = [k for k, x in enumerate(nodes) if x["left"] < 0]
            slot = _lookup([active.index(k) if k in active else -1 for k in range(len(nodes))], node, "int")
            cells = statistics.gradient_histogram(work, slot, {k: F.get("b", F.lit(f)) for k, f in enumerate(chosen)}, schema.bins - 1, F.col("g"), F.col("h"))
            fixed = np.zeros((len(active), take, schema.bins, 3), np.int64)
            for c in cells.collect():
                fixed[c["slot"], c["feature"], c["bin"]] = (c["g"], c["h"], c["n"])
            if p.growth == "depthwise":
                hist = _released_pairs(fixed, [nodes[k]["stats"] for k in active], noise, f"tree {t} step {r}", p)
            else:
                raw = fixed * np.array([p.g_clip / SCALE, p.h_clip / SCALE, 1.0])
                hist = noise(raw.ravel(), f"tree {t} step {r}").reshape(raw.shape)
            splits = _splits(hist, active, nodes, chosen, schema, p)
            for k, f, cut, default, left, right in splits:
                nodes[k] |= {"left": len(nodes), "right": len(nodes) + 1, "feature": f, "cut": cut, "default_left": default}
                nodes += [{"depth": nodes[k]["depth"] + 1, "stats": s, "left": -1, "right": -1, "feature": 0, "cut": 0, "default_left": False} for s in (left, right)]
            if not splits:
                continue
            pick = lambda name, kind: _lookup([x[name] for x in nodes], node, kind)  # noqa: E731, B023
            right_side = _goes_right(F.get("b", pick("feature", "int")), pick("cut", "int"), pick("default_left", "boolean"))
            moved = F.when(pick("left", "int") < 0, node).when(right_side, pick("right", "int")).otherwise(pick("left", "int"))
            work = work.withColumn("node", moved)
            if r % 8 == 7:
                work = store.staged(work, "nodes")
            node = F.col("node")
        for x in nodes:
            x["leaf"] = _weight(x["stats"], p) if x["left"] < 0 and x["stats"] is not None else 0.0
        tree = {k: [x[k] for x in nodes] for k in ("left", "right", "feature", "cut", "default_left", "leaf")}
        trees.append(tree)
        rows = store.staged(work.select("b", "y", (F.col("margin") + _lookup(tree["leaf"], node, "double")).alias("margin")), "margins")
    return {"kind": "boosting", "engine": p.growth, "task": schema.task, "start": start, "lower": schema.lower, "upper": schema.upper, "trees": trees}


def _released_pairs(fixed: np.ndarray, known: list[np.ndarray | None], noise: Noise, label: str, p: Boosting) -> np.ndarray:
    """The histogram [nodes, features, bins, 3] of a level of depth-wise trees from integer sums of gradients and hessians. Released are the
    observed bins and, of a root, its total pair; a missing bin is the node's total less the observed ones, and hessians are projected on
    the node's total. Counts are not released, and stay zero."""
    n, take, bins, _ = fixed.shape
    at_root = known[0] is None
    total = fixed[0, 0, :, :2].sum(0) if at_root else np.zeros(0, np.int64)
    out = noise.integers(np.concatenate([total, fixed[:, :, :-1, :2].ravel()]), label)
    unit = np.array([p.g_clip, p.h_clip]) / SCALE
    totals = [out[:2] * unit] if at_root else [k[:2] for k in known]
    hist = np.zeros(fixed.shape)
    hist[:, :, :-1, :2] = out[len(total) :].reshape(n, take, bins - 1, 2) * unit
    for i in range(n):
        whole = np.maximum(totals[i], [-math.inf, 0.0])
        for f in range(take):
            hist[i, f, -1, :2] = whole - hist[i, f, :-1, :2].sum(0)
            hist[i, f, :, 1] = project_to_simplex(hist[i, f, :, 1], float(whole[1]))
    return hist


def _splits(hist: np.ndarray, active: list[int], nodes: list[dict], chosen: list[int], schema: TreeSchema, p: Boosting) -> list[tuple]:
    """(node, feature, cut, default_left, left, right) of the splits of one step: the best leaf's, all leaves' together, or each one's."""
    found: dict[int, tuple] = {}
    total: dict[tuple, tuple[float, list]] = {}
    for i, k in enumerate(active):
        c0 = len(schema.cuts[chosen[0]])
        nodes[k]["stats"] = _clean(hist[i, 0, : c0 + 1].sum(0) + hist[i, 0, -1]) if nodes[k]["stats"] is None or p.growth == "leafwise" else nodes[k]["stats"]
        for j, f in enumerate(chosen):
            for default in ((True, False) if p.growth == "depthwise" else (False, True)):
                left, right = _children(hist[i, j], len(schema.cuts[f]), default)
                gain = _score(left, p) + _score(right, p) - _score(left + right, p)
                fits = (np.minimum(left[:, 2], right[:, 2]) >= p.min_count) & (np.minimum(left[:, 1], right[:, 1]) >= p.min_hessian)
                for cut in range(len(gain)):
                    if p.growth == "oblivious":
                        so_far, sides = total.get((f, cut, default), (0.0, []))
                        total[f, cut, default] = (so_far + float(gain[cut]), [*sides, (k, left[cut], right[cut])])
                    elif fits[cut] and nodes[k]["depth"] < p.depth:
                        place = 0 if p.growth == "leafwise" else k
                        order = (-float(gain[cut]), k, f, cut, default if p.growth == "leafwise" else not default)
                        if place not in found or order < found[place][0]:
                            found[place] = (order, (k, f, cut, default, left[cut], right[cut]))
    if p.growth == "oblivious":
        (f, cut, default), (_, sides) = min(total.items(), key=lambda x: (-x[1][0], x[0]))
        return [(k, f, cut, default, left, right) for k, left, right in sides]
    worth = (lambda gain: gain >= p.min_gain) if p.growth == "leafwise" else (lambda gain: gain > p.min_gain)
    return [split for order, split in found.values() if worth(-order[0])]


def _walker(tree: dict, b: Column) -> Callable[[Column, Column], Column]:
    def step(node: Column, _: Column) -> Column:
        pick = lambda name, kind: _lookup(tree[name], node, kind)
        right = _goes_right(F.get(b, pick("feature", "int")), pick("cut", "int"), pick("default_left", "boolean"))
        return F.when(pick("left", "int") < 0, node).when(right, pick("right", "int")).otherwise(pick("left", "int"))

    return step


def margin(model: dict, b: Column) -> Column:
    """The sum of a boosted model's leaves, on an array of bins."""
    out = F.lit(float(model["start"]))
    for tree in model["trees"]:
        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(_height(tree))), F.lit(0), _walker(tree, b)) if _height(tree) else F.lit(0)
        out = out + _lookup(tree["leaf"], leaf, "double")
    return out


def _height(tree: dict) -> int:
    at = [0] * len(tree["left"])
    for k, (a, z) in enumerate(zip(tree["left"], tree["right"], strict=True)):
        for child in (a, z):
            if child >= 0:
                at[child] = at[k] + 1
    return max(at)


def _walk(model: dict, b: np.ndarray) -> np.ndarray:
    """Predictions of one model on bins [rows, features], -1 where missing."""
    rows = np.arange(len(b))
    if model["kind"] == "forest":
        leaf = heap_leaves(model["trees"], model["depth"], b)
        return sum(np.array(tree["leaves"])[at] for tree, at in zip(model["trees"], leaf, strict=True)) / len(model["trees"])
    total = np.full(len(b), float(model["start"]))
    for tree in model["trees"]:
        node = np.zeros(len(b), int)
        a, z, feature, cut, default, leaf = (np.array(tree[k]) for k in ("left", "right", "feature", "cut", "default_left", "leaf"))
        for _ in range(_height(tree)):
            x = b[rows, feature[node]]
            right = np.where(x < 0, ~default[node], x > cut[node])
            node = np.where(a[node] < 0, node, np.where(right, z[node], a[node]))
        total += leaf[node]
    return 1 / (1 + np.exp(-np.clip(total, -700, 700))) if model["task"] == "binary" else np.clip(total, model["lower"], model["upper"])


def predict(df: DataFrame, models: list[dict], schema: TreeSchema, keep: list[str]) -> DataFrame:
    """keep and prediction: the mean of the models' predictions (of a boosted binary model: of its probability), Arrow batch by batch."""
    import pyarrow as pa

    models = ordered([m for m in models if m["kind"] != "empty"])
    if not models:
        raise ValueError("no site has training rows")
    rows = df.select(*keep, F.array(*[F.coalesce(_bins(schema, k), F.lit(-1)).cast("int") for k in range(len(schema.features))]).alias("_b"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.array(batch.column("_b").flatten()).reshape(batch.num_rows, -1)
            mean = np.mean([_walk(m, b) for m in models], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(mean)], names=[*keep, "prediction"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{fields}, prediction double" if keep else "prediction double")


def _bins(schema: TreeSchema, k: int) -> Column:
    from ..functions.clean import bin_of

    return bin_of(F.col(schema.features[k]), schema.cuts[k])


def canonical(model: dict) -> str:
    return json.dumps(model, sort_keys=True, separators=(",", ":"), allow_nan=False)


def ordered(models: list[dict]) -> list[dict]:
    """Members of an ensemble in the order of their digests."""
    return sorted(models, key=lambda m: hashlib.sha256(canonical(m).encode()).hexdigest())


#: Fields of a model of each kind, of a tree, and the limits of what a model may hold.
_FIELDS = {"forest": {"kind", "engine", "task", "depth", "trees"}, "boosting": {"kind", "engine", "task", "start", "lower", "upper", "trees"}}
_TREE_FIELDS = {"forest": {"features", "cuts", "default_left", "leaves"}, "boosting": {"feature", "cut", "default_left", "left", "right", "leaf"}}
_MODEL_ENGINES = {"forest": ("extra_trees", "random_forest"), "boosting": ("leafwise", "oblivious", "depthwise")}
MOST_TREES, MOST_HEIGHT, MOST_NODES = {"forest": 512, "boosting": 10_000}, {"leafwise": 32, "oblivious": 16, "depthwise": 30}, 1 << 18
#: The least and largest leaf of a boosted tree: a step of at most 100 at a rate of at most 1.
MOST_STEP = 100.0


def _need(fine: bool, why: str) -> None:
    if not fine:
        raise ValueError(why)


def _number(x: object, lower: float, upper: float) -> bool:
    return type(x) is float and lower <= x <= upper  # neither an integer, a boolean nor NaN


def _sanitised_tree(tree: object, model: dict, schema: TreeSchema) -> dict:
    kind = model["kind"]
    _need(isinstance(tree, dict) and set(tree) == _TREE_FIELDS[kind] and all(isinstance(v, list) for v in tree.values()), "a tree has other fields")
    forest = kind == "forest"
    feature, cut, default = (tree[n] for n in (("features", "cuts", "default_left") if forest else ("feature", "cut", "default_left")))
    leaves = tree["leaves" if forest else "leaf"]
    nodes = (1 << model["depth"]) - 1 if forest else len(leaves)
    _need(1 <= nodes <= MOST_NODES and len(feature) == len(cut) == len(default) == nodes, "a tree has the wrong shape")
    _need(all(type(f) is int and type(c) is int and 0 <= f < len(schema.features) and 0 <= c < len(schema.cuts[f]) and type(d) is bool for f, c, d in zip(feature, cut, default, strict=True)), "a split is outside the schema")
    if forest:
        _need(len(leaves) == nodes + 1, "a tree has the wrong shape")
        _need(all(_number(v, *((0.0, 1.0) if schema.task == "binary" else (schema.lower, schema.upper))) for v in leaves), "a leaf is outside its range")
        return tree
    left, right = tree["left"], tree["right"]
    _need(len(left) == len(right) == nodes and all(type(x) is int for x in left + right), "a tree has the wrong shape")
    _need(all(_number(v, -MOST_STEP, MOST_STEP) for v in leaves), "a leaf is outside its range")
    parent, height = [-1] * nodes, [0] * nodes
    for k, pair in enumerate(zip(left, right, strict=True)):
        if pair == (-1, -1):
            continue
        for child in pair:
            _need(k < child < nodes and parent[child] < 0, "a child is outside the tree, or another node's")
            parent[child], height[child] = k, height[k] + 1
    _need(all(p >= 0 for p in parent[1:]) and max(height) <= MOST_HEIGHT[model["engine"]], "a tree is too high, or a node has no parent")
    return tree


def sanitised(model: dict, schema: TreeSchema, max_bytes: int = 64 << 20) -> dict:
    """The model, if its fields are those of its kind and each is of the right type and within its bounds: trees as large as the depth says
    or properly linked and no higher than their engine grows them, splits inside the schema, leaves and start inside the target's bounds or a
    step's; else ValueError. A plan under `release`, if there is one, holds numbers only."""
    _need(isinstance(model, dict) and model.get("kind") in _FIELDS, "not a model")
    try:
        size = len(canonical(model))
    except (TypeError, ValueError, RecursionError):
        raise ValueError("the model holds what JSON does not") from None
    kind = model["kind"]
    _need(size <= max_bytes, "the model is too large")
    _need(set(model) - {"release"} == _FIELDS[kind] and model["task"] == schema.task and model["engine"] in _MODEL_ENGINES[kind], "not a model of this schema")
    _need(isinstance(model["trees"], list) and 1 <= len(model["trees"]) <= MOST_TREES[kind], "too few or too many trees")
    if kind == "forest":
        _need(type(model["depth"]) is int and 1 <= model["depth"] <= 12, "the depth is outside its range")
    else:
        bounds = all(type(model[n]) is float for n in ("lower", "upper")) and (model["lower"], model["upper"]) == (schema.lower, schema.upper)
        start = 0.0 if schema.task == "binary" else (schema.lower + schema.upper) / 2
        _need(bounds and type(model["start"]) is float and model["start"] == start, "start or bounds are not the schema's")
    plan = model.get("release", {})
    _need(isinstance(plan, dict) and all(type(v) in (int, float) and math.isfinite(v) for v in plan.values()), "the plan holds more than numbers")
    for tree in model["trees"]:
        _sanitised_tree(tree, model, schema)
    return json.loads(canonical(model))


#: Engines by name, with the growth of the boosted ones.
ENGINES = {"extra_trees": extra_trees, "random_forest": random_forest, "lightgbm": "leafwise", "catboost": "oblivious", "xgboost": "depthwise"}


def train(engine: str, df: DataFrame, schema: TreeSchema, target: str, noise: Noise = no_noise, key: bytes = b"", epsilon: float | None = None, delta: float | None = None, secret: bytes = b"", unit: str | None = None, **parameters: float) -> dict:
    """Trains by engine name. unit: a column of which the rows of one value are pooled into one row first; without it the rows are the units. With epsilon and delta the model is a release within that budget, of units that are replaced, and tells
    its plan; secret is the site's. Without them it is exact and must not leave the site, unless `noise` says otherwise."""
    if engine not in ENGINES:
        raise ValueError(f"no such engine: {engine}")
    if (epsilon is None) != (delta is None):
        raise ValueError("a budget has an epsilon and a delta")
    plan = {}
    if epsilon is not None:
        noise = Released(engine, schema, epsilon, delta, secret, parameters)
        plan = {"release": {"epsilon": epsilon, "delta": delta, **{k: v if isinstance(v, int) else float(v) for k, v in noise.plan.items()}}}
    if unit is not None:
        df = units_of(df, schema, target, unit)
    how = ENGINES[engine]
    if engine == "random_forest":
        return how(df, schema, target, key=key, noise=noise, **parameters) | plan
    if callable(how):
        return how(df, schema, target, noise=noise, **parameters) | plan
    return boost(df, schema, target, Boosting(how, **parameters), noise) | plan


def empty_side(schema: TreeSchema, engine: str) -> dict:
    """What a site without training rows returns: a model of no trees, which takes no part in an ensemble's mean."""
    return {"kind": "empty", "engine": engine, "task": schema.task, "trees": [], "n": 0}
