"""Adaptive forests, of one model or of a model for each fold, grown level by level in shared scans.

A shard is one tree of one model. A level is one scan: each task walks its rows through the trees that are grown so far, adds up one
histogram of the candidates' cells for all shards, and the cells are summed by shard. The search for the splits of a shard runs where its
histogram lies, with its own noise; only the splits come to the driver. A row takes part in every model but that of its own fold, so K models
take as many jobs as one.

What reaches one task of the search is a shard's histogram, of public size: nodes x candidates x bins. The rows' side is as large as the
rows, and no tree state is joined to them. Candidates are drawn for each level and tree from a stream of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .privacy import KeyedStream, semantic_seed
from .statistics import SCALE

#: Distinct cells that a task holds before it hands its sums on.
HELD = 2_000_000
Noise = Callable[[np.ndarray, str], np.ndarray]


def candidates(schema, trees: int, depth: int, max_features: int, level: int, tree: int) -> np.ndarray:
    """The features that may split each node of a tree's level, rising: [nodes, max_features]. Only the public schema and sizes seed them."""
    features, width = len(schema.features), 1 << level
    stream = KeyedStream(semantic_seed(b"public", "candidates/v2", schema.sha256(), trees, depth, max_features, level, tree))
    keys = np.frombuffer(stream.take(8 * width * features), ">u8").reshape(width, features)
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :max_features], axis=1).astype(np.int16)


class Grown:
    """The splits so far of all shards, in heap order: [shards, nodes]."""

    def __init__(self, shards: int) -> None:
        self.feature, self.cut = np.zeros((2, shards, 0), np.int16)
        self.default_left = np.zeros((shards, 0), bool)

    def add(self, feature: np.ndarray, cut: np.ndarray, default_left: np.ndarray) -> None:
        self.feature = np.concatenate([self.feature, feature], 1)
        self.cut = np.concatenate([self.cut, cut], 1)
        self.default_left = np.concatenate([self.default_left, default_left], 1)

    def nodes(self, b: np.ndarray, shard: np.ndarray, level: int) -> np.ndarray:
        """The node, from 0 on its level, that each row of bins [rows, features], -1 where missing, reaches in its shard."""
        rows, node = np.arange(len(b)), np.zeros(len(b), np.int64)
        for _ in range(level):
            x = b[rows, self.feature[shard, node]]
            node = 2 * node + 1 + np.where(x < 0, ~self.default_left[shard, node], x > self.cut[shard, node])
        return node - ((1 << level) - 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    coord = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
    order = np.argsort(coord, kind="stable")
    coord = coord[order]
    first = np.flatnonzero(np.diff(coord, prepend=-1))
    sums = [np.add.reduceat(np.concatenate([p[k] for p in parts])[order], first) if len(first) else np.zeros(0, np.int64) for k in (1, 2)]
    return coord[first], *sums


def _cells(rows: DataFrame, models: int, trees: int, size: int, coord_of: Callable) -> DataFrame:
    """shard, cell, n, s: counts and sums over the cells of each shard. rows: b, s, tree, fold. coord_of(b, shard) gives the cells of rows,
    [rows] or [rows, candidates]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> pa.RecordBatch:
            coord, n, s = _summed(parts)
            return pa.RecordBatch.from_arrays([pa.array((coord // size).astype(np.int32)), pa.array(coord % size), pa.array(n), pa.array(s)], names=["shard", "cell", "n", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.array(batch.column(0).flatten().fill_null(-1), np.int16).reshape(batch.num_rows, -1)
            s, tree, fold = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
            for model in range(models):
                mine = fold != model + 1
                shard = model * trees + tree[mine]
                cell = coord_of(b[mine], shard)
                coord = (shard.reshape(-1, *[1] * (cell.ndim - 1)) * size + cell).ravel()
                value = np.repeat(s[mine], cell.shape[1]) if cell.ndim > 1 else s[mine]
                parts.append(_summed([(coord, np.ones(len(coord), np.int64), value)]))
                held += len(parts[-1][0])
            if held > HELD:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield out()
                    parts, held = [], 0
        yield out()

    found = rows.select("b", "s", "tree", "fold").mapInArrow(run, "shard int, cell bigint, n bigint, s bigint")
    summed = found.groupBy("shard", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = rows.sparkSession.range(models * trees).select(F.col("id").cast("int").alias("shard"), F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    return summed.unionByName(every)  # a shard without rows has its noise, too


def _pairs(table: pa.Table, size: int, task: str) -> np.ndarray:
    """The statistics [size, 2] of a shard: counts of both classes, or the count and the sum of a target on 0 .. 1."""
    out = np.zeros((2, size))
    cell, n, s = (table.column(c).to_numpy() for c in ("cell", "n", "s"))
    real = cell >= 0
    out[0][cell[real]], out[1][cell[real]] = (n - s if task == "binary" else n)[real], (s if task == "binary" else s / SCALE)[real]
    return out.T


def _worth(side: np.ndarray, task: str) -> np.ndarray:
    tiny = np.finfo(float).tiny
    if task == "binary":
        return (side**2).sum(-1) / np.maximum(side.sum(-1), tiny)
    return side[..., 1] ** 2 / np.maximum(side[..., 0], tiny)


def best_splits(h: np.ndarray, chosen: np.ndarray, cuts: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and default side of each node's best split, from histograms [nodes, candidates, bins, 2] whose last bin holds missing
    values. cuts: the number of each feature's cuts. Of equal splits the first by feature, cut, and right before left."""
    n_cuts = cuts[chosen]  # [nodes, candidates]
    places = h.shape[2] - 2
    observed = np.where((np.arange(places + 1) <= n_cuts[..., None])[..., None], h[:, :, :-1], 0.0)
    low, missing = observed.cumsum(2), h[:, :, -1:]
    total = low[:, :, -1:]
    score = np.empty((*h.shape[:2], places, 2))
    for default in (0, 1):
        left, right = low[:, :, :-1] + missing * default, total - low[:, :, :-1] + missing * (1 - default)
        score[..., default] = _worth(left, task) + _worth(right, task)
    score[np.arange(places) >= n_cuts[..., None]] = -np.inf
    at = score.reshape(len(h), -1).argmax(1)
    k, cut, default = np.unravel_index(at, score.shape[1:])
    return chosen[np.arange(len(h)), k], cut.astype(np.int16), default.astype(bool)


def grow(rows: DataFrame, schema, trees: int, depth: int, max_features: int, noise: Noise, models: int = 1) -> list[list[dict]]:
    """The trees of each model. rows: staged, with b (bins, null where missing), s (class, or fixed-point target), tree, and fold: a row
    takes no part in the model of its fold, from 1; 0 is no fold."""
    task, slots, context = schema.task, schema.bins, rows.sparkSession.sparkContext
    cuts, shards, grown = np.array(list(map(len, schema.cuts))), models * trees, Grown(models * trees)
    of = lambda shard: f"tree {shard % trees} model {shard // trees}"
    for level in range(depth):
        width = 1 << level
        chosen = np.stack([candidates(schema, trees, depth, max_features, level, t) for t in range(trees)])
        state, size = context.broadcast((grown, chosen)), width * max_features * slots

        def cells_of(b: np.ndarray, shard: np.ndarray, level: int = level, state=state) -> np.ndarray:
            so_far, options = state.value
            node = so_far.nodes(b, shard, level)
            feature = options[shard % trees, node]
            x = np.take_along_axis(b, feature.astype(np.int64), 1)
            return (node[:, None] * max_features + np.arange(max_features)) * slots + np.where(x < 0, slots - 1, x)

        def search(key, table):  # without hints, which Spark would resolve; it runs before the level ends
            shard = key[0].as_py()
            h = np.clip(noise(_pairs(table, size, task).ravel(), f"level {level} {of(shard)}").reshape(width, max_features, slots, 2), 0, None)
            if task == "regression":
                h[..., 1] = np.minimum(h[..., 1], h[..., 0])
            feature, cut, left = best_splits(h, state.value[1][shard % trees], cuts, task)
            return pa.table({"shard": np.full(width, shard, np.int32), "node": np.arange(width, dtype=np.int32), "feature": feature.astype(np.int16), "cut": cut, "default_left": left})

        found = _cells(rows, models, trees, size, cells_of).groupBy("shard").applyInArrow(search, "shard int, node int, feature smallint, cut smallint, default_left boolean").toArrow()
        shard, node, *values = (found.column(c).to_numpy() for c in ("shard", "node", "feature", "cut", "default_left"))
        out = [np.zeros((shards, width), v.dtype) for v in values]
        for array, v in zip(out, values, strict=True):
            array[shard, node] = v
        grown.add(*out)
        state.unpersist()
    state, leaves = context.broadcast(grown), 1 << depth

    def values_of(key, table):
        from .trees import leaf_values

        shard = key[0].as_py()
        stats = noise(_pairs(table, leaves, task).ravel(), f"leaves {of(shard)}").reshape(leaves, 2)
        return pa.table({"shard": np.full(leaves, shard, np.int32), "leaf": np.arange(leaves, dtype=np.int32), "value": leaf_values(stats, schema)})

    sums = _cells(rows, models, trees, leaves, lambda b, shard: state.value.nodes(b, shard, depth))
    found = sums.groupBy("shard").applyInArrow(values_of, "shard int, leaf int, value double").toArrow()
    value = np.zeros((shards, leaves))
    value[found.column("shard").to_numpy(), found.column("leaf").to_numpy()] = found.column("value").to_numpy()
    every = [{"features": grown.feature[k].tolist(), "cuts": grown.cut[k].tolist(), "default_left": grown.default_left[k].tolist(), "leaves": value[k].tolist()} for k in range(shards)]
    return [every[m * trees : (m + 1) * trees] for m in range(models)]


def assigned(rows: DataFrame, schema, key: bytes, trees: int) -> DataFrame:
    """Binned rows (b, y, fold) with the tree that each trains, by a keyed hash of its bins and target, and s; staged."""
    from ..functions import keyed

    tree = keyed.tree_of(key, [F.get("b", k) for k in range(len(schema.features))], F.col("y"), trees)
    y = schema.unit_target(F.col("y"))
    return store.staged(rows.select("b", (y.cast("long") if schema.task == "binary" else F.rint(y * SCALE).cast("long")).alias("s"), tree.alias("tree"), "fold"), "assigned")
