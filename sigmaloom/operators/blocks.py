"""Users' functions over disjoint blocks of units. Spark workers are no sandbox: run trusted code only.

A function that needs a whole block as a matrix (`block_updates`) has its block in one task. A fold (`folded_updates`) sees the rows batch by
batch where they lie: each task keeps one state for each block, states are merged in two steps, and no task holds a block's rows, so a block
may have any number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from .privacy import sample_and_aggregate

Update = Callable[[np.ndarray, np.ndarray, dict], np.ndarray]


def block_updates(frame: DataFrame, features: list[str], update: Update, config: dict, key: bytes, blocks: int, size: int) -> list[np.ndarray]:
    """An update of `size` numbers for each block; a block that is empty, fails, or returns a wrong shape or a value that is not
    finite gives zeros. Blocks are bounded by the run: units are dealt to 2 to 64 of them by a keyed hash."""
    dealt = frame.withColumn("block", keyed.block(key, F.col("unit"), blocks))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size)
        try:
            got = np.asarray(update(rows[features].to_numpy(float), rows["y"].to_numpy(float), dict(config)), float).ravel()
            if got.shape == (size,) and np.isfinite(got).all():
                out = got
        except Exception:  # noqa: BLE001  a user's function may raise anything, and its failure must not show
            pass
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "update": [out.tolist()]})

    found = {r["block"]: np.array(r["update"]) for r in dealt.select("block", "y", *features).groupBy("block").applyInPandas(run, "block int, update array<double>").collect()}
    return [found.get(b, np.zeros(size)) for b in range(blocks)]


class Fold(Protocol):
    """A user's function as a fold over rows; a state is an array of numbers, of MOST_STATE at most. Its result does not depend on how rows are split
    if update and merge are sums."""

    def init(self) -> np.ndarray: ...

    def update(self, state: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def finish(self, state: np.ndarray) -> np.ndarray: ...


#: Numbers of a state, and the parts in which the states of all tasks are merged first.
MOST_STATE, PARTS = 1 << 20, 32


def _state(x: object) -> np.ndarray:
    out = np.ascontiguousarray(np.asarray(x, np.float64).ravel())
    if len(out) > MOST_STATE:
        raise ValueError("a state is too large")
    return out


def folded_updates(frame: DataFrame, features: list[str], fold: Fold, key: bytes, blocks: int, size: int) -> list[np.ndarray]:
    """An update of `size` numbers for each block, by a fold over its rows. A block that is empty, whose fold fails in any task, or that ends in a wrong
    shape or a value that is not finite gives zeros; the other blocks are not touched by that. Missing numbers are NaN."""
    dealt = frame.select(keyed.block(key, F.col("unit"), blocks).alias("block"), F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    shape = "block int, part int, state binary"

    def row(block: int, part: int, state: np.ndarray | None) -> tuple:
        return block, part, None if state is None else state.tobytes()

    def table(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, np.ndarray | None] = {}  # None: the fold failed
        for batch in batches:
            of, y, *x = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            x = np.column_stack([c.astype(float) for c in x]) if x else np.zeros((len(of), 0))
            for block in np.unique(of).tolist():
                mine = of == block
                try:
                    if block not in states or states[block] is not None:
                        at = states[block] if block in states else _state(fold.init())
                        states[block] = _state(fold.update(at, x[mine], y[mine].astype(float)))
                except Exception:  # noqa: BLE001  a user's function may raise anything, and its failure must not show
                    states[block] = None
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays(table([row(b, part, s) for b, s in states.items()]), names=["block", "part", "state"])

    def merged(states: list[bytes | None]) -> np.ndarray | None:
        at = None
        try:
            for s in states:
                if s is None:
                    return None
                at = np.frombuffer(s) if at is None else _state(fold.merge(at, np.frombuffer(s)))
        except Exception:  # noqa: BLE001
            return None
        return at

    def merge_part(key, rows):
        return pa.table(table([row(key[0].as_py(), key[1].as_py(), merged(rows.column("state").to_pylist()))]), names=["block", "part", "state"])

    def merge_block(key, rows):
        out = np.zeros(size)
        try:
            state = merged([s for _, s in sorted(zip(rows.column("part").to_pylist(), rows.column("state").to_pylist(), strict=True), key=lambda r: r[0])])
            got = None if state is None else np.asarray(fold.finish(state), float).ravel()
            if got is not None and got.shape == (size,) and np.isfinite(got).all():
                out = got
        except Exception:  # noqa: BLE001
            pass
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "update": pa.array([out.tolist()], pa.list_(pa.float64()))})

    parts = dealt.mapInArrow(run, shape).groupBy("block", "part").applyInArrow(merge_part, shape)
    found = {r["block"]: np.array(r["update"]) for r in parts.groupBy("block").applyInArrow(merge_block, "block int, update array<double>").collect()}
    return [found.get(b, np.zeros(size)) for b in range(blocks)]


def private_fold(frame: DataFrame, features: list[str], fold: Fold, key: bytes, secret: bytes, blocks: int, size: int, clip: float, epsilon: float, delta: float) -> np.ndarray:
    return sample_and_aggregate(folded_updates(frame, features, fold, key, blocks, size), clip, epsilon, delta, secret, "folds")


def private_update(frame: DataFrame, features: list[str], update: Update, config: dict, key: bytes, secret: bytes, blocks: int, size: int, clip: float, epsilon: float, delta: float) -> np.ndarray:
    return sample_and_aggregate(block_updates(frame, features, update, config, key, blocks, size), clip, epsilon, delta, secret, "blocks")
