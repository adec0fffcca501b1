"""Embedding whitening by a bit-sliced scatter.

Each entry c, as double, is the integer x = floor(1024 c) + 100000. The least x of every dimension is taken off, so that what is
left has few bits; each dimension's bit planes are packed across rows into 64-bit words. The number of rows with bit a in one
dimension and bit b in another is the popcount of two planes' AND, and these counts, weighted by 2^(a+b), are the exact sums of
products. They are added up over tasks as limbs of LIMB bits, so they stay exact for entries of any size and any number of rows, and are
centred as integers, n * sum(x y) - sum(x) * sum(y), before a double is made of them and `eigh` is run. The driver sees d (d + 1) / 2 sums,
whatever the rows; d is MOST_DIMENSIONS at most.

Edge cases: rows whose vector is null, has no entries, or holds a null, a NaN, an infinity or an entry of 2^52 or more in size (whose x fits
no long) are dropped; remaining vectors of different lengths raise ValueError; repeated rows and null ids stay and count each; an
empty table, and one vector or equal vectors only, give no rows, as no component has any spread. Components whose eigenvalue is zero to
double precision are left out. A deviation that does not fit a long is null, and its digits are in deviation_digits in any case. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET = 1024, 100_000
#: Rows whose planes are packed at once; a multiple of 64.
ROWS = 16_384
#: Bits of weight that one limb of a sum spans. A limb is below 2^LIMB * (bits of a dimension) * rows, which fits a long up to 2^40 rows.
LIMB = 16
MOST_DIMENSIONS = 4_096
#: An eigenvalue counts as zero if it is at most this share of the largest one, times the number of dimensions.
ZERO = 1e-14


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that remain."""
    common.small_batches(df.sparkSession)
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**52)
    vector = df[vector_col].cast("array<double>")
    return df.select(df[id_col].cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(F.forall("vector", fit))


def integers(column: pa.Array) -> np.ndarray:
    """The x of each vector, a row each; ValueError if their lengths differ."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and (column.value_lengths().to_numpy(zero_copy_only=False) * n != len(flat)).any():
        raise ValueError("vectors have different lengths")
    return np.floor(flat.reshape(n, -1) * float(SCALE)).astype(np.int64) + OFFSET


def planes(x: np.ndarray, least: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bit planes of x - least, one dimension's after the other from its lowest bit on, each packed across rows into words."""
    n, d = x.shape
    shifted = np.zeros((d, -(-n // 64) * 64), np.uint64)
    shifted[:, :n] = (x - least).T
    out = np.zeros((int(bits.sum()), shifted.shape[1] // 8), np.uint8)
    k = 0
    for i in range(d):
        for b in range(int(bits[i])):
            out[k] = np.packbits((shifted[i] >> np.uint64(b)).astype(np.uint8) & 1)
            k += 1
    return out.view(np.uint64)


def popcounts(packed: np.ndarray) -> np.ndarray:
    """The popcounts of the ANDs of every two planes, the second not before the first."""
    out = np.zeros((len(packed), len(packed)), np.int64)
    for k in range(len(packed)):
        out[k, k:] = np.bitwise_count(packed[k:] & packed[k]).sum(axis=1, dtype=np.int64)
    return out


def limbs(counts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sums of products by limb: [limb, i, j] for i <= j, of which the sum over limbs of 2^(LIMB limb) times it is the sum of y_i y_j. Popcounts
    below the diagonal are those of the mirrored pair."""
    d = len(bits)
    whole = counts + np.triu(counts, 1).T
    owner, bit = np.repeat(np.arange(d), bits), np.concatenate([np.arange(b) for b in bits] or [np.zeros(0, np.int64)]).astype(np.int64)
    weight = bit[:, None] + bit[None, :]
    first = np.cumsum(bits) - bits
    some = bits > 0
    out = np.zeros((int(2 * max(bits, default=0)) // LIMB + 1, d, d), np.int64)
    if not len(owner):
        return out
    for k in range(len(out)):
        here = np.where(weight // LIMB == k, whole << (weight % LIMB), 0)
        out[k][np.ix_(some, some)] = np.add.reduceat(np.add.reduceat(here, first[some], axis=0), first[some], axis=1)
    return out


@dataclass(frozen=True)
class Fit:
    """n, the sums S of x by dimension, and unit eigenvectors, as columns, by falling eigenvalue of x's covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def ranges(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, and the least and the largest x of each dimension, which are added up by dimension on the way to the driver."""
    schema = common.shape("dimension int, n long, least long, most long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(0))
            if low is not None and len(low) != x.shape[1]:
                raise ValueError("vectors have different lengths")
            low, high = (x.min(0), x.max(0)) if low is None else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(np.full(len(low), n)), pa.array(low), pa.array(high)], schema=schema)

    found = vectors.select("vector").mapInArrow(run, common.spark_type(schema)).groupBy("dimension").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    rows = sorted(found.orderBy("dimension").limit(MOST_DIMENSIONS + 1).collect())
    if len(rows) > MOST_DIMENSIONS:
        raise ValueError(f"vectors have more than {MOST_DIMENSIONS} dimensions")
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("vectors have different lengths")
    return rows[0]["n"] if rows else 0, np.array([r["least"] for r in rows], np.int64), np.array([r["most"] for r in rows], np.int64)


def products(vectors: DataFrame, least: np.ndarray, most: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """The exact sums of y and of y_i y_j, y being x - least, over all rows."""
    d = len(least)
    bits = np.array([int(b - a).bit_length() for a, b in zip(least.tolist(), most.tolist(), strict=True)], np.int64)
    schema = common.shape("cell long, limb int, value long")
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((int(bits.sum()), int(bits.sum())), np.int64)
        waiting, n = [], 0

        def packed() -> None:
            if n:
                scatter[:] += popcounts(planes(np.concatenate(waiting), least, bits))

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = integers(batch.column(0).slice(lo, ROWS))
                if n + len(part) > ROWS:
                    packed()
                    waiting, n = [], 0
                waiting.append(part)
                n += len(part)
        packed()
        for k, sums in enumerate(limbs(scatter, bits)):
            value = sums[upper]
            at = np.flatnonzero(value)
            yield pa.RecordBatch.from_arrays([pa.array(upper[0][at] * d + upper[1][at]), pa.array(np.full(len(at), k, np.int32)), pa.array(value[at])], schema=schema)
        # a plane with itself counts the rows that have the bit: the sums of y, as cells from d * d on
        alone, first = np.diagonal(scatter), np.cumsum(bits) - bits
        bit = np.arange(len(alone)) - np.repeat(first, bits)
        owner = np.repeat(np.arange(d), bits)
        for k in range(int(max(bits, default=0)) // LIMB + 1):
            here = bit // LIMB == k
            value = np.zeros(d, np.int64)
            np.add.at(value, owner[here], alone[here] << (bit[here] % LIMB))
            yield pa.RecordBatch.from_arrays([pa.array(d * d + np.arange(d)), pa.array(np.full(d, k, np.int32)), pa.array(value)], schema=schema)

    rows = vectors.select("vector").mapInArrow(run, common.spark_type(schema)).groupBy("cell", "limb").agg(F.sum("value").alias("value")).toArrow()
    sums, cross = [0] * d, [[0] * d for _ in range(d)]
    for cell, limb, value in zip(*(rows.column(c).to_pylist() for c in ("cell", "limb", "value")), strict=True):
        if cell >= d * d:
            sums[cell - d * d] += value << LIMB * limb
        else:
            cross[cell // d][cell % d] += value << LIMB * limb
    return sums, cross


def fit(vectors: DataFrame) -> Fit | None:
    """The fit of all `usable` rows, or None if there are none."""
    n, least, most = ranges(vectors)
    if not n:
        return None
    sums, cross = products(vectors, least, most)
    d, over = len(sums), n * n
    centred = [[n * cross[i][j] - sums[i] * sums[j] for j in range(i, d)] for i in range(d)]  # of y, which is that of x
    covariance = np.zeros((d, d))
    for i in range(d):
        covariance[i, i:] = [c / over for c in centred[i]]
    covariance += np.triu(covariance, 1).T
    values, found = np.linalg.eigh(covariance)
    kept = [k for k in range(d - 1, -1, -1) if values[k] > ZERO * d * values[-1] and values[k] > 0]
    trace = sum(centred[i][0] for i in range(d)) / over
    return Fit(n, tuple(s + n * a for s, a in zip(sums, least.tolist(), strict=True)), values[kept], found[:, kept], trace)


def _whitened(x: np.ndarray, model: Fit, most: int) -> np.ndarray:
    """(x - S / n) on the first components, over the roots of their eigenvalues."""
    n, least = model.n, [s // model.n for s in model.sums]
    rest = np.array([(s - a * n) / n for s, a in zip(model.sums, least, strict=True)])  # what S / n has beyond its whole part
    return ((x - np.array(least, np.int64)) - rest) @ (model.vectors[:, :most] / np.sqrt(model.values[:most]))


def identity_error(vectors: DataFrame, model: Fit, most: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from sums over all rows."""
    k = min(most, len(model.values))
    schema = common.shape("cell int, value double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                z = _whitened(integers(batch.column(0)), model, k)
                total += np.vstack([z.T @ z, z.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], schema=schema)

    rows = vectors.select("vector").mapInArrow(run, common.spark_type(schema)).groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["cell"]] = r["value"] / model.n
    total = total.reshape(k + 1, k)
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0.0))


def _deviations(x: np.ndarray, model: Fit) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 of each row."""
    n, sums = model.n, model.sums
    far = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), sums, strict=True)), default=0)
    if far * far * len(sums) < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        away = x * n - np.array(sums, np.int64)
        return (away * away).sum(1).tolist()
    away = x.astype(object) * n - np.array(sums, object)
    return (away * away).sum(1).tolist()


def whiten(df: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining row and component up to `most`: vec_id, component from 1, n, deviation, whitened, explained,
    identity_error, deviation_digits."""
    vectors = usable(df, id_col, vector_col)
    model = fit(vectors)
    schema = common.shape("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string")
    k = min(most, len(model.values)) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], common.spark_type(schema))
    error = identity_error(vectors, model, k)
    share = model.values[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(1))
            n, deviations = len(x), _deviations(x, model)
            each = np.repeat(np.arange(n), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, model.n)),
                pa.array([v if v < 1 << 63 else None for v in deviations], pa.int64()).take(pa.array(each)),
                pa.array(_whitened(x, model, k).ravel()),
                pa.array(np.tile(share, n)),
                pa.array(np.full(n * k, error)),
                pa.array(map(str, deviations), pa.string()).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return vectors.mapInArrow(run, common.spark_type(schema))
