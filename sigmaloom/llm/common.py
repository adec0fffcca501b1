"""Shared plumbing: the cluster-wide scratch folder, staged tables, and vectorised words over Arrow text buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_path, shared_root, staged, temporary_table  # noqa: F401  re-exported

#: Bytes that separate words: space and \t \n \v \f \r.
WORD_BREAKS = (9, 10, 11, 12, 13, 32)
#: Bytes hashed at once; the working arrays hold eight bytes for each of them.
BLOCK_BYTES = 1 << 20
#: Bytes of text handed to a vectorised step at once; one document may exceed it.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers receive, by rows and by bytes, for this session from now on; a bound of the
    session that is tighter stays. It cannot be set back here, as frames run later than they are made."""
    for name, most in (("maxRecordsPerBatch", 4096), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that are none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


#: A key is hot if more than one in this many rows have it; so there are fewer hot keys than this.
HOT = 10_000


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], count: str, drop: bool = True) -> DataFrame:
    """rows joined with `one`, which has a row for each key and in `count` the number of rows with it. Hot keys are joined by
    broadcast, where the rows lie; there are fewer than HOT of them, whatever the data. `one` should be staged."""
    total = one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) * HOT > total
    flag = new_names(rows, "hot")[0]
    few, most = one.where(hot), one.where(~hot)
    marked = rows.join(F.broadcast(few.select(*keys, F.lit(True).alias(flag))), keys, "left")
    found = marked.where(F.col(flag).isNull()).drop(flag).join(most.hint("merge"), keys)
    found = found.unionByName(marked.where(flag).drop(flag).join(F.broadcast(few), keys))
    return found.drop(count) if drop else found


def shape(fields: str) -> pa.Schema:
    """An Arrow schema from "name type, ..." with the types of this module's operators."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "longs": pa.list_(pa.int64()), "ints": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(","))])


def spark_type(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text column of each holds about `most` bytes at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(text)
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; a null row is empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longest word that is hashed in vectorised steps; a longer one is hashed by itself.
LONG_WORD = 512
_PRIME = np.uint64((1 << 61) - 1)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(WORD_BREAKS)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The first k bytes of eight, little-endian.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _word_hashes(block: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step. Every step is mixed, so no arrangement of letters cancels out."""
    size = end - start
    eight = np.ndarray(len(block), "<u8", np.concatenate([block, np.zeros(8, np.uint8)]).data, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64(0x1234567))
    live, at, left = np.flatnonzero(size <= LONG_WORD), start, size
    while len(live):
        value = eight[at[live]] & _FIRST[np.minimum(left[live], 8)]
        h[live] = mix(h[live] * np.uint64(_BASE) ^ value)
        at, left = at + 8, left - 8
        live = live[left[live] > 0]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(block[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _FOLD[data]


def same_words(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether each word of the bytes a equals its partner of the bytes b, eight bytes a step."""
    eight = [np.ndarray(len(x), "<u8", np.concatenate([x, np.zeros(8, np.uint8)]).data, strides=(1,)) for x in (a, b)]
    same = a_size == b_size
    live, done = np.flatnonzero(same & (a_size <= LONG_WORD)), 0
    while len(live):
        mask = _FIRST[np.minimum(a_size[live] - done, 8)]
        same[live] = (eight[0][a_start[live] + done] & mask) == (eight[1][b_start[live] + done] & mask)
        done += 8
        live = live[same[live] & (a_size[live] > done)]
    for i in np.flatnonzero(same & (a_size > LONG_WORD)).tolist():
        n = a_size[i]
        same[i] = np.array_equal(a[a_start[i] : a_start[i] + n], b[b_start[i] : b_start[i] + n])
    return same


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word [^\\x20\\x09-\\x0D]+; no word spans two rows. fold: A-Z count as a-z."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64)
    firsts = np.zeros(n + 1, bool)
    firsts[offsets] = True
    parts, lo = [], 0
    while lo < n:
        hi = min(n, lo + BLOCK_BYTES)
        while hi < n and not firsts[hi] and not _IS_BREAK[data[hi]]:
            hi += 1  # a block ends where no word goes on
        block = data[lo:hi]
        gap = _IS_BREAK[block]
        before = firsts[lo:hi].copy()
        before[1:] |= gap[:-1]
        before[0] = True
        after = firsts[lo + 1 : hi + 1].copy()
        after[:-1] |= gap[1:]
        after[-1] = True
        s, e = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
        parts.append((s + lo, e + lo, _word_hashes(_FOLD[block] if fold else block, s, e)))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of `length` consecutive hashes; every place has a multiplier of its own."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    by = mix(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full(n - length + 1, length, np.uint64)
    for k in range(length):
        out += hashes[k : n - length + 1 + k] * by[k]
    return mix(out)


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of factors below it, by halves of 31 bits."""
    low, half, m30 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    return _folded(np.uint64(2) * (a1 * b1) + (mid >> np.uint64(30)) + ((mid & m30) << half) + a0 * b0)


class Powers:
    """Powers of a base modulo 2^61 - 1 and of its inverse, grown as they are needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, int(_PRIME))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _times(self.up, np.uint64(pow(self.base, k, int(_PRIME))))])
            self.down = np.concatenate([self.down, _times(self.down, np.uint64(pow(self.inverse, k, int(_PRIME))))])
        return self.up, self.down


_POWERS = (Powers(0x1234567DEADBEEF), Powers(0x0A5F3C9917B2D4E1))


class Spans:
    """Hashes of spans of hashes, by sums over powers modulo a prime, at which equal parts of different texts do not cancel out.
    lane: of two independent bases."""

    def __init__(self, hashes: np.ndarray, lane: int = 0) -> None:
        n = len(hashes)
        up, self.down = _POWERS[lane].need(n + 1)
        x = _times(_folded(hashes), up[:n])
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(x & np.uint64(0xFFFFFFFF), out=self.low[1:])
        np.cumsum(x >> np.uint64(32), out=self.high[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of hashes[start:end] for each pair."""
        low, high = self.low[end] - self.low[start], self.high[end] - self.high[start]
        total = _folded(_folded(low) + _times(_folded(high), np.uint64(1 << 32)))
        return mix(_times(total, self.down[start]) ^ (mix((end - start).astype(np.uint64))))


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of hashes[start:end] for each pair."""
    return Spans(hashes, lane).of(start, end)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
