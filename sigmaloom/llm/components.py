"""Connected components by alternating large-star and small-star rounds, and bitmaps of bounded size over hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: links each node's larger neighbours to its smallest neighbour or itself. Otherwise: links each node and its smaller
    neighbours to the smallest of them."""
    if large:
        ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of it) for each node with an edge to another. edges: columns u, v of one ordered type.

    Each round is written to the shared folder. Hubs are pre-aggregated before their shuffle, and the join that gives a hub's
    minimum to its neighbours is one that the adaptive skew join can split. Null ends and loops are no edges."""
    now = common.staged(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = common.staged(_stars(_stars(now, large=True), large=False), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("decimal(20,0)"))).first()
        if row == seen:
            break
        seen = row
        if not row[0]:
            break
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


#: Bits of a bitmap for each key, and the least and the most of its size as powers of two: 8 KB to 32 MB.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 16, 28


def bitmap_of_most(df: DataFrame, hash_col: str, count_col: str, least: int) -> np.ndarray:
    """A bitmap, set at the lowest bits of the hashes whose count is `least` or more, or if those are too many for BITS_A_KEY bits
    each, twice that or more, and so on; so its size is bounded and it never fills up. df has a row for each hash. Built by bitwise
    or on the executors."""
    keys = df.where(F.col(count_col) >= least).count()
    while BITS_A_KEY * keys > 1 << MOST_BITS:
        least *= 2
        keys = df.where(F.col(count_col) >= least).count()
    bits = max(LEAST_BITS, (BITS_A_KEY * keys).bit_length())
    word, bit = F.expr(f"shiftright({hash_col} & {(1 << bits) - 1}, 6)"), F.expr(f"shiftleft(1L, cast({hash_col} & 63 as int))")
    found = df.where(F.col(count_col) >= least).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those that the bitmap was made from; never wrong with no."""
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
