"""An extension, no part of the batch operators: association cells and score histograms of streams, and their release.

Sufficient vectors are additive, so they run as windowed counts. With a watermark a window is emitted once, when it
closes, which is when it is released.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import privacy
from ..sources import results


def windowed_counts(stream: DataFrame, time_col: str, coord: Column, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, coord, value of each closed window; coordinates that do not occur are absent (the layout is public)."""
    timed = stream.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    counted = timed.groupBy(F.window("_t", window).alias("w"), coord.cast("long").alias("coord")).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(F.col("w.start").alias("start"), "coord", "value")


def release_closed(counts: DataFrame, folder: str, checkpoint: str, size: int, sigma: float, secret: bytes, layout: dict, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that releases the vector of each window (coordinates 0 to size - 1) with Gaussian noise, when the watermark closes it. counts: of
    `windowed_counts`; in append mode a window's cells come once, together.

    A window's release is a claim of the shared guard in `folder`: a batch that is run again after a failure, or by another driver, gets the
    answer that was given, and a window whose cells differ from those that were claimed is refused. The noise is bound to the window and its
    vector besides. A batch has the windows that closed since the last one, `size` numbers each; they come to the driver one by one."""

    def release(batch: DataFrame, _: int) -> None:
        guard = results.SharedGuard(batch.sparkSession, folder)
        cells = batch.where(F.col("coord").between(0, size - 1)).select(F.col("start").cast("long").alias("start"), "coord", "value")
        vectors = cells.groupBy("start").agg(F.map_from_entries(F.collect_list(F.struct("coord", "value"))).alias("cells")).orderBy("start")
        for row in vectors.toLocalIterator():
            vector = np.zeros(size)
            for coord, value in row["cells"].items():
                vector[coord] = value
            name, request = row["start"], {"cells": privacy.semantic_seed(secret, vector).hex(), "layout": layout, "sigma": sigma}
            answer = lambda v=vector, n=name: {"start": n, "values": privacy.release(v, sigma, secret, "window", layout | {"window": n}).tolist()}
            guard.claim(f"window {name}", 0, 0, request, answer)

    writer = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(release)
    return (writer.trigger(**trigger) if trigger else writer).start()


def released(spark: SparkSession, folder: str, starts: Sequence[int]) -> dict[int, list[float]]:
    """The released vectors of those of the windows, by their starts in seconds, that were closed."""
    files, out = results.Files(spark, folder), {}
    for start in starts:
        name = hashlib.sha256(json.dumps([f"window {start}", 0, 0]).encode()).hexdigest()
        found = files.read(f"{name}.json")
        if found is not None:
            out[start] = json.loads(found)["values"]
    return out
