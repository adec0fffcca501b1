"""Substring dedup by relative Lempel-Ziv parsing against an index of every document's blocks.

Reference blocks are cut where the text says, not where documents do: each window of WINDOW words has an anchor, the least hash
among its runs of GRAM words, and a block is a longest run of windows with one anchor. So equal passages are cut into equal
blocks but for their edges, and a block can only hold windows of blocks with the same anchor: those are the blocks that it is
factored against, wherever they lie.

* A block whose anchor has one content in all documents is one factor: it is copied whole from the earliest of them.
* Blocks of other anchors come together in the order of their documents. Each is parsed from left to right: where a window stands in
  the reference of earlier documents, the factor goes on from that place for as long as both agree, and the next factor
  begins with the next window, which crosses the boundary and is looked up by itself; what is not found is a literal and
  joins the reference. A factor of n windows copies n + WINDOW - 1 words, so every factor is long enough to count.
* An anchor with more than HOT_BLOCKS blocks does not come to one task: its windows are joined one by one, with the same result.

A document's factors and its own repeats, united, are its duplicate spans. A window is a duplicate if its words also start
earlier: in a document with a smaller doc_id, or earlier in the same one. Windows are judged on the input.

What is shuffled: a row for each block (about one for eight words), twice; the window hashes of blocks whose anchors vary; the texts,
to make these hashes and to cut the spans. Windows are told apart by their hash and their anchor, 128 bits.

Edge cases: null text and text without words have no words; texts of fewer than WINDOW words lose none;
rows that share a doc_id are documents of their own, none earlier than the other; a null doc_id counts as larger than
any other; texts are read whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 20, 5
#: Blocks of one anchor that one task parses.
HOT_BLOCKS = 20_000
_LAST = (1 << 63) - 1


class Parsed:
    """The windows and blocks of a batch of texts. Window s is that of words s to s + WINDOW - 1 of the batch; `of` tells the text
    of each, `valid` whether it lies in one text. Blocks: windows first[b] to last[b], anchor[b], owner[b] (the text)."""

    def __init__(self, batch: pa.RecordBatch, text: int) -> None:
        data, offsets = common.text_bytes(batch.column(text))
        start, _, self.h = common.words(data, offsets, fold=False)
        self.at = np.searchsorted(start, offsets)  # words of each text
        doc = np.repeat(np.arange(batch.num_rows), np.diff(self.at))
        n = max(0, len(self.h) - WINDOW + 1)
        self.of = doc[:n]
        self.valid = self.of == doc[WINDOW - 1 :] if n else np.zeros(0, bool)
        least = common.runs(self.h, GRAM)
        width = 1
        while width < WINDOW - GRAM + 1:  # the least of ever wider runs of grams
            step = min(width, WINDOW - GRAM + 1 - width)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            width += step
        spot = np.flatnonzero(self.valid)
        a, d = least[spot], self.of[spot]
        new = np.ones(len(spot), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        b = np.flatnonzero(new)
        self.first, self.last = spot[b], spot[np.append(b[1:], len(spot)) - 1] if len(spot) else spot
        self.anchor, self.owner = a[b], d[b]

    def windows(self) -> np.ndarray:
        """The hash of each window."""
        return common.runs(self.h, WINDOW)

    def contents(self) -> np.ndarray:
        """The hash of each block's words."""
        return common.span_hashes(self.h, self.first, self.last + WINDOW)

    def repeats(self, hashes: np.ndarray) -> np.ndarray:
        """The windows whose words start earlier in the same text, in order. Close repeats are compared directly. Others have
        one anchor, in two blocks of the text or in one longer than a single occurrence of the anchor allows."""
        near, reach = np.zeros(len(hashes), bool), WINDOW - GRAM + 1
        for step in range(1, min(reach, len(hashes) - 1) + 1):
            near[step:] |= (hashes[step:] == hashes[:-step]) & (self.of[step:] == self.of[:-step])
        near &= self.valid
        long = self.last - self.first + 1 > reach
        order = np.lexsort((self.anchor, self.owner))
        a, o = self.anchor[order], self.owner[order]
        same = (a[1:] == a[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        blocks = np.flatnonzero(long | twice)
        spot = _ranges(self.first[blocks], self.last[blocks] - self.first[blocks] + 1)
        spot = spot[np.lexsort((spot, hashes[spot], self.of[spot]))]
        near[spot[1:][(hashes[spot[1:]] == hashes[spot[:-1]]) & (self.of[spot[1:]] == self.of[spot[:-1]])]] = True
        return np.flatnonzero(near)


class Reference:
    """The windows of one anchor's blocks that were seen so far, and the parse of a block against them."""

    def __init__(self) -> None:
        self.windows: list[int] = []
        self.doc: list[int] = []  # the document of each
        self.at: dict[int, int] = {}  # the first place of a window

    def factors(self, block: list[int], doc: int) -> list[tuple[int, int, int]]:
        """(first window, windows, document copied from) of each factor of a block, whose document is no earlier than those before.
        What is new is added."""
        out, i, n = [], 0, len(block)
        windows, docs, at = self.windows, self.doc, self.at
        fresh: list[int] = []
        while i < n:
            p = at.get(block[i])
            if p is None:
                fresh.append(block[i])
                i += 1
                continue
            if docs[p] >= doc:  # of the same document
                i += 1
                continue
            k, source = 1, docs[p]
            while i + k < n and p + k < len(windows) and docs[p + k] == source and windows[p + k] == block[i + k]:
                k += 1
            out.append((i, k, source))
            i += k
        for w in fresh:
            if w not in at:
                at[w] = len(windows)
                windows.append(w)
                docs.append(doc)
        return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., of length[0]; then those of start[1]; ..."""
    if not len(start):
        return np.zeros(0, np.int64)
    total = np.cumsum(length)
    return np.arange(total[-1]) + np.repeat(start - np.append(0, total[:-1]), length)


def _covered(n: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of n words are in a window of the runs of `count` windows from `first`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + WINDOW - 1, -1)
    return np.cumsum(edge)[:n] > 0


def _spans(mask: np.ndarray) -> list[int]:
    """First word and number of words of each run, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return np.stack([edge[::2], edge[1::2] - edge[::2]], 1).ravel().tolist()


def _row(text: bytes, n: int, first: np.ndarray, count: np.ndarray) -> tuple[int, int, str, list[int]]:
    if not len(first):
        return n, 0, hashlib.sha256(b" ".join(text.split())).hexdigest(), []
    mask = _covered(n, first, count)
    kept = b" ".join(compress(text.split(), (~mask).tolist()))
    return n, int(mask.sum()), hashlib.sha256(kept).hexdigest(), _spans(mask)


def _raw(batch: pa.RecordBatch, text: int) -> list[bytes]:
    data, offsets = common.text_bytes(batch.column(text))
    whole = data.tobytes()
    return [whole[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _blocks(texts: DataFrame) -> DataFrame:
    """A row for each block: anchor, content, d, t (the document), first, count (its windows)."""
    schema = common.shape("anchor long, content long, d long, t long, first int, count int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 3):
            p = Parsed(batch, 3)
            d, t = (batch.column(k).to_numpy()[p.owner] for k in (1, 2))
            columns = (common.signed(p.anchor), common.signed(p.contents()), d, t, (p.first - p.at[p.owner]).astype(np.int32), (p.last - p.first + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return texts.mapInArrow(run, common.spark_type(schema))


def _opened(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """anchor, d, t, first, hot and the window hashes of the blocks asked for: d, t, blocks (anchor, first, count, hot)."""
    schema = common.shape("anchor long, d long, t long, first int, hot boolean, windows longs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 3):
            p, lists = Parsed(batch, 3), batch.column(4)
            blocks, sizes = lists.flatten(), np.diff(np.array(lists.offsets))
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            anchor, first, count, hot = (blocks.field(k) for k in ("anchor", "first", "count", "hot"))
            at = p.at[owner] + np.array(first)
            windows = p.windows()[_ranges(at, np.array(count, np.int64))]
            ends = pa.array(np.append(0, np.cumsum(np.array(count, np.int64))), pa.int32())
            d, t = (pa.array(batch.column(k).to_numpy()[owner]) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([anchor, d, t, first, hot, pa.ListArray.from_arrays(ends, pa.array(common.signed(windows)))], schema=schema)

    return texts.join(asked, ["d", "t"]).select("doc_id", "d", "t", "text", "blocks").mapInArrow(run, common.spark_type(schema))


def _parsed(blocks: DataFrame) -> DataFrame:
    """d, t, first, count of the factors of blocks, anchor by anchor."""
    schema = common.shape("d long, t long, first int, count int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reference = None, Reference()
        for batch in batches:
            anchors, d, t, first = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for i, windows in enumerate(batch.column(4).to_pylist()):
                if anchors[i] != now:
                    now, reference = anchors[i], Reference()
                out += [(d[i], t[i], first[i] + at, n) for at, n, _ in reference.factors(windows, d[i])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ordered = blocks.select("anchor", "d", "t", "first", "windows").repartition("anchor").sortWithinPartitions("anchor", "d", "t", "first")
    return ordered.mapInArrow(run, common.spark_type(schema))


def _joined(blocks: DataFrame) -> DataFrame:
    """The same by single windows, for anchors of any number of blocks."""
    each = blocks.select("anchor", "d", "t", "first", F.posexplode("windows").alias("at", "w"))
    low = each.groupBy("anchor", "w").agg(F.min("d").alias("low"))
    return each.join(low, ["anchor", "w"]).where("d > low").select("d", "t", (F.col("first") + F.col("at")).alias("first"), F.lit(1).alias("count"))


def _cut(texts: DataFrame, copied: DataFrame) -> DataFrame:
    """The result of each document. copied: d, t and the arrays first, count of its factors."""
    schema = common.shape("doc_id long, n_words long, n_removed long, kept_sha256 string, removed longs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            p, out = Parsed(batch, 1), []
            again = p.repeats(p.windows())
            local = np.searchsorted(p.of[again], np.arange(batch.num_rows + 1))
            for i, (text, first, count) in enumerate(zip(_raw(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                mine = again[local[i] : local[i + 1]] - p.at[i]
                runs = np.concatenate([mine, np.array(first or [], np.int64)]), np.concatenate([np.ones(len(mine), np.int64), np.array(count or [], np.int64)])
                out.append(_row(text, int(p.at[i + 1] - p.at[i]), *runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return texts.join(copied, ["d", "t"], "left").select("doc_id", "text", "first", "count").mapInArrow(run, common.spark_type(schema))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) and removed (first word and
    number of words of each duplicate span, in turn) of each row."""
    common.small_batches(df.sparkSession)
    id_, text = df[id_col].cast("long"), df[text_col]
    # a document is its id and a hash of its text: rows that agree in both have one result
    texts = df.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(_LAST)).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), text.alias("text"))
    blocks = common.staged(_blocks(texts), "blocks")
    anchors = blocks.groupBy("anchor").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min("content").alias("a"), F.max("content").alias("z"), F.count(F.lit(1)).alias("blocks"))
    anchors = anchors.where("low < high").select("anchor", "low", (F.col("a") != F.col("z")).alias("varied"), (F.col("blocks") > HOT_BLOCKS).alias("hot"))
    shared = common.staged(blocks.join(anchors, "anchor").where("varied or d > low").select("anchor", "d", "t", "first", "count", "varied", "hot"), "shared")
    asked = shared.where("varied").distinct().groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "first", "count", "hot")).alias("blocks"))
    opened = common.staged(_opened(texts, asked), "opened")
    whole = shared.where("not varied").select("d", "t", "first", "count")
    factors = whole.unionByName(_parsed(opened.where("not hot"))).unionByName(_joined(opened.where("hot"))).distinct()
    copied = factors.groupBy("d", "t").agg(F.collect_list(F.struct("first", "count")).alias("x")).select("d", "t", F.col("x.first").alias("first"), F.col("x.count").alias("count"))
    return _cut(texts, copied)


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win FROM p),
f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS dup FROM s),
c AS (SELECT doc_id, i, word, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
