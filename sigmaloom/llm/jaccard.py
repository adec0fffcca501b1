"""N-gram Jaccard join by T-occurrence search.

A document's set is that of its distinct shingles of five words. Two documents link if their sets' Jaccard similarity is
0.8 or more. Documents of one set are one class; links between classes are searched in four steps, of which each loses none:

1. Shingles have one order for all documents: frequent ones last, then by hash. If two sets of at least `n` elements
   share ceil(0.8 n) of them, then the first n - ceil(0.8 n) + MATCHES elements of both share MATCHES or all that they share.
   These elements are posted: an inverted list of each shingle that two classes or more post. So a link is a pair with MATCHES
   (or all) lists in common, a T-occurrence problem over these lists. Which shingles count as frequent decides how long lists get,
   not what is found.
2. Stars: each class is counted on the lists of which one class is the first; pairs of a class and a first one that meet often enough
   are verified, and components of these links are found. That joins most of a group of near copies, however large, by a row for each
   posting and no pair inside the group.
3. What may be left are links between components. Lists inside one component are dropped, then classes on too few lists. Classes are
   dealt to blocks by their least hash, which near copies mostly share, and a block gets the lists of its classes: those
   entries whose component is larger than that of some class of the block on that list, so each pair of components
   is looked at from its smaller one, and a list that one large component fills costs as much as the others on it.
   In a block every class is a query of DivideSkip: its short lists are merged, its long ones are probed by
   binary search, and classes that reach the required count stay, if lengths and places allow a link. A block that gets
   many entries is divided by candidates. It gives out the classes that have a partner, not the pairs: of a group of near copies
   in two components there may be as many pairs as the product of their sizes.
4. Those classes are verified on their whole sets, again by DivideSkip: queries and candidates of a block meet in cells of bounded size,
   where each query is asked of all candidates at once, and gives a link for each component that it reaches. Components over
   all links are found by star rounds.

Edge cases: a text of fewer than five words is one shingle of all its words; null text and text without words have an empty set, no
link, and are their own component; rows that share a doc_id are rows of their own and share what they link to; a null
doc_id counts for no minimum; texts are read whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import bitmap_of_most, components, in_bitmap

SHINGLE = 5
#: Shared elements by which prefixes are longer than one shared element needs.
MATCHES = 8
#: Documents from which a shingle counts as frequent, and the copies within one task's buffer from which it is reported.
FREQUENT, REPORTED = 16, 3
#: Postings of a block's own classes, and the entries that one group of a block holds, about.
BLOCK_POSTINGS, GROUP_ENTRIES = 200_000, 2_000_000
#: Candidates of one query of a star that are verified as one group, and elements of queries and of candidates that meet in one cell, about.
QUERY_BLOCK, CELL_ELEMENTS = 256, 2_000_000
_BUFFER = 4_000_000
#: Lists that a pair of classes must share, if their sizes are nq and nc: all that a link shares if that is less than MATCHES.
_ENOUGH = f"least({MATCHES}, (4 * greatest(nq, nc) + 4) div 5)"


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text."""
    data, offsets = common.text_bytes(batch.column(1))
    start, _, h = common.words(data, offsets, fold=True)
    at = np.searchsorted(start, offsets)
    grams = common.runs(h, SHINGLE)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= SHINGLE:
            out.append(np.unique(grams[a : z - SHINGLE + 1]))
        else:
            out.append(common.runs(h[a:z], z - a) if z > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """The name of a set: 128 bits, to which its size is added wherever sets are told apart."""
    if not len(s):
        return 0, 0
    a, b = common.mix(s), common.mix(s * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def required(n: int) -> int:
    """Elements that a set of n shares with any that it links with."""
    return (4 * n + 4) // 5


def prefix_length(n: int) -> int:
    return min(n, n - required(n) + MATCHES)


def links(a: int, b: int, shared: int) -> bool:
    return 100 * shared >= 80 * (a + b - shared)


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur on `least` or more of the sorted lists, and on how many. The longest lists are left out of the merge: an id
    needs `least` less their number on the others, which are merged; the long ones are then probed by binary search."""
    lists = sorted((x for x in lists if len(x)), key=len, reverse=True)
    if len(lists) < max(least, 1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_long = min(least - 1, int(least / (0.01 * math.log2(len(lists[0]) + 1) + 1)))
    merged = np.sort(np.concatenate(lists[n_long:]))
    at = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    shared = np.diff(at, append=len(merged))
    able = shared >= least - n_long
    left, shared = merged[at[able]], shared[able]
    for probed, held in enumerate(lists[:n_long]):
        able = shared + (n_long - probed) >= least
        left, shared = left[able], shared[able]
        if not len(left):
            break
        at = np.minimum(np.searchsorted(held, left), len(held) - 1)
        shared = shared + (held[at] == left)
    enough = shared >= least
    return left[enough], shared[enough]


class InvertedLists:
    """Entries (element, owner) by element: of each the owners that have it, in order."""

    def __init__(self, elements: np.ndarray, owner: np.ndarray) -> None:
        order = np.lexsort((owner, elements))
        self.elements, self.owner, self.order = elements[order], owner[order], order

    def ranges(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.elements, query, "left"), np.searchsorted(self.elements, query, "right")

    def of(self, query: np.ndarray) -> list[np.ndarray]:
        begin, end = self.ranges(query)
        return [self.owner[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True) if z > a]


class WholeSets:
    """Sets that queries are verified on."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.index = InvertedLists(np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes))

    def linked(self, query: np.ndarray) -> list[int]:
        """The places of the sets that link with the query; such a set has 4/5 of its elements."""
        found = zip(*divide_skip(self.index.of(query), required(len(query))), strict=True)
        return [int(c) for c, k in found if links(len(query), int(self.sizes[c]), int(k))]


def linked(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """The places of the sets that link with the query."""
    return WholeSets(sets).linked(query) if sets else []


class Block:
    """The entries of one group of a block: element h, class cid of size n, its place spot in that class's prefix, its component's rank
    (size, comp), and whether the class is a query or a candidate here."""

    def __init__(self, x: dict[str, np.ndarray]) -> None:
        self.x = x
        candidates = np.flatnonzero(x["candidate"])
        self.cid, first, owner = np.unique(x["cid"][candidates], return_index=True, return_inverse=True)
        self.n, self.size, self.comp = (x[k][candidates[first]] for k in ("n", "size", "comp"))
        self.lists = InvertedLists(x["h"][candidates], owner)
        self.spot = x["spot"][candidates][self.lists.order].astype(np.int64)

    def _by_owner(self, rows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by owner and element, and where each owner's begin."""
        order = np.lexsort((self.x["h"][rows], owner))
        return rows[order], np.searchsorted(owner[order], np.arange(n + 1))

    def _shared(self, held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each candidate wanted, in order: how many elements it shares with the rows held, and the last places of these in the
        prefix held and in its own."""
        begin, end = self.lists.ranges(self.x["h"][held])
        size = end - begin
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        known = np.zeros(len(self.cid), bool)
        known[wanted] = True
        keep = known[self.lists.owner[at]]
        at, spot = at[keep], np.repeat(self.x["spot"][held], size)[keep].astype(np.int64)
        order = np.argsort(self.lists.owner[at], kind="stable")
        owner = self.lists.owner[at[order]]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        return np.diff(first, append=len(owner)), np.maximum.reduceat(spot[order], first), np.maximum.reduceat(self.spot[at[order]], first)

    def meeting(self) -> list[tuple[int, int, int, bool]]:
        """(cid, comp, n, whether as a query) of the classes that are in a pair of query and candidate of different components that
        may link, from the smaller component."""
        x, out, taken = self.x, [], np.zeros(len(self.cid), bool)
        asked = np.flatnonzero(x["query"])
        cids, owner = np.unique(x["cid"][asked], return_inverse=True)
        rows, begin = self._by_owner(asked, owner, len(cids))
        for i, q in enumerate(cids.tolist()):
            held = rows[begin[i] : begin[i + 1]]
            n, size, comp = (int(x[k][held[0]]) for k in ("n", "size", "comp"))
            least = min(MATCHES, required(n))
            if len(held) < least:
                continue
            found, _ = divide_skip(self.lists.of(x["h"][held]), least)
            m = self.n[found]
            able = (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & ((self.size[found] > size) | ((self.size[found] == size) & (self.comp[found] > comp)))
            found, m = found[able], m[able]
            if not len(found):
                continue
            shared, mine, theirs = self._shared(held, found)
            most = shared + np.minimum(n - mine, m - theirs) - 1
            found = found[(shared >= np.minimum(MATCHES, required(np.maximum(m, n)))) & (9 * most >= 4 * (n + m))]
            if len(found):
                taken[found] = True
                out.append((q, comp, n, True))
        return out + [(int(self.cid[c]), int(self.comp[c]), int(self.n[c]), False) for c in np.flatnonzero(taken).tolist()]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    common.small_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))


def prefix(s: np.ndarray, is_frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The places in s, a sorted set, of its first elements in the order that all documents have: frequent ones last, then by hash;
    and how many of them are not frequent."""
    late = in_bitmap(is_frequent, s)
    rare = np.flatnonzero(~late)
    n = prefix_length(len(s))
    return np.concatenate([rare, np.flatnonzero(late)])[:n], min(n, len(rare))


def _frequent(texts: DataFrame) -> DataFrame:
    """h, n: the shingles that are frequent, of those that are so in a task's buffer, and their documents."""
    schema = common.shape("h long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[np.ndarray] = []
        size = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            if buffer:
                value, n = np.unique(np.concatenate(buffer), return_counts=True)
                some = n >= REPORTED
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(value[some])), pa.array(n[some])], schema=schema)
            buffer.clear()

        for batch in common.slices(batches):
            sets = [s for s in shingle_sets(batch) if len(s)]
            buffer += sets
            size += sum(map(len, sets))
            if size > _BUFFER:
                yield from frequent()
                size = 0
        yield from frequent()

    counted = texts.mapInArrow(run, common.spark_type(schema)).groupBy("h").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= FREQUENT)


def _documents(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """A row for each document: doc_id, row (a number), a, b, n (the name and size of its set), least (its least hash), hs (its prefix), and
    rare, how many of these are not frequent."""
    schema = common.shape("doc_id long, row long, a long, b long, n long, least long, rare int, hs longs")
    maps = texts.sparkSession.sparkContext.broadcast(frequent)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in common.slices(batches):
            sets = shingle_sets(batch)
            chosen = [prefix(s, maps.value) for s in sets]
            names = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
            hs = [s[p] for s, (p, _) in zip(sets, chosen, strict=True)]
            ends = pa.array(np.cumsum([0, *map(len, hs)]), pa.int32())
            least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
            columns = [np.arange(row, row + len(sets)), names[:, 0], names[:, 1], np.array([len(s) for s in sets], np.int64), common.signed(least), np.array([r for _, r in chosen], np.int32)]
            row += len(sets)
            lists = pa.ListArray.from_arrays(ends, pa.array(common.signed(np.concatenate(hs)), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), lists], schema=schema)

    return texts.mapInArrow(run, common.spark_type(schema))


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of shingles that several classes post. Rows of one shingle come one after the other, and none is held back longer
    than until the second comes."""
    schema = common.shape("h long, cid long, n long, spot int, least long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row so far, and whether it was given out
        given, before = False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            same = h[1:] == h[:-1]
            joined = before is not None and h[0] == before
            keep = np.zeros(len(h), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= joined
            if joined and not given:
                yield last
            before, last, given = h[-1], batch.slice(len(h) - 1), bool(keep[-1])
            yield batch.filter(pa.array(keep))

    return postings.repartition("h").sortWithinPartitions("h").mapInArrow(run, common.spark_type(schema))


def _lists(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """h, cid, n, spot, least: the inverted lists of two classes or more, by entries."""
    one = documents.join(classes.select(F.col("cid").alias("row")), "row", "left_semi")
    posted = one.select(F.col("row").alias("cid"), "n", "least", "rare", F.posexplode("hs").alias("spot", "h"))
    columns = ("h", "cid", "n", "spot", "least")
    common_ones = posted.where("spot >= rare").select(*columns)  # lists of any length: never in one task
    sizes = common_ones.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("h")
    return _shared(posted.where("spot < rare").select(*columns)).unionByName(common_ones.join(sizes, "h", "left_semi"))


def _on_enough(lists: DataFrame) -> DataFrame:
    """The entries of classes that are on as many lists as a link needs."""
    enough = lists.groupBy("cid", "n").agg(F.count(F.lit(1)).alias("on")).where(F.expr(f"on >= least({MATCHES}, (4 * n + 4) div 5)"))
    return lists.join(enough.select("cid"), "cid", "left_semi")


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """q, part, comp, asked, cid, elements of the classes wanted (cid, a, b, n, doc, groups), where doc is a document of each and groups are
    the (q, part) to send it to, as which component and whether as a query. A text is told by its id, and its set by its name; texts
    without an id by the name alone."""
    schema, fields = common.shape("q long, part long, comp long, asked long, cid long, elements binary"), ("q", "part", "comp", "asked")
    named = texts.where("doc_id is not null").join(wanted.where("doc is not null").withColumnRenamed("doc", "doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingle_sets(batch)
            names = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            rows = [i for i, (s, name) in enumerate(zip(sets, names, strict=True)) if (*signature(s), len(s)) == name]
            part = batch.take(pa.array(rows, pa.int64()))
            groups = part.column(6)
            owner = np.repeat(np.arange(len(rows)), np.diff(np.array(groups.offsets)))
            flat, cid = groups.flatten(), part.column(5).to_numpy()
            for lo in range(0, len(owner), 64):  # a batch of some sets at once
                some = owner[lo : lo + 64]
                elements = pa.array([sets[rows[i]].tobytes() for i in some.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(flat.field(f)[lo : lo + 64] for f in fields), pa.array(cid[some]), elements], schema=schema)

    out = named.select("doc_id", "text", "a", "b", "n", "cid", "groups").mapInArrow(run, common.spark_type(schema))
    nameless = wanted.where("doc is null")
    if nameless.isEmpty():
        return out
    all_sets = common.shape("a long, b long, n long, elements binary")

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = [s for s in shingle_sets(batch) if len(s)]
            names = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=all_sets)

    found = texts.where("doc_id is null").mapInArrow(run_all, common.spark_type(all_sets)).join(nameless, ["a", "b", "n"])
    return out.unionByName(found.select(F.explode("groups").alias("g"), "cid", "elements").select(*(f"g.{f}" for f in fields), "cid", "elements"))


def _stars(lists: DataFrame) -> DataFrame:
    """q, c: classes c that meet the first class q of lists on enough of those."""
    first = lists.groupBy("h").agg(F.min(F.struct("cid", "n")).alias("q")).select("h", F.col("q.cid").alias("q"), F.col("q.n").alias("nq"))
    met = lists.join(first, "h").where("cid <> q").groupBy("q", "nq", F.col("cid").alias("c"), F.col("n").alias("nc")).agg(F.count(F.lit(1)).alias("shared"))
    return met.where(F.expr(f"5 * least(nq, nc) >= 4 * greatest(nq, nc) and shared >= {_ENOUGH}")).select("q", "c")


def _in_groups(df: DataFrame, keys: tuple[str, ...], schema: pa.Schema, work) -> DataFrame:
    """work(columns by name, as numpy) of each group of rows; groups are of bounded size. keys come first in df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            rows = work({name: (t[name].combine_chunks() if pa.types.is_binary(t.schema.field(name).type) else t[name].to_numpy()) for name in t.column_names})
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(len(keys))]
            change = np.zeros(batch.num_rows, bool)
            for k, c in enumerate(cols):
                change[1:] |= c[1:] != c[:-1]
                change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            at = 0
            for cut in cuts:
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                if cut < batch.num_rows and held:
                    yield from whole()
                at = cut
        if held:
            yield from whole()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, common.spark_type(schema))


def _across(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """to, group, cid, comp, n, asked: the classes of each block's group that may link with one of another component there, as queries or
    candidates. comps: cid, comp, size of the classes that are linked."""
    rank = F.struct("size", "comp")
    entries = lists.join(comps, "cid", "left").withColumns({"comp": F.coalesce("comp", "cid"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    mixed = entries.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h")
    entries = common.staged(_on_enough(entries.join(mixed, "h", "left_semi")), "entries")
    blocks = max(1, entries.count() // BLOCK_POSTINGS)
    base = F.expr(f"(shiftrightunsigned(least, 40) * {blocks}L) div {1 << 24}L")
    entries = entries.withColumn("base", base)
    parts = entries.groupBy("base").agg(F.ceil(F.count(F.lit(1)) / BLOCK_POSTINGS).alias("parts"))  # copies of one text have one least hash
    entries = entries.join(parts, "base").withColumn("block", F.expr("base * 1048576L + pmod(xxhash64(cid), parts)")).drop("base", "parts")
    top = entries.groupBy("h").agg(F.max(rank).alias("top"))
    heads = entries.groupBy("h", "block").agg(F.min(rank).alias("low")).join(top, "h").where("low < top").select("h", F.col("block").alias("to"), "low", "top")
    dealt = entries.join(heads, "h").withColumns({"query": (F.col("block") == F.col("to")) & (rank < F.col("top")), "candidate": rank > F.col("low")}).where("query or candidate")
    dealt = common.staged(dealt.select("to", "h", "cid", "n", "spot", "size", "comp", "query", "candidate"), "dealt")
    groups = dealt.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / GROUP_ENTRIES).alias("groups"))
    # a query goes to all groups of its block, a candidate to one
    own = F.expr("pmod(xxhash64(cid), groups)")
    dealt = dealt.join(groups, "to").withColumn("own", own).withColumn("group", F.explode(F.when(F.col("query"), F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).otherwise(F.array("own"))))
    dealt = dealt.select("to", "group", "h", "cid", "n", "spot", "size", "comp", "query", (F.col("candidate") & (F.col("own") == F.col("group"))).alias("candidate"))
    schema = common.shape("to long, group long, cid long, comp long, n long, asked boolean")

    def search(x: dict) -> list[tuple]:
        return [(int(x["to"][0]), int(x["group"][0]), *row) for row in Block(x | {"h": x["h"].view(np.uint64)}).meeting()] if x["candidate"].any() else []

    return _in_groups(dealt, ("to", "group"), schema, search)


def _in_cells(met: DataFrame) -> DataFrame:
    """cid, groups: where the classes of blocks' groups go. Queries and candidates of a group are parted by their elements, and each part of
    the one meets each of the other in a cell."""
    ways = lambda asked: F.greatest(F.ceil(F.sum(F.when(F.col("asked") == asked, F.col("n"))) / CELL_ELEMENTS), F.lit(1).cast("long"))
    parts = met.groupBy("to", "group").agg(ways(True).alias("down"), ways(False).alias("across"))
    dealt = met.join(parts, ["to", "group"]).withColumns({"own": F.expr("pmod(xxhash64(cid), if(asked, down, across))"), "others": F.expr("explode(sequence(0L, if(asked, across, down) - 1))")})
    cell = F.expr("group * 1048576L + if(asked, own * across + others, others * across + own)")
    group = F.struct(F.col("to").alias("q"), cell.alias("part"), "comp", F.col("asked").cast("long").alias("asked"))
    return dealt.groupBy("cid").agg(F.collect_list(group).alias("groups"))


def _in_stars(pairs: DataFrame) -> DataFrame:
    """cid, groups: where the classes of pairs q, c go. A group is a query with a part of its candidates, each a component of its own."""
    parts = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("parts"))
    candidates = pairs.join(parts, "q").select("q", F.pmod(F.xxhash64("c"), "parts").alias("part"), F.col("c").alias("cid"), F.lit(0).cast("long").alias("asked"))
    queries = parts.select("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("q").alias("cid"), F.lit(1).cast("long").alias("asked"))
    return candidates.unionByName(queries).groupBy("cid").agg(F.collect_list(F.struct("q", "part", F.col("cid").alias("comp"), "asked")).alias("groups"))


def _verified(dealt: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v: links of the queries of each group with its candidates, one for each component of these. dealt: cid, groups."""
    sets = _sets(texts, dealt.join(classes.select("cid", "a", "b", "n", "doc"), "cid"))
    schema = common.shape("u long, v long")

    def search(x: dict) -> list[tuple[int, int]]:
        held = [np.frombuffer(e.as_buffer(), np.uint64) for e in x["elements"]]
        queries, candidates = np.flatnonzero(x["asked"] == 1).tolist(), np.flatnonzero(x["asked"] == 0)
        if not queries or not len(candidates):
            return []
        whole, cid, comp, out = WholeSets([held[c] for c in candidates.tolist()]), x["cid"].tolist(), x["comp"].tolist(), []
        for q in queries:
            reached = {comp[c]: cid[c] for c in candidates[whole.linked(held[q])].tolist() if comp[c] != comp[q]}
            out += [(cid[q], c) for c in reached.values()]
        return out

    return _in_groups(sets, ("q", "part"), schema, search)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of each row."""
    texts = _texts(df, id_col, text_col)
    frequent = bitmap_of_most(common.staged(_frequent(texts), "shingles"), "h", "n", FREQUENT)
    documents = common.staged(_documents(texts, frequent), "documents")
    name = ["a", "b", "n"]
    classes = documents.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("doc"), F.min("row").alias("cid"), F.count(F.lit(1)).alias("rows"))
    classes = common.staged(classes, "classes")
    lists = common.staged(_lists(documents, classes), "lists")
    near = common.staged(_verified(_in_stars(common.staged(_stars(lists), "pairs")), texts, classes), "links")
    comps = common.staged(components(near), "components")
    sized = comps.join(comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select(F.col("node").alias("cid"), F.col("component").alias("comp"), "size")
    met = common.staged(_across(lists, sized), "meeting")
    if not met.isEmpty():
        far = _verified(_in_cells(met), texts, classes)
        comps = common.staged(components(far.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
    named = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    reached = common.staged(named.join(smallest, "component").select(*name, "rows", "component_id"), "classes")
    found = common.spread_join(documents.where("n > 0").select("doc_id", *name), reached, name, "rows")
    alone = documents.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with its columns, of one document of each component: that with the smallest id. Rows that share an id
    stay together; of a component whose ids are all null, every row stays."""
    (kept_id,) = common.new_names(df, "kept_id")
    found = join(df, id_col, text_col)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    return df.join(kept, df[id_col].cast("long").eqNullSafe(kept[kept_id]), "left_semi")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM d),
g AS (SELECT DISTINCT doc_id, s FROM u), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
