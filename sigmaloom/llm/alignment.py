"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how often each pair of ids does.

A is a byte-level tokenizers file that encodes space + text, B a sentencepiece model that adds the space itself. Byte offsets where
tokens of both end cut a text into groups; the last A token and the last B token of a group are linked, as they end together.

Texts are cut before spaces that follow a character other than white space and have more than spaces behind them. No token of either
side spans such a place: A begins a word there, and B has no piece with a space behind another character, which is checked. So each
distinct chunk is encoded and aligned once for each worker's memory, and a text is a sequence of chunks.

* Identity map: for every A id the B id of the same bytes. A link of such a pair is an exact one-to-one group, since tokens of equal
  bytes that end together also begin together. These are counted in a vector as long as A's vocabulary.
* The links of the irregular groups are summed by pair in each task and then by a shuffle on the pair. Linked tokens end together, so the bytes of
  one are a suffix of the other's: there are no more such pairs than the bytes of both vocabularies together times the most ids
  that share their bytes. That bounds the table of counts that goes to all tasks, whatever the corpus; it is checked.

Edge cases: null and empty texts, and texts whose joined token bytes differ from space + text on either side (a U+2581 in the text, for
one), have no tokens: zeros and ''. Strings of special tokens are plain text. Texts of any length, white space of any kind and chunks
of any length are taken whole; equal rows give equal rows, each counted; null ids stay; other columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_letters

#: Chunks, and characters of chunks, that a worker remembers; beyond either it starts anew.
MEMORY, MEMORY_CHARS = 400_000, 80_000_000
#: Chunks that are encoded as one text, and distinct pairs of batches that a task adds up at once.
JOINED, SEEN = 256, 1_000_000
#: A place where a text may not be cut at every space.
_ODD = re.compile(r"\s | \Z")
_CUTS = re.compile(r"(?<=\S)(?= +[^ ])")


class Pair:
    """The two tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_file, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.a_bytes = [b""] * (max(self.a.get_vocab_size(), *(i + 1 for i in vocab.values())))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes, plain = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} has a space behind another character, so texts cannot be cut before spaces")
            plain.append(not self.b.is_byte(i))
            self.b_bytes.append(piece.replace("▁", " ").encode() if plain[-1] else bytes([int(piece[3:5], 16)]))
        of = {}
        for i in sorted(range(len(self.b_bytes)), key=lambda i: (plain[i], -i)):  # a piece goes before a byte, a lower id before a higher
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                of[self.b_bytes[i]] = i
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        #: each id as text, followed by a comma, a bar or a semicolon
        self.numbers = np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], object)
        self.same = np.array([of.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        shared = max(max(Counter(side).values()) for side in ([x for x in self.a_bytes if x], self.b_bytes))
        self.most_pairs = shared * (sum(map(len, self.a_bytes)) + sum(map(len, self.b_bytes)))

    def align(self, chunk: str, a: list[int], b: list[int]) -> tuple[bool, list[tuple[int, int]], str]:
        """Whether both sides spell the chunk; its links (A id, B id); and its groups as text, each with a semicolon."""
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        whole = chunk.encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return False, [], ""
        links, groups, i, j, i0, j0, at_a, at_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(a_bytes[i])
                i += 1
            else:
                at_b += len(b_bytes[j])
                j += 1
            if at_a == at_b:
                links.append((a[i - 1], b[j - 1]))
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])) + ";")
                i0, j0 = i, j
        return True, links, "".join(groups)


_LOADED: dict[tuple[str, str], Pair] = {}


def loaded(a_file: str, b_file: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if (a_file, b_file) not in _LOADED:
        _LOADED[a_file, b_file] = Pair(a_file, b_file)
    return _LOADED[a_file, b_file]


def chunks(text: str) -> list[str]:
    """The chunks of space + text, each without the space that it begins with."""
    if _ODD.search(" " + text) is None:
        return text.split(" ")
    return [x[1:] for x in _CUTS.split(" " + text)]


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of `sizes` places from `starts` on, one run after the other."""
    at = np.arange(int(sizes.sum()))
    return at + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Chunks:
    """A worker's memory of aligned chunks: for each code the tokens of both sides, the links and the groups as text."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        #: by code: A tokens, B tokens, links, the first link; and whether both sides spell it
        self.sums = np.zeros((1024, 4), np.int64)
        self.spelt = np.zeros(1024, bool)
        self.links = np.zeros((1024, 2), np.int32)
        self.n_links = 0

    def full(self) -> bool:
        return len(self.codes) > MEMORY or self.chars > MEMORY_CHARS

    def _keep(self, keys: list[str], spelt: bool, sums: np.ndarray, links: np.ndarray, groups: list[str]) -> None:
        first, n = len(self.groups), len(self.groups) + len(keys)
        if n > len(self.spelt):
            self.spelt.resize(2 * n, refcheck=False)
            self.sums.resize((2 * n, 4), refcheck=False)
        if self.n_links + len(links) > len(self.links):
            self.links.resize((2 * (self.n_links + len(links)), 2), refcheck=False)
        self.spelt[first:n] = spelt
        self.sums[first:n, :3] = sums
        self.sums[first:n, 3] = self.n_links + np.cumsum(sums[:, 2]) - sums[:, 2]
        self.links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)
        self.groups += groups
        self.codes.update(zip(keys, range(first, n), strict=True))
        self.chars += sum(map(len, keys)) + sum(map(len, groups))

    def _one(self, key: str) -> None:
        pair = self.pair
        a, b = pair.a.encode(" " + key, add_special_tokens=False).ids, pair.b.encode(key)
        spelt, links, groups = pair.align(" " + key, a, b)
        links = np.array(links, np.int32).reshape(-1, 2)
        links[pair.same[links[:, 0]] == links[:, 1], 1] = -1
        self._keep([key], spelt, np.array([[len(a), len(b), len(links)]]), links, [groups])

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns chunks that are not known yet: those that end with a character other than white space together, JOINED
        of them in one text, the others and those whose text one side does not spell each by itself."""
        plain = [k for k in new if k and not k[-1].isspace() and not "\x1c" <= k[-1] <= "\x1f"]
        for k in set(new).difference(plain):
            self._one(k)
        for i in range(0, len(plain), JOINED * 64):
            self._many([plain[j : j + JOINED] for j in range(i, min(i + JOINED * 64, len(plain)), JOINED)])

    def _many(self, sets: list[list[str]]) -> None:
        pair = self.pair
        texts = [" ".join(x) for x in sets]
        a, b = [x.ids for x in pair.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)], pair.b.encode(texts, num_threads=1)
        good, sides = [], [[], []]
        for keys, text, *ids in zip(sets, texts, a, b, strict=True):
            whole = (" " + text).encode()
            if all(b"".join(map(side.__getitem__, x)) == whole for side, x in zip((pair.a_bytes, pair.b_bytes), ids, strict=True)):
                good += keys
                for side, x in zip(sides, ids, strict=True):
                    side += x
            else:
                for k in keys:
                    self._one(k)
        if not good:
            return
        a, b = (np.array(x, np.int64) for x in sides)
        a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        ends = np.cumsum([len(k.encode()) + 1 for k in good])
        here = np.zeros((2, int(ends[-1]) + 1), bool)
        here[0, a_end] = here[1, b_end] = True
        a_last, b_last = here[1, a_end], here[0, b_end]  # tokens that end where one of the other side does
        if not (here[0, ends] & here[1, ends]).all():
            raise AssertionError("a token spans two chunks")
        links = np.stack([a[a_last], b[b_last]], 1).astype(np.int32)
        links[pair.same[links[:, 0]] == links[:, 1], 1] = -1
        # the groups as text: the A tokens of a group, then its B tokens; each token with the mark that follows it
        place_a = np.arange(len(a)) + np.searchsorted(b_end, a_end[np.flatnonzero(a_last)], "right")[np.cumsum(a_last) - a_last - 1] * (np.cumsum(a_last) - a_last > 0)
        place_b = np.arange(len(b)) + np.searchsorted(a_end, b_end[np.flatnonzero(b_last)], "right")[np.cumsum(b_last) - b_last]
        said = np.empty(len(a) + len(b), object)
        said[place_a], said[place_b] = pair.numbers[a + len(pair.numbers) // 3 * a_last], pair.numbers[b + len(pair.numbers) // 3 * 2 * b_last]
        said = said.tolist()
        counts = np.stack([np.searchsorted(x, ends, "right") for x in (a_end, b_end, a_end[a_last])], 1)
        until = (counts[:, 0] + counts[:, 1]).tolist()
        self._keep(good, True, np.diff(counts, axis=0, prepend=0), links, ["".join(said[i:j]) for i, j in zip([0, *until], until, strict=False)])

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts' chunks, and where each text's begin; of those that have any."""
        parts = [chunks(x) for x in texts if x]
        flat = list(chain.from_iterable(parts))
        self.learn(list(set(flat) - self.codes.keys()))
        starts = np.cumsum([0, *map(len, parts)])
        return np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat)), starts


class Counts:
    """The corpus-wide counts of links: a vector for the identity map, sorted keys for the other pairs, and the best of each B id."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        exact = b < 0
        self.same, self.vector = pair.same, np.zeros(len(pair.same), np.int64)
        self.vector[a[exact]] = n[exact]
        keys = a[~exact] << 32 | b[~exact]
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[~exact][order]
        self.best = np.zeros(len(pair.b_bytes), np.int64)
        np.maximum.at(self.best, np.where(exact, pair.same[a], b), n)

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of links, all of them seen, b being -1 for the identity map's; and whether each is its B id's highest."""
        exact = b < 0
        n = self.vector[a]
        n[~exact] = self.n[np.searchsorted(self.keys, a[~exact] << 32 | b[~exact])]
        return n, n == self.best[np.where(exact, self.same[a], b)]


def aligned(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Of each row's whole text: doc_id, n_a, n_b, groups_sha256, its links in order as a and b, and with `groups` the groups as text,
    `a1,a2|b1;a3|b2,b3`. b is -1 for the identity map's id."""
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, n_a long, n_b long, a ints, b ints, groups_sha256 string" + ", groups string" * groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Chunks(loaded(a_file, b_file))
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            codes, starts = memory.read(texts)
            row = np.flatnonzero([bool(x) for x in texts])
            sums, said = np.zeros((len(texts), 3), np.int64), [""] * len(texts)
            links = np.zeros((0, 2), np.int32)
            if len(codes):
                whole = np.logical_and.reduceat(memory.spelt[codes], starts[:-1])
                sums[row[whole]] = np.add.reduceat(memory.sums[codes, :3], starts[:-1])[whole]
                kept = codes[np.repeat(whole, np.diff(starts))]
                links = memory.links[_gather(memory.sums[kept, 3], memory.sums[kept, 2])]
                listed, every = codes.tolist(), starts.tolist()
                for k in np.flatnonzero(whole).tolist():
                    said[row[k]] = "".join(map(memory.groups.__getitem__, listed[every[k] : every[k + 1]]))[:-1]
            ends = pa.array(np.concatenate([[0], np.cumsum(sums[:, 2])]), pa.int32())
            columns = [pa.array(sums[:, 0]), pa.array(sums[:, 1]), *(pa.ListArray.from_arrays(ends, pa.array(links[:, k])) for k in (0, 1))]
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array(said, pa.string())] if groups else [])], schema=schema)
            if memory.full():
                memory.clear()

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, common.spark_type(schema))


def pair_counts(links: DataFrame, vocabulary: int) -> DataFrame:
    """a, b, n: how many links of `aligned` rows hold each pair of ids. The identity map's (b is -1) are counted in a vector as long as A's
    vocabulary, and each other pair once for about SEEN links of a task."""
    schema = common.shape("a long, b long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, others, waiting = np.zeros(vocabulary, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in others)])
            keys, of = np.unique(keys, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, of, np.concatenate([np.zeros(0, np.int64), *(n for _, n in others)]))
            return keys, n

        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            vector += np.bincount(a[b < 0], minlength=vocabulary)
            others.append(np.unique(a[b >= 0] << 32 | b[b >= 0], return_counts=True))
            waiting += len(others[-1][0])
            if waiting > SEEN:
                others = [summed()]
                waiting = 0
        at = np.flatnonzero(vector)
        keys, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((at, keys >> 32), (np.full(len(at), -1), keys & 0xFFFFFFFF), (vector[at], n))], schema=schema)

    return links.select("a", "b").mapInArrow(run, common.spark_type(schema)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with `groups` the groups as text, of each row's whole text. The
    links are staged, so every text is encoded once."""
    pair = loaded(a_file, b_file)
    links = common.staged(aligned(df, a_file, b_file, id_col, text_col, groups), "links")
    table = pair_counts(links, len(pair.a_bytes)).toArrow()
    if table.num_rows > pair.most_pairs:
        raise AssertionError("more pairs than two vocabularies can link")
    counts = df.sparkSession.sparkContext.broadcast(Counts(pair, *(table.column(c).to_numpy() for c in ("a", "b", "n"))))
    schema = common.shape("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n, best = counts.value.of(a.flatten().to_numpy(zero_copy_only=False).astype(np.int64), b)
            row = np.repeat(np.arange(len(size)), size)
            out = np.zeros((2, len(size)), np.int64)
            np.add.at(out[0], row, best)
            np.add.at(out[1], row, n)
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b")] + [pa.array(x) for x in (size, size, *out)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in ("groups_sha256", *(["groups"] if groups else [])))], schema=schema)

    return links.mapInArrow(run, common.spark_type(schema))
