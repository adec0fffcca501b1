"""Byte-pair encoding by a token automaton.

The merge list is compiled once per worker into a deterministic automaton over token arcs, one
merge gadget after the other. A state stands for what may follow; before any merge there is one
state with an arc for every byte. The gadget of merge (left, right) -> joined

* gives `joined` an arc that leads where `right` led, from every state that has an arc `left`, and
* sends `left` to a copy of its state in which the arc `right` is missing.

A copy differs from its parent by one arc, so the table keeps that difference only and a look-up
walks from copy to parent. A path spells a word's encoding if and only if the automaton accepts it,
and each prefix of a word has exactly one, so a word is encoded by table-driven transitions from
left to right over a byte trie of the arcs' labels, without any merge queue. Ids are decoded by
emitting their arc labels.

Edge cases: null and empty text give no ids; white space of any kind, control characters and texts of
any length are encoded whole; rows repeat as often as in the input; the input's other columns, whatever
their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: The pre-split of byte-level BPE; white space is Unicode's.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of a worker's memory of encoded pieces, which starts anew beyond that, and the longest piece that it keeps.
MEMORY, LONGEST_KEPT = 900_000, 48


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: itself if printable, else the next unused code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The deterministic token automaton of a merge list."""

    START = -1

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], byte_ids: list[int]) -> None:
        """labels: the bytes of each id; merges: (left, right, joined) by priority; byte_ids: the id of each byte."""
        self.labels = labels
        self.left: dict[int, tuple[int, int]] = {}  # joined -> its left part, the merge's number
        self.right: dict[int, tuple[int, int]] = {}
        self.missing: dict[tuple[int, int], int] = {}  # (token whose state was copied, missing arc) -> the merge's number
        self.known: dict[tuple[int, int], bool] = {}
        self.children: list[dict[int, int]] = [{}]
        self.arc_of: list[int] = [-1]
        for b in byte_ids:
            self._spell(b)
        for k, (left, right, joined) in enumerate(merges):
            if joined in self.left:
                raise ValueError(f"two merges make token {joined}")
            if self._arc(left, right):
                self.left[joined], self.right[joined] = (left, k), (right, k)
                self.missing[left, right] = k
                self._spell(joined)

    def _spell(self, token: int) -> None:
        node = 0
        for b in self.labels[token]:
            if b not in self.children[node]:
                self.children[node][b] = len(self.children)
                self.children.append({})
                self.arc_of.append(-1)
            node = self.children[node][b]
        self.arc_of[node] = token

    def _arc(self, token: int, arc: int) -> bool:
        """Whether the state that `token` leads to has `arc`: no copy on the way to the first state misses it, or a left
        part of it by the time when the arc was built from that part."""
        wanted, part, until = [(arc, len(self.labels) << 8)], arc, 0
        while part in self.left:
            part, until = self.left[part]
            wanted.append((part, until))
        copied, before = token, len(self.labels) << 8
        while True:
            for part, until in wanted:
                k = self.missing.get((copied, part))
                if k is not None and k < before and k <= until:
                    return False
            if copied not in self.right:
                return True
            copied, before = self.right[copied]

    def accepts(self, token: int, arc: int) -> bool:
        if token == self.START:
            return True
        key = (token, arc)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._arc(token, arc)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        n, children, arc_of, accepts = len(word), self.children, self.arc_of, self.accepts
        last, came = [self.START] * (n + 1), [0] * (n + 1)
        for i in range(n):
            state, node, j = last[i], 0, i
            while j < n:
                node = children[node].get(word[j])
                if node is None:
                    break
                j += 1
                arc = arc_of[node]
                if arc >= 0 and accepts(state, arc):
                    last[j], came[j] = arc, i
        out, i = [], n
        while i:
            out.append(last[i])
            i = came[i]
        return out[::-1]


class ByteBpe:
    """A byte-level BPE of a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        labels = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            labels[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], [vocab[c] for c in letters])
        self.labels, self.added = labels, added
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.split = regex.compile(WORD_PATTERN)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}

    def _piece(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a text without special tokens."""
        out = []
        for word in self.split.findall(text):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) > MEMORY:
                    self.words.clear()
                found = self.automaton.encode(word.encode())
                ids = struct.pack(f"<{len(found)}I", *found)
                if len(word) <= LONGEST_KEPT:
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """A space between two other characters always begins a word, so the pieces between such spaces are encoded alone."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        pieces, out = self.pieces, []
        if not rest or not first or first[-1].isspace() or "\x1c" <= first[-1] <= "\x1f":
            return self._piece(text)
        out.append(self._piece(first))
        for piece in rest:
            try:
                ids = pieces[piece]
            except KeyError:
                if len(pieces) > MEMORY:
                    pieces.clear()
                whole = piece and not piece[0].isspace() and not piece[-1].isspace()
                ids = self._piece(" " + piece) if whole else None
                if len(piece) <= LONGEST_KEPT:
                    pieces[piece] = ids
            if ids is None:
                return self._piece(text)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


#: What encode_documents can return of a document.
COLUMNS: dict[str, tuple[str, Callable[[bytes, ByteBpe], object]]] = {
    "ids": ("ints", lambda ids, _: np.frombuffer(ids, "<i4")),
    "n_tokens": ("long", lambda ids, _: len(ids) // 4),
    "ids_sha256": ("string", lambda ids, _: hashlib.sha256(ids).hexdigest()),
    "decoded": ("string", lambda ids, bpe: bpe.decode(ids)),
    "decoded_sha256": ("string", lambda ids, bpe: hashlib.sha256(bpe.decode(ids).encode()).hexdigest()),
}


def encode_documents(df: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("ids", "n_tokens"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the asked columns (see COLUMNS) of each row's whole text. vocabulary: a byte-level tokenizers JSON file
    that every executor has."""
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, " + ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in common.slices(batches):
            ids = [bpe.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([COLUMNS[c][1](x, bpe) for x in ids], schema.field(c).type) for c in columns)], schema=schema)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(encode, common.spark_type(schema))


def decode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null ids give an empty text."""
    schema = common.shape("doc_id long, text string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(decode, common.spark_type(schema))
