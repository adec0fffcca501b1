"""Best-fit decreasing packing of token sequences into fixed windows.

Each task packs the documents of its own partition, in blocks of a bounded number of tokens, so
nothing is shuffled and no task holds more than one block. Within a block overlong documents are cut
into full windows, the remainders go by falling length into the tightest open window, which a
segment tree indexed by remaining capacity finds in O(log capacity). Windows with large gaps stay
open for the next block; at the end of a partition the emptiest open windows are cut up to fill the
gaps of the others, and the last one is cut into powers of two, which need no padding.

Edge cases: null and empty text have the closing id only, one token; no id is lost or doubled;
repeated rows and repeated doc_ids are packed once per row; a null doc_id stays null; the input's
other columns are not read; an empty table gives an empty table. Sequence ids are unique, not dense:
partition number times 2^33 plus a counter.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

#: Tokens that a block gathers before it is packed.
BLOCK_TOKENS = 4_000_000
#: A gap below this is padded, not filled by cutting a document.
LEAST_GAP = 64
#: Words that a worker remembers, and their bytes; its memory starts anew beyond that.
MEMORY, MEMORY_BYTES = 3_000_000, 48 << 20


#: Marks that close a word; lower-case letters of one byte, and those of two bytes, up to U+017F, by code point.
_MARK, _ASCII_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")], _ASCII_LETTER[97:123] = True, True
_LETTER = np.array([c > 191 and chr(c).isalpha() and chr(c).islower() for c in range(0x180)] + [False] * (0x800 - 0x180))
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on; the space stays.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = np.arange(256).astype("<u2")
_BYTE_CHARS[[b for b in range(256) if b not in _PRINTED]] = np.arange(256, 512 - len(_PRINTED))
_BYTE_CHARS[32] = 32


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are, or are part of, lower-case letters up to U+017F."""
    out = _ASCII_LETTER[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5)) if len(data) else np.zeros(0, np.int64)
    lead = lead[_LETTER[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]]
    out[lead] = out[lead + 1] = True
    return out


class CapacityTree:
    """Open windows by remaining capacity; tightest(n) takes one with the least capacity of n or more."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window), taken out; None if no open window has room."""
        i, count = need + self.size, self.count
        while not count[i]:
            while i & 1:  # a right child: nothing to its right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i *= 2
            if not count[i]:
                i += 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


class Packer:
    """Packs documents of one partition. Pieces are (document, start, length); windows are lists of pieces."""

    def __init__(self, width: int, least_gap: int = LEAST_GAP) -> None:
        self.width, self.least_gap = width, least_gap
        self.windows: dict[int, list[tuple[int, int, int]]] = {}
        self.room: dict[int, int] = {}
        self.made = 0

    def _new(self) -> int:
        self.made += 1
        self.windows[self.made - 1], self.room[self.made - 1] = [], self.width
        return self.made - 1

    def _put(self, window: int, piece: tuple[int, int, int]) -> None:
        self.windows[window].append(piece)
        self.room[window] -= piece[2]

    def block(self, lengths: list[tuple[int, int]]) -> None:
        """lengths: (document, tokens) of one block. Windows still open take part."""
        tree = CapacityTree(self.width)
        for w, room in self.room.items():
            if room:
                tree.add(room, w)
        rests = []
        for doc, n in lengths:
            full = n - n % self.width
            for at in range(0, full, self.width):
                self._put(self._new(), (doc, at, self.width))
            if n > full:
                rests.append((n - full, doc, full))
        for n, doc, at in sorted(rests, key=lambda r: (-r[0], r[1])):
            found = tree.tightest(n)
            window = found[1] if found else self._new()
            self._put(window, (doc, at, n))
            if self.room[window]:
                tree.add(self.room[window], window)

    def done(self, least: int) -> list[list[tuple[int, int, int]]]:
        """Takes out the windows with a gap below `least`."""
        ready = [w for w, room in self.room.items() if room < least]
        for w in ready:
            del self.room[w]
        return [self.windows.pop(w) for w in ready]

    def finish(self) -> list[list[tuple[int, int, int]]]:
        """The windows that are left, after cutting: gaps are filled from the emptiest windows, the last is cut into powers of two."""
        out = self.done(1)
        order = sorted(self.room, key=lambda w: (-self.room[w], w))
        while len(order) > 1 and self.room[order[-1]] >= self.least_gap:
            source, target = order[0], order[-1]
            doc, at, n = self.windows[source].pop()
            part = min(n, self.room[target])
            self._put(target, (doc, at, part))
            self.room[source] += n
            if part < n:
                self._put(source, (doc, at + part, n - part))
            if not self.windows[source]:
                order.pop(0)
                del self.windows[source], self.room[source]
            if self.room[target] < self.least_gap:
                order.pop()
                out.append(self.windows.pop(target))
                del self.room[target]
        for w in order:
            out += self._powers(self.windows.pop(w)) if self.room[w] >= self.least_gap else [self.windows.pop(w)]
        self.room.clear()
        return out

    @staticmethod
    def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """The pieces dealt to sequences whose lengths are the powers of two that add up to theirs."""
        total, out, pieces = sum(p[2] for p in pieces), [], pieces[::-1]
        for k in reversed(range(total.bit_length())):
            if total >> k & 1:
                sequence, need = [], 1 << k
                while need:
                    doc, at, n = pieces.pop()
                    part = min(n, need)
                    sequence.append((doc, at, part))
                    need -= part
                    if part < n:
                        pieces.append((doc, at + part, n - part))
                out.append(sequence)
        return out


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases, splits at white space and drops it, and parts letters from marks.

    A batch is cut into words over its bytes, and each distinct word that is not known yet is encoded once. What is known
    lies in arrays sorted by the words' hashes, about fifty bytes a word. Words that share a hash are compared byte by byte; if any differ,
    the batch is encoded without hashes. An unknown word is taken as a stem and the closing
    marks after its last letter, and stems go to the tokenizer many in one call, with a special token between them. Stems of lower-case
    letters are told by their bytes and go to the model alone, as the characters that stand for bytes in it."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        special = [x for x in added.items() if x[1].special and not x[1].normalized]
        self.mark, self.mark_text = (special[0][0], special[0][1].content) if special else (None, "")
        #: By this a text may hold an added token, whose letters do not stand for those of the other case.
        self.heads = {x.content[:2].encode() for x in added.values()}
        self.plain, self.ends = self._plain_tokenizer()
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each word's ids in `ids`
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.text_first, self.text_size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain_tokenizer(self) -> tuple[object, np.ndarray]:
        """The same model without its normaliser and its split, for words of lower-case letters, which these leave as they are;
        and which ids end a word. None if the file's normaliser or split may do other things."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        if not suffix or steps != ["NFC", "Replace", "Lowercase"] or "[\\p{L}]+" not in spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", ""):
            return None, np.zeros(0, bool)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        options = {k: v for k, v in spec["model"].items() if k not in ("type", "vocab", "merges") and v is not None}
        plain = Tokenizer(models.BPE(spec["model"]["vocab"], merges, cache_capacity=0, **options))  # it is asked for a word once
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
        return plain, ends

    def batch(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and the offsets of the texts in them."""
        data, offsets = common.text_bytes(col)
        whole = data.tobytes()
        fold = not any(h in whole for h in self.heads)
        start, end, h = common.words(data, offsets, fold)
        if not fold:
            h = common.mix(h + np.uint64(1))
        if len(self.hashes) > MEMORY or self.text_used > MEMORY_BYTES:
            self.forget()
        plain, size = common.folded(data) if fold else data, end - start
        value, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, value)
        known = np.zeros(len(value), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == value
        old, new = np.flatnonzero(known), np.flatnonzero(~known)
        first = where[inverse]
        same = size == size[first]
        long = np.flatnonzero(size > 8)  # up to eight bytes are one step of the hash, a bijection for words of one size
        same[long] &= common.same_words(plain, start[long], size[long], plain, start[first[long]], size[first[long]])
        if not same.all() or not common.same_words(plain, start[where[old]], size[where[old]], self.text[: self.text_used], self.text_first[at[old]], self.text_size[at[old]]).all():
            return self._by_bytes(whole, plain, start, end, offsets)
        if len(new):
            spots = where[new]
            self._learn(value[new], at[new], whole, plain, start[spots], end[spots])
            at = np.searchsorted(self.hashes, value)
        word = at[inverse]
        count = self.count[word]
        total = np.append(0, np.cumsum(count))
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[word] - total[:-1], count)]
        return ids, total[np.searchsorted(start, offsets)]

    def _by_bytes(self, whole: bytes, plain: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes."""
        places = list(zip(start.tolist(), end.tolist(), strict=True))
        words = {plain[a:z].tobytes(): whole[a:z].decode() for a, z in places}
        found = dict(zip(words, self._encoded(list(words.values())), strict=True))
        ids = [found[plain[a:z].tobytes()] for a, z in places]
        total = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int64)
        return np.frombuffer(b"".join(ids), "<u4"), total[np.searchsorted(start, offsets)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        split = [self.parts(w) for w in words]
        stems = self._stems({x for pair in split for x in pair if x})
        return [stems[s] + stems[m] if m else stems[s] for s, m in split]

    def _new_words(self, whole: bytes, plain: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The ids of each word; those of lower-case letters and closing marks are told by their bytes."""
        if self.plain is None:
            return self._encoded([whole[a:z].decode() for a, z in zip(start.tolist(), end.tolist(), strict=True)])
        stop = end.copy()
        more = np.arange(len(stop))
        while len(more):
            more = more[(stop[more] > start[more]) & _MARK[plain[stop[more] - 1]]]
            stop[more] -= 1
        other = np.append(0, np.cumsum(~_letters(plain)))
        lower = (stop > start) & (other[stop] == other[start])
        raw, out = plain.tobytes(), [b""] * len(start)
        stems = [raw[a:z] for a, z in zip(start[lower].tolist(), stop[lower].tolist(), strict=True)]
        tails = [raw[a:z] for a, z in zip(stop[lower].tolist(), end[lower].tolist(), strict=True)]
        known = self._plain_ids(list(dict.fromkeys(stems)))
        marks = self._stems({x.decode() for x in set(tails) if x})
        for i, stem, tail in zip(np.flatnonzero(lower).tolist(), stems, tails, strict=True):
            out[i] = known[stem] + marks[tail.decode()] if tail else known[stem]
        rest = np.flatnonzero(~lower)
        for i, ids in zip(rest.tolist(), self._encoded([whole[a:z].decode() for a, z in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]), strict=True):
            out[i] = ids
        return out

    def _learn(self, hashes: np.ndarray, at: np.ndarray, whole: bytes, plain: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        found, size = self._new_words(whole, plain, start, end), end - start
        begin = np.cumsum(size) - size
        text = plain[np.arange(size.sum()) + np.repeat(start - begin, size)]
        while self.text_used + len(text) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + len(text)] = text
        spot = self.text_used + begin
        self.text_used += len(text)
        self.text_first, self.text_size = np.insert(self.text_first, at, spot), np.insert(self.text_size, at, size)
        fresh = np.frombuffer(b"".join(found), "<u4")
        while self.used + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(fresh)] = fresh
        count = np.array([len(x) // 4 for x in found], np.int64)
        first = self.used + np.append(0, np.cumsum(count)[:-1])
        self.used += len(fresh)
        self.hashes, self.first, self.count = np.insert(self.hashes, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, count)

    @staticmethod
    def parts(word: str) -> tuple[str, str]:
        """Stem and closing marks; the tokenizer's ids of a word are those of the two. Letters up to U+017F but one stay single
        letters when they are normalised and lower-cased."""
        simple = word.isascii() or (max(word) <= "\u017f" and "\u0130" not in word)
        if not simple:
            return word, ""
        stem = word.rstrip(".,;:!?")
        return (stem, word[len(stem) :]) if stem and stem[-1].isalpha() else (word, "")

    def _plain_ids(self, stems: list[bytes]) -> dict[bytes, bytes]:
        """The ids of stems of lower-case letters by the model alone."""
        out: dict[bytes, bytes] = {}
        for i in range(0, len(stems), 512):
            group = stems[i : i + 512]
            text = _BYTE_CHARS[np.frombuffer(b" ".join(group), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, cut = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            out.update((x, raw[a:z]) for x, a, z in zip(group, cut[:-1], cut[1:], strict=True))
        return out

    def _stems(self, stems: set[str]) -> dict[str, bytes]:
        lower = lambda x: x.lower() if x.isascii() or (max(x) <= "\u017f" and "\u0130" not in x) else x
        whole = lambda x: x.isalpha() and x.islower() and (x.isascii() or max(x) <= "\u017f" and "\u00aa" not in x and "\u00ba" not in x)
        out: dict[str, bytes] = {}
        low = {x: lower(x) for x in stems}
        simple = [x for x, y in low.items() if self.plain is not None and whole(y)]
        known = self._plain_ids(list({low[x].encode() for x in simple}))
        out.update((x, known[low[x].encode()]) for x in simple)
        other = [x for x in stems if x not in out and self.mark_text and self.mark_text not in x]
        between = f" {self.mark_text} "
        for i in range(0, len(other), 512):
            group = other[i : i + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(group)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            raw, begin, end = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), 4 * len(ids)]
            out.update((x, raw[a:z]) for x, a, z in zip(group, begin, end, strict=True))
        for x in stems:
            if x not in out:
                out[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        return out


_LOADED: dict[str, WordIds] = {}


def pack_documents(df: DataFrame, vocabulary: str, width: int = 4096, closing_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    vocabulary: a tokenizers JSON file that every executor has, whose tokenizer drops white space and treats what lies between alone.
    """
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids ints" * with_ids)
    closing = np.array([closing_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordIds(vocabulary)
        words = _LOADED[vocabulary]
        packer, held, waiting, n_docs, gathered = Packer(width), {}, [], 0, 0
        sequence = TaskContext.get().partitionId() << 33

        def rows(windows: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for window in windows:
                offset = 0
                for doc, at, n in window:
                    doc_id, ids = held[doc]
                    part = ids[4 * at : 4 * (at + n)]
                    out.append((doc_id, at, n, zlib.crc32(part), len(ids) // 4, sequence, offset, *([np.frombuffer(part, "<i4")] * with_ids)))
                    offset += n
                sequence += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        def block(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, gathered
            packer.block(waiting)
            waiting, gathered = [], 0
            yield from rows(packer.done(least))
            still = {p[0] for w in packer.windows.values() for p in w}
            for doc in [d for d in held if d not in still]:
                del held[doc]

        for batch in common.slices(batches, most=4 << 20):
            ids, ends = words.batch(batch.column(1))
            raw, cut = ids.tobytes(), (4 * ends).tolist()
            for doc_id, a, z in zip(batch.column(0).to_pylist(), cut[:-1], cut[1:], strict=True):
                held[n_docs] = (doc_id, raw[a:z] + closing)
                waiting.append((n_docs, (z - a) // 4 + 1))
                n_docs, gathered = n_docs + 1, gathered + (z - a) // 4 + 1
            if gathered >= BLOCK_TOKENS:
                yield from block(LEAST_GAP)
        yield from block(1)
        yield from rows(packer.finish())

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(pack, common.spark_type(schema))
