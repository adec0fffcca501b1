"""Language ID of mixed-language text: script ranges, word scores, Viterbi.

Training counts byte trigrams and whole words of labelled documents, hashed into tables of fixed size, in one
pass over all of them with partial aggregation. A word's score for a language is a sum of log
probabilities. The script of a word's letters narrows the languages that may have it to those that were
seen to use the script. A Viterbi pass over the words of a document, with a penalty for each switch,
labels every word; runs of words with one label are the document's spans. A document's language is that of its
opening span if that language holds a share LEAD of the letters' bytes, else the one that holds most; its score is the
share that it holds. (Labelled documents open in their main language, even where another one fills more of them.)

All of it is vectorised: trigrams and words over byte buffers, Viterbi over groups of documents of like length
at once.

Edge cases: null text and text without a letter are `und` with score 0; so is every text if nothing could be
learned; null labels and null ids are not learned from; words without letters take the label that the path
gives them and count for nothing; ties go to the first language in order of name; texts are read whole;
repeated rows get equal labels; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Buckets of the trigram table and of the word table.
GRAMS, WORDS = 1 << 16, 1 << 16
#: Nats that a switch of language costs.
SWITCH = 9.0
#: Share of the letters from which the language that a document opens in is its language.
LEAD = 0.2
#: Score, in nats below the best, that a language is held to whose scripts exclude the word.
EXCLUDED = -25.0
#: A language uses a script if this share of its letters does.
SCRIPT_SHARE = 0.01
#: Languages that a model may have; it bounds what training gathers.
MOST_LANGUAGES = 400

# First code points of ranges of scripts, and the scripts; "" holds no letters of note.
SCRIPT_RANGES = (
    (0x00, ""), (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xAA, "Latin"), (0xAB, ""), (0xB5, "Latin"), (0xB6, ""), (0xBA, "Latin"), (0xBB, ""),
    (0xC0, "Latin"), (0xD7, ""), (0xD8, "Latin"), (0xF7, ""), (0xF8, "Latin"), (0x2B0, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"),
    (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x750, "Arabic"), (0x780, "Other"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Indic"), (0xE00, "Thai"),
    (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C00, "Other"), (0x2E00, ""), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"),
    (0x3200, ""), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFEFF, ""),
    (0xFF21, "Latin"), (0xFF3B, ""), (0xFF41, "Latin"), (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x10000, "Other"), (0x1F000, ""), (0x20000, "Han"), (0x30000, ""),
)
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
_ASCII = _SCRIPT[np.searchsorted(_STARTS, np.arange(128), "right") - 1]
_NONE = SCRIPTS.index("")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """The script of the character that each byte belongs to."""
    out = np.full(len(data), _NONE, np.int8)
    plain = data < 128
    out[plain] = _ASCII[data[plain]]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead = data[at].astype(np.int64)
        more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        cp = lead & np.array([0, 0x1F, 0x0F, 0x07])[more]
        for k in (1, 2, 3):
            here = more >= k
            cp[here] = cp[here] << 6 | data[np.minimum(at[here] + k, len(data) - 1)] & 0x3F
        script = _SCRIPT[np.searchsorted(_STARTS, cp, "right") - 1]
        for k in (0, 1, 2, 3):
            here = more >= k
            out[np.minimum(at[here] + k, len(data) - 1)] = script[here]
    return out


@dataclass
class Words:
    """The words of a text buffer: their document, trigram buckets by byte, word bucket, bytes of letters by script."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    grams: np.ndarray
    bucket: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    start, end, h = common.words(data, offsets, fold=True)
    doc = np.searchsorted(offsets, start, "right") - 1
    scripts = byte_scripts(data)
    letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum(scripts != _NONE, out=letter[1:])
    spots = np.flatnonzero(scripts != _NONE)
    letters = letter[end] - letter[start]
    script = np.full(len(start), _NONE, np.int8)
    has = letters > 0
    script[has] = scripts[spots[np.searchsorted(spots, start[has])]]  # of its first letter
    low = _FOLD[data]
    low[scripts == _NONE] = 32
    begins = np.zeros(len(data), bool)
    begins[start] = True
    one, two = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    one[1:], two[2:] = low[:-1], low[:-2]
    one[begins] = 32
    two[begins] = 32
    after = np.flatnonzero(begins[:-1]) + 1
    two[after] = 32
    grams = ((low | one << np.uint32(8) | two << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    grams[scripts == _NONE] = GRAMS  # a bucket that says nothing
    return Words(doc, start, end, grams.astype(np.int64), (h >> np.uint64(48)).astype(np.int64), letters, script)


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  # [GRAMS + 1, languages], nats against the mean of the languages
    words: np.ndarray
    allowed: np.ndarray  # [scripts, languages]

    def word_scores(self, w: Words) -> np.ndarray:
        """[words, languages]; 0 for words without letters."""
        out = np.empty((len(w.start), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            total = np.zeros(len(w.grams) + 1)
            np.cumsum(self.grams[w.grams, k], out=total[1:])
            out[:, k] = total[w.end] - total[w.start]
        out += self.words[w.bucket]
        out[w.letters == 0] = 0
        known = w.letters > 0
        narrow = ~self.allowed[w.script] & known[:, None] & self.allowed[w.script].any(1)[:, None]
        out[narrow] = EXCLUDED + out.min(initial=0)
        return out


def _model(languages: list[str], grams: np.ndarray, words: np.ndarray, scripts: np.ndarray) -> LanguageModel:
    """From counts [buckets, languages]."""

    if not languages:
        return LanguageModel([], np.zeros((GRAMS + 1, 0), np.float32), np.zeros((WORDS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))

    def nats(counts: np.ndarray, add: float) -> np.ndarray:
        p = np.log((counts + add) / (counts.sum(0) + add * len(counts)))
        return (p - p.mean(1, keepdims=True)).astype(np.float32)

    g = np.vstack([nats(grams, 0.5), np.zeros((1, len(languages)), np.float32)])
    w = nats(words, 2.0)
    w[words.sum(1) < 3] = 0
    return LanguageModel(languages, 0.5 * g, 0.5 * w, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Counts over all rows of df with a text and a label."""
    common.small_batches(df.sparkSession)
    schema = common.shape("lang string, bucket int, n long")
    size = GRAMS + WORDS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            data, offsets = common.text_bytes(batch.column(1))
            w = words_of(data, offsets)
            names, code = np.unique(np.array(batch.column(0).to_pylist(), str), return_inverse=True)
            kind, gram_kind, has = code[w.doc], np.repeat(code, np.diff(offsets)), w.letters > 0
            for i, lang in enumerate(names.tolist()):
                into = sums.setdefault(lang, np.zeros(size, np.int64))
                into[:GRAMS] += np.bincount(w.grams[gram_kind == i], minlength=GRAMS + 1)[:GRAMS]
                mine = has & (kind == i)
                into[GRAMS : GRAMS + WORDS] += np.bincount(w.bucket[mine], minlength=WORDS)
                into[GRAMS + WORDS :] += np.bincount(w.script[mine], weights=w.letters[mine], minlength=len(SCRIPTS)).astype(np.int64)
        for lang, total in sums.items():
            b = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b, pa.int32()), pa.array(total[b])], schema=schema)

    rows = df.select(df[lang_col].cast("string").alias("lang"), df[text_col].alias("text")).dropna().mapInArrow(count, common.spark_type(schema)).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row for each language and bucket: its number does not depend on the documents'
    rows = common.staged(rows, "languages")
    n = rows.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages, more than the {MOST_LANGUAGES} that a table on the driver may hold")
    found = rows.toArrow()
    code = found["lang"].combine_chunks().dictionary_encode()
    names = code.dictionary.to_pylist()
    languages = sorted(names)
    table = np.zeros((size, len(languages)))
    place = np.array([languages.index(x) for x in names], int)
    table[found["bucket"].to_numpy(), place[code.indices.to_numpy()] if names else []] = found["n"].to_numpy()
    return _model(languages, table[:GRAMS], table[GRAMS : GRAMS + WORDS], table[GRAMS + WORDS :])


def _settled(scores: np.ndarray, offsets: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """The best single label of each document, and whether no path with switches can beat it.

    A path that leaves label k for runs of other labels pays one switch for each run at least, and a run of label j gains at
    most the largest sum of score(j) - score(k) over consecutive words. If no such sum is above the price, k alone is best."""
    n, words = len(offsets) - 1, len(scores)
    total = np.vstack([np.zeros((1, scores.shape[1])), np.cumsum(scores, 0, dtype=np.float64)])
    best = (total[offsets[1:]] - total[offsets[:-1]]).argmax(1)
    settled = np.ones(n, bool)
    if not words:
        return best, settled
    doc = np.repeat(np.arange(n), np.diff(offsets))
    own = np.take_along_axis(scores, best[doc][:, None], 1)[:, 0].astype(np.float64)
    for j in range(scores.shape[1]):
        gain = scores[:, j] - own
        after = np.cumsum(gain)
        before = after - gain
        apart = 2 * np.abs(gain).sum() + 1  # sets documents apart, so that one running minimum serves them all
        low = np.minimum.accumulate(before - doc * apart) + doc * apart
        most = after - low
        settled[doc[most > switch]] = False
    return best, settled


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word: maximises the sum of scores less `switch` for each change of label. offsets: of the documents
    in scores. Documents that one label explains are settled without the recurrence; the others go through it together with
    those of like length."""
    n_labels, lengths = scores.shape[1], np.diff(offsets)
    best_label, settled = _settled(scores, offsets, switch)
    out = np.repeat(best_label, lengths).astype(np.int16)
    order = np.argsort(lengths, kind="stable")
    order = order[~settled[order] & (lengths[order] > 0)]
    lo = 0
    while lo < len(order):
        most, hi = 512, lo + 1
        while hi < len(order) and hi - lo < most and lengths[order[hi]] <= 1.5 * lengths[order[lo]] + 64:
            hi += 1
        docs, lo = order[lo:hi], hi
        size, steps = lengths[docs], int(lengths[docs[-1]])
        begin, rows = offsets[docs], np.arange(len(docs))
        best = scores[begin].astype(np.float64)
        moved = np.zeros((steps, len(docs), n_labels), bool)  # whether the label before was the best one, not the same one
        top = np.zeros((steps, len(docs)), np.int16)
        live = np.searchsorted(size, np.arange(steps), "right")  # documents are in order of length: those from here on go on
        for t in range(1, steps):
            k = live[t]
            now = best[k:]
            lead = now.argmax(1)
            switched = (now[rows[: len(docs) - k], lead] - switch)[:, None]
            np.greater(switched, now, out=moved[t, k:])
            top[t, k:] = lead
            best[k:] = np.maximum(now, switched) + scores[begin[k:] + t]
        label = best.argmax(1).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            out[begin[k:] + t] = label[k:]
            if t:
                label[k:] = np.where(moved[t, rows[k:], label[k:]], top[t, k:], label[k:])
    return out


@dataclass
class Labelled:
    """A batch's words: their document, bytes of letters, label; the documents' offsets in them; letters without A-Z and a-z."""

    doc: np.ndarray
    letters: np.ndarray
    label: np.ndarray
    at: np.ndarray
    no_ascii: np.ndarray


def _labelled(model: LanguageModel, batch: pa.RecordBatch, switch: float) -> Labelled:
    parts, base = [], 0
    for part in common.slices(iter([batch]), most=2 << 20):
        data, offsets = common.text_bytes(part.column(1))
        w = words_of(data, offsets)
        plain = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data < 128) & (_ASCII[data & 127] != _NONE), out=plain[1:])
        parts.append((w.doc + base, w.letters, model.word_scores(w), plain[offsets[1:]] == plain[offsets[:-1]]))
        base += part.num_rows
    doc, letters, scores, no_ascii = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    return Labelled(doc, letters, viterbi(scores, at, switch), at, no_ascii)


def decided(model: LanguageModel, batch: pa.RecordBatch, switch: float = SWITCH, lead: float = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and number of spans of each text in column 1, for a model with languages."""
    w, n, k = _labelled(model, batch, switch), batch.num_rows, len(model.languages)
    held = np.bincount(w.doc * k + w.label, weights=w.letters, minlength=n * k).reshape(n, k)
    total = held.sum(1)
    spans = np.bincount(w.doc, weights=_begins(w), minlength=n).astype(np.int64)
    pick = held.argmax(1)
    some = np.flatnonzero(np.diff(w.at))
    first = w.label[w.at[some]]
    leads = held[some, first] >= lead * total[some]
    pick[some[leads]] = first[leads]
    names = np.array(model.languages, object)[pick]
    score = held[np.arange(n), pick] / np.maximum(total, 1)
    for i in np.flatnonzero(w.no_ascii):  # script ranges are coarse: ask for a letter proper
        if not any(map(str.isalpha, batch.column(1)[int(i)].as_py() or "")):
            names[i], score[i], spans[i] = UNKNOWN, 0.0, 0
    return names, score, spans


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, lead: float = LEAD) -> DataFrame:
    """doc_id, lang_pred, score and n_spans of each row's whole text."""
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, lang_pred string, score double, n_spans long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(model.languages)
            if not n:
                continue
            if not k:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))], schema=schema)
                continue
            names, score, spans = decided(model, batch, switch, lead)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(spans)], schema=schema)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, common.spark_type(schema))


def _begins(w: Labelled) -> np.ndarray:
    """Whether each word begins a span."""
    new = np.ones(len(w.label), bool)
    new[1:] = (w.label[1:] != w.label[:-1]) | (w.doc[1:] != w.doc[:-1])
    return new


def spans(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, first_word, n_words, lang of each span of each row's whole text, in words from 0."""
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, first_word long, n_words long, lang string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not model.languages or not batch.num_rows:
                continue
            w = _labelled(model, batch, switch)
            first = np.flatnonzero(_begins(w))
            ids = batch.column(0).take(pa.array(w.doc[first]))
            names = pa.array([model.languages[i] for i in w.label[first]], pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(first - w.at[w.doc[first]]), pa.array(np.diff(np.append(first, len(w.label)))), names], schema=schema)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, common.spark_type(schema))


def accepted(df: DataFrame, model: LanguageModel, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """The rows of df, with its columns, that predict does not call UNKNOWN. Texts with a letter always get a language, so which
    rows stay does not depend on what was learned. Without any learned language, rows with a letter stay."""
    common.small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(at)
            if model.languages:
                stays = decided(model, pa.RecordBatch.from_arrays([texts, texts], ["id", "text"]), switch)[0] != UNKNOWN
            else:
                stays = [any(map(str.isalpha, t or "")) for t in texts.to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def identify(df: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans: learned from the labelled rows outside fold `held`, applied to every row.
    A null doc_id is in no fold; its held_out is null."""
    model = train(df.where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held)))
    return predict(df, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "n_spans")
