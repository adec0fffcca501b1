"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at public quantiles of the training sample. Boosting goes round the features:
each round fits a shallow tree over one feature's bins to the gradient and adds it to that
feature's look-up table, so all trees of a feature collapse into one table. Then the pairs of features whose
four-quadrant fit lowers the loss most are boosted in the same way with trees of depth two over a grid of
coarse bins. A score is a sum of look-ups, one for each feature and pair, through the logistic function.

Training reads a sample of labelled rows, bounded by `most_rows` (the rows whose hashed id is smallest);
scoring reads every whole text.

Edge cases: null and empty text have all-zero features and a score like any other; a label table with
several rows for an id counts its largest label; null labels and null ids are not learned from; without
any labelled row, or with one class only, the score is the smoothed share of label 1 (0.5 without
labels); repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = (
    "log_words", "log_bytes", "word_length", "upper_share", "digit_share", "mark_share", "symbol_share", "wide_share", "line_rate",
    "stop_rate", "repeat_share", "distinct_share", "distinct_pair_share", "symbol_end_share", "caps_word_share", "long_word_share", "top_run_share",
)


def _table(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members]] = True
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_MARK = _table(".,;:!?'\"()-")
_SYMBOL = _table("#$%&*+/<=>@[\\]^_`{|}~")
_WIDE = np.arange(256) >= 128
_NEWLINE, _STOP = _table("\n"), _table(".!?")


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each row of a text buffer."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets).astype(float)
    start, end, h = common.words(data, offsets, fold=False)
    doc = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(doc, minlength=n).astype(float)

    def bytes_of(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total

    def words_where(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / np.maximum(count, 1)

    upper = bytes_of(_UPPER)
    per_doc = lambda total: total[offsets[1:]] - total[offsets[:-1]]
    letters = per_doc(upper) + per_doc(bytes_of(_LOWER))
    safe = np.maximum(size, 1)
    out[:, 0], out[:, 1] = np.log1p(count), np.log1p(size)
    out[:, 2] = np.bincount(doc, weights=end - start, minlength=n) / np.maximum(count, 1)
    out[:, 3] = per_doc(upper) / np.maximum(letters, 1)
    for k, table in ((4, _DIGIT), (5, _MARK), (6, _SYMBOL), (7, _WIDE)):
        out[:, k] = per_doc(bytes_of(table)) / safe
    out[:, 8] = per_doc(bytes_of(_NEWLINE)) / np.maximum(count, 1)
    out[:, 9] = per_doc(bytes_of(_STOP)) / np.maximum(count, 1)
    if len(h):
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, 10] = words_where(same)
        out[:, 11] = _distinct(doc, h, n) / np.maximum(count, 1)
        pair = common.mix(h[:-1] * np.uint64(3) + h[1:])
        inside = doc[1:] == doc[:-1]
        out[:, 12] = _distinct(doc[:-1][inside], pair[inside], n) / np.maximum(count - 1, 1)
        out[:, 13] = words_where(_SYMBOL[data[end - 1]])
        caps = upper[end] - upper[start]
        out[:, 14] = words_where((caps >= 2) & (2 * caps >= end - start))
        out[:, 15] = words_where(end - start >= 20)
        first = np.flatnonzero(~same)
        length = np.diff(np.append(first, len(h)))
        longest = np.zeros(n)
        np.maximum.at(longest, doc[first], length)
        out[:, 16] = longest / np.maximum(count, 1)
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct hashes of each document."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)


@dataclass
class AdditiveModel:
    """Look-up tables: mains[j][bin], and pairs {(i, j): grid}, over cuts[j] and coarse[j]."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    mains: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.mains):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "left")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], "left") for p in self.pairs for j in p}
        for (i, j), grid in self.pairs.items():
            total += grid[bins[i], bins[j]]
        return _logistic(total)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))[: bins - 1]


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The value of each bin by a tree over ordered bins that is grown by its best split until it has `leaves` leaves."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    parts = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        gain = _gain(cg[k] - cg[a], ch[k] - ch[a], ridge) + _gain(cg[b] - cg[k], ch[b] - ch[k], ridge) - _gain(cg[b] - cg[a], ch[b] - ch[a], ridge)
        return float(gain.max()), int(k[gain.argmax()])

    while len(parts) < leaves:
        (gain, k), (a, b) = max(((best(*p), p) for p in parts), key=lambda t: t[0][0])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, int]:
    """The best cut of a grid into four quadrants: its gain over no cut, and the first row and column beyond it."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    r, c = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not r.size:
        return 0.0, 0, 0

    def four(t: np.ndarray) -> list[np.ndarray]:
        a, b, d, e = t[r, c], t[r, -1], t[-1, c], t[-1, -1]
        return [a, b - a, d - a, e - b - d + a]

    gain = sum(_gain(x, y, ridge) for x, y in zip(four(cg), four(ch), strict=True)) - _gain(cg[-1, -1], ch[-1, -1], ridge)
    k = int(gain.argmax())
    return float(gain.flat[k]), int(r.flat[k]), int(c.flat[k])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, grid: int = 8, rounds: int = 160, pair_rounds: int = 60, n_pairs: int = 6, leaves: int = 3, rate: float = 0.1, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of the mains, then of the best pairs. The same rows in the same order give the same model."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    n_features = x.shape[1]
    model.cuts = [_quantile_cuts(x[:, j], bins) for j in range(n_features)]
    model.coarse = [_quantile_cuts(x[:, j], grid) for j in range(n_features)]
    model.mains = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(model.cuts)]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = _logistic(z)
            step = rate * _tree(np.bincount(b, y - p, len(model.mains[j])), np.bincount(b, p * (1 - p), len(model.mains[j])), leaves, ridge)
            model.mains[j] += step
            z += step[b]
    rough = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(model.coarse)]
    wide = [len(c) + 1 for c in model.coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, p = rough[i] * wide[j] + rough[j], _logistic(z)
        return cell, np.bincount(cell, y - p, wide[i] * wide[j]).reshape(wide[i], wide[j]), np.bincount(cell, p * (1 - p), wide[i] * wide[j]).reshape(wide[i], wide[j])

    ranked = sorted(((_quadrants(*sums(i, j)[1:], ridge)[0], i, j) for i in range(n_features) for j in range(i + 1, n_features)), key=lambda t: (-t[0], t[1], t[2]))
    model.pairs = {(i, j): np.zeros((wide[i], wide[j])) for gain, i, j in ranked[:n_pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            cell, g, h = sums(i, j)
            _, r, c = _quadrants(g, h, ridge)
            step = np.zeros_like(table)
            for rows in (slice(0, r), slice(r, None)):
                for cols in (slice(0, c), slice(c, None)):
                    step[rows, cols] = rate * g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
            table += step
            z += step.ravel()[cell]
    return model


def features_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES of each row's whole text."""
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = text_features(*common.text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(x.T))], schema=schema)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, common.spark_type(schema))


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> AdditiveModel:
    """Fits a model to the labelled rows of df whose hashed ids are smallest, `most_rows` ids at most. Of rows that share an id the one
    with the least features counts."""
    known = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_label")).dropna().groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text"))
    # most_rows bounds the side that is sent to every executor: 12 bytes a row
    rows = features_of(texts.join(F.broadcast(chosen.select("_id")), "_id", "left_semi"), "_id", "_text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("_label", *FEATURES)).alias("x")).select("doc_id", "x.*")
    found = one.toArrow().to_pandas().sort_values("doc_id")
    return fit(found[list(FEATURES)].to_numpy(float), (found["_label"].to_numpy() > 0).astype(float))


def score(df: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the chance of label 1, of each row's whole text."""
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = text_features(*common.text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=schema)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, common.spark_type(schema))


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def classify(df: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels outside the first fold, applied to every row.
    A null doc_id is in no fold; its held_out is null."""
    model = train(df, labels.where(fold("doc_id", folds) != 0), most_rows=most_rows)
    scored = score(df, model)
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
