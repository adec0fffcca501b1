"""Secret scans: three fixed patterns, and guess costs of values in a credential context.

Base spans are the leftmost non-overlapping matches of each kind, kept if long enough. Beyond them, every
value that stands in a credential context gets the least number of guesses that a dynamic programme
finds over segmentations into words, dates, repeats, sequences, keyboard walks and brute-force spans; a value
that costs GUESS_LOG10 decimal digits of guesses or more becomes a span of kind `guess`, unless a base
span covers a part of it.

Words, compounds with hyphens among them, are priced by their rank among the MOST_WORDS most frequent ones of the corpus, counted over
all texts but not where they stand as a value in credential context, and in a short list of common passwords. Other letters are priced
by a model of three letters learnt from those words, digit for digit: letters that read like the corpus are cheaper than random ones, which
cost their entropy or more. So a word of prose after `token:` is no secret, and twelve random letters are.

Edge cases: null and empty text have no spans; texts and values are read whole, whatever their length, and a value takes memory for
the states whose cost is still below the threshold only; offsets count code points; repeated rows give repeated rows; a null
doc_id stays null; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
#: Names before a value that may be a credential, and the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|credentials?|auth)(?:["']?\x20*(?::=|=>|[:=])\x20*|\x20(?:is|was)\x20+(?=\S*[0-9]))["'`]?([^\s"'`,;<>(){}\[\]]{6,})""",
    re.I | re.A,
)
#: What every match of CONTEXT holds, by the same flags.
_JOINT = re.compile(r"[:=]|\x20(?:is|was)\x20", re.I | re.A)
#: Decimal digits of guesses from which a value counts as a secret.
GUESS_LOG10 = 10.0
#: Words of the corpus that are priced by rank; how often each is seen outside of credential context; and the longest of them.
MOST_WORDS, LEAST_SEEN, LONGEST_WORD = 50_000, 5, 30
#: Weight of the shorter context in the model of letters, in letters seen; decimal digits of a letter that is none of a-z, beyond its class.
DRAWN, OTHER_LETTER = 5.0, 1.5

# Common passwords and the words that passwords are made of, by falling frequency.
WORDS = """password qwerty dragon monkey letmein football baseball master shadow michael superman batman trustno welcome login admin princess
sunshine iloveyou starwars hello freedom whatever secret summer winter spring autumn garden hunter ranger jordan soccer killer pepper ginger
cookie cheese banana orange purple yellow silver golden diamond access computer internet service server system user guest root test temp
changeme default example sample demo public private love life time world house money magic power black white green blue red king queen star
moon fire water earth wind january february march april june july august september october november december monday tuesday wednesday
thursday friday saturday sunday the and for you are not with this that from have""".split()
# The rows of a keyboard, unshifted; column c of a row lies next to columns c and c + 1 of the row above.
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
# Letters that stand for others.
LEET = str.maketrans("@4831!05$7+2", "aabeiiosstts")

_RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = re.compile(r"(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d)|(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])")


def _neighbours() -> dict[str, set[str]]:
    at = {(r, c): k for r, row in enumerate(KEYS) for c, k in enumerate(row)}
    near = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, -1))
    return {k: {at[r + i, c + j] for i, j in near if (r + i, c + j) in at} for (r, c), k in at.items()}


_NEAR = _neighbours()


def _alphabet(value: str) -> float:
    """Decimal digits of a guess at one character of the value by brute force."""
    sizes = (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 33))
    return math.log10(max(10, sum(n for p, n in sizes if re.search(p, value))))


class Prices:
    """What words and letters cost, in decimal digits of guesses. ranks: of the corpus's words, from 1."""

    def __init__(self, ranks: dict[str, int] | None = None) -> None:
        self.ranks = _RANK | (ranks or {})
        for word, rank in _RANK.items():
            self.ranks[word] = min(rank, self.ranks[word])
        n = np.zeros((28, 28, 27))  # two letters before, 27 for none; the letter
        for word in self.ranks:
            before, last = 27, 27
            for c in map(_letter, filter(str.isalpha, word)):
                n[before, last, c] += 1
                before, last = last, c
        one = (n.sum((0, 1)) + 1) / (n.sum() + 27)
        two = (n.sum(0) + DRAWN * one) / (n.sum((0, 2))[:, None] + DRAWN)
        three = (n + DRAWN * two) / (n.sum(2)[..., None] + DRAWN)
        self.letters = (-np.log10(three)).tolist()


def _letter(c: str) -> int:
    c = c.lower()
    return ord(c) - 97 if "a" <= c <= "z" else 26


_AGAIN = {k: re.compile(rf"(.{{{k}}})\1{{{2 if k == 1 else 1},}}", re.S) for k in (1, 2, 3, 4)}


def segments(value: str, i: int, most: float, prices: Prices, letter: float) -> dict[int, float]:
    """Ends of the segments that start at i, with their decimal digits of guesses, for those below `most`; brute force is not among
    them. A word: its rank, and twice for each of other case and of letters written as signs. Letters as the model has them, twice if they are capitals
    or begin with one, and twice each if their case is mixed. A year, a date. A walk of three or more neighbouring keys, of any length. A unit of up to four characters said again as often as it goes on. Steps up or
    down the alphabet as far as they go."""
    n, out = len(value), {}

    def offer(j: int, digits: float) -> None:
        if digits < most:
            out[j] = min(digits, out.get(j, math.inf))

    part = value[i : i + LONGEST_WORD]
    low = part.lower()
    if len(low) != len(part):
        low = part
    plain = low.translate(LEET)
    for k in range(3, len(part) + 1):
        rank, signs = prices.ranks.get(low[:k], math.inf), 1
        if rank == math.inf and plain[:k] != low[:k]:
            rank, signs = prices.ranks.get(plain[:k], math.inf), 2
        if rank < math.inf:
            offer(i + k, math.log10(rank * signs * (2 if part[:k] != low[:k] else 1)) + 0.3)
    j, digits, before, last, capitals = i, 0.0, 27, 27, 0
    while j < n and digits < most and value[j].isalpha():
        c = _letter(value[j])
        digits += prices.letters[before][last][c] + (OTHER_LETTER if c == 26 else 0.0)
        before, last, capitals, j = last, c, capitals + value[j].isupper(), j + 1
        case = 0.0 if not capitals else math.log10(2) * (1 if capitals == j - i or (capitals == 1 and value[i].isupper()) else j - i)
        offer(j, digits + case)
    m = _YEAR.match(value, i)
    if m:
        offer(m.end(), math.log10(120))
    m = _DATE.match(value, i)
    if m:
        offer(m.end(), math.log10(120 * 365))
    j, digits = i + 1, math.log10(len(_NEAR)) + 0.5 * math.log10(4)
    while j < n and digits < most and value[j].lower() in _NEAR.get(value[j - 1].lower(), ()):
        j, digits = j + 1, digits + 0.5 * math.log10(4)
        if j - i >= 3:
            offer(j, digits)
    for k, again in _AGAIN.items():
        m = again.match(value, i)
        if m:
            offer(m.end(), k * letter + math.log10((m.end() - i) // k))
    if i + 2 < n:
        step = ord(value[i + 1]) - ord(value[i])
        if step in (1, -1):
            j = i + 2
            while j < n and ord(value[j]) - ord(value[j - 1]) == step:
                j += 1
            if j - i >= 3:
                offer(j, 1.5 + math.log10(j - i))
    return out


def guess_log10(value: str, least: float = GUESS_LOG10, prices: Prices | None = None) -> float:
    """The decimal logarithm of the least guesses over all segmentations of the value, or `least` if that is less; 0 for an empty value.

    A segmentation costs the sum of its segments' digits and, for s segments, the digits of s!: an attacker has to try their orders.
    A brute-force span costs the digits of one character of the value's alphabet for each of its characters. States that cost `least`
    or more are dropped, so few are left at any place, and a costly value ends early."""
    n, prices = len(value), prices or _plain()
    if not n:
        return 0.0
    letter, orders = _alphabet(value), [0.0]
    while orders[-1] < least:
        orders.append(orders[-1] + math.log10(len(orders)))
    # at each place still to come: by number of segments, the least digits where a segment ends and inside a brute-force span
    ahead: dict[int, tuple[dict[int, float], dict[int, float]]] = {0: ({0: 0.0}, {})}
    while ahead:
        i = min(ahead)
        closed, brute = ahead.pop(i)
        if i == n:
            return min(least, min(d + orders[s] for states in (closed, brute) for s, d in states.items()))

        def reach(j: int, kind: int, s: int, digits: float) -> None:
            if s < len(orders) and digits + orders[s] < least:
                states = ahead.setdefault(j, ({}, {}))[kind]
                states[s] = min(digits, states.get(s, math.inf))

        best = {s: min(closed.get(s, math.inf), brute.get(s, math.inf)) for s in closed.keys() | brute.keys()}
        for s, digits in closed.items():
            reach(i + 1, 1, s + 1, digits + letter)
        for s, digits in brute.items():
            reach(i + 1, 1, s, digits + letter)
        for j, more in segments(value, i, least - min(best.values()), prices, letter).items():
            for s, digits in best.items():
                reach(j, 0, s + 1, digits + more)
    return least


@functools.cache
def _plain() -> Prices:
    """Prices without a corpus."""
    return Prices()


def counted_words(df: DataFrame, text_col: str = "text", most: int = MOST_WORDS, least: int = LEAST_SEEN) -> dict[str, int]:
    """The ranks, from 1, of the most frequent words of all texts, of those seen `least` times outside of credential context; of equally
    frequent ones by the alphabet. Words are runs between white space without what surrounds their letters, in lower case, of 3 to LONGEST_WORD
    letters, or such letters and hyphens. Every word is counted; as many come to the driver as have counts of which, by steps of a sixteenth of
    a doubling, there are no more than `most` from there up."""
    common.small_batches(df.sparkSession)
    schema = common.shape("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], schema=schema)
            count.clear()

        for batch in common.slices(batches, 0):
            data, offsets = common.text_bytes(batch.column(0))
            start, end, h = common.words(data, offsets, fold=True)
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            whole = data.tobytes()
            for a, z, k in zip(start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                if z - a <= 4 * LONGEST_WORD + 16:
                    word = _word(whole[a:z].decode("utf-8", "replace"))
                    if word:
                        count[word] += k
            for text in batch.column(0).to_pylist():
                for a, z in contexts(text or ""):
                    while a and text[a - 1] not in _BREAKS:
                        a -= 1
                    while z < len(text) and text[z] not in _BREAKS:
                        z += 1
                    word = _word(text[a:z]) if z - a <= LONGEST_WORD + 16 else ""
                    if word:
                        count[word] -= 1
            if len(count) > 200_000:
                yield from counted()
        yield from counted()

    counts = df.select(df[text_col].alias("text")).mapInArrow(run, common.spark_type(schema)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # counts by sixteenths of their binary logarithm, a thousand at most; the highest of them that hold `most` words together
    counts = common.staged(counts.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "words")
    total, lowest = 0, None
    for step, n in sorted(counts.groupBy("step").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        lowest = step
    found = [] if lowest is None else counts.where(F.col("step") >= lowest).select("word", "n").toArrow().to_pylist()
    return {r["word"]: k for k, r in enumerate(sorted(found, key=lambda r: (-r["n"], r["word"])), 1)}


_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_BREAKS = "".join(map(chr, common.WORD_BREAKS))


def _word(run: str) -> str:
    """The word of a run between white space, or ''."""
    word = _EDGES.sub("", run).lower()
    return word if 3 <= len(word) <= LONGEST_WORD and word.replace("-", "").isalpha() else ""


def contexts(text: str) -> list[tuple[int, int]]:
    """Start and end of every value in credential context, by CONTEXT or by ASSIGN, in order and disjoint."""
    if not _JOINT.search(text):
        return []
    out, at = [], 0
    for a, z in sorted([m.span(1) for m in CONTEXT.finditer(text)] + [m.span(2) for m in ASSIGN.finditer(text)]):
        if a >= at:
            out.append((a, z))
            at = z
    return out


def spans(text: str, least: float = GUESS_LOG10, prices: Prices | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, in order."""
    base = []
    if ":" in text or "=" in text:
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    found = [m.span(1) for m in CONTEXT.finditer(text)] if _JOINT.search(text) else []
    free = [x for x in found if not any(a < x[1] and x[0] < b for _, a, b in base)]
    added = [("guess", a, b) for a, b in free if guess_log10(text[a:b], least, prices) >= least]
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = GUESS_LOG10, ranks: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans of each row's whole text. ranks: of words; by default those
    of df's own texts."""
    common.small_batches(df.sparkSession)
    schema = common.shape("doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
    known = df.sparkSession.sparkContext.broadcast(Prices(counted_words(df, text_col) if ranks is None else ranks))  # MOST_WORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            each = [spans(x or "", least, known.value) for x in batch.column(1).to_pylist()]
            count = [pa.array([sum(k == kind for k, _, _ in f) for f in each], pa.int64()) for kind in KINDS]
            sha = [hashlib.sha256(listed([x for x in f if x[0] != "guess"]).encode()).hexdigest() for f in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), *count, pa.array(sha, pa.string()), pa.array(map(listed, each), pa.string())], schema=schema)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, common.spark_type(schema))


def redact(text: str, least: float = GUESS_LOG10, prices: Prices | None = None, mark: str = "<SECRET>") -> str:
    """The text with each span, or run of overlapping spans, replaced by `mark`; base spans whatever their value costs."""
    out, at = [], 0
    for _, a, b in spans(text, least, prices):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if at else text


def redacted(df: DataFrame, text_col: str = "text", least: float = GUESS_LOG10, ranks: dict[str, int] | None = None) -> DataFrame:
    """df with the same columns and the spans of text_col replaced; a null text stays null. ranks: as for scan."""
    common.small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    known = df.sparkSession.sparkContext.broadcast(Prices(counted_words(df, text_col) if ranks is None else ranks))  # MOST_WORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            new = pa.array([x if x is None else redact(x, least, known.value) for x in col.to_pylist()], col.type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return df.mapInArrow(run, df.schema)
