"""Main text of pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive where their place in the markup speaks for content, tags score
negative, and one linear scan finds the contiguous region with the largest sum. The weights are log-ratios of rates inside and outside
of the main region over all labelled pages; a page is labelled if it names its main region itself, by an `article` or `main`
element that has words. Every rate is smoothed by PRIOR, so what no labelled page has gets a fixed weight.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments that stand in the region are cut out of it: an
element is one of them by its tag, its role, or a word of its class or id (NOISE). An element named so by its class or id that
holds the page's main part is none. Of a header inside an article the headings stay.

Text of one block is joined as it stands, `br` is white space, references are decoded, white space becomes one space; blocks are joined
by an empty line.

Edge cases: null and empty html, and pages without words of content, have an empty text; unclosed, wrongly nested, unknown and cut-off
tags are tolerated, a tag that the page's end cuts off is none; pages of any length are read whole, in time proportional to their
length; repeated rows give repeated rows; null ids and urls stay; other columns are not read; an empty table gives an empty table, and
without labelled pages the weights are those of PRIOR.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header
hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
NOISE_TAGS = set("""aside audio button canvas datalist dialog footer form head header iframe input label legend map menu nav noscript object option optgroup
search select svg template video""".split())
NOISE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words of a class or id that name noise. Those of the second list are none on an element that holds an article.
NOISE = set("""ad ads adsense advert advertise advertisement advertisements adverts adblock comment commentary comments commentlist disqus discussion livefyre outbrain promo promoted
promotion recirculation recommendation recommendations recommended related reply replies respond sponsor sponsored taboola""".split())
SOFT_NOISE = set("""alert aside banner breadcrumb breadcrumbs consent cookie cookies footer form gdpr header login masthead menu modal nav navbar navigation newsletter
notice notification overlay pager pagination popup search share sharing sidebar signup skip social subscribe subscription toolbar widget widgets""".split())
#: An element that an opening tag ends, and the elements beyond which that one is not looked for.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}

#: Rates in and out of the main region that every estimate is drawn to, by SMOOTH of its weight.
PRIOR = {("block", "p"): (1.0, 0.3), ("block", "li"): (0.3, 0.5), ("block", "td"): (0.3, 0.5), ("block", "th"): (0.3, 0.5), ("link", "yes"): (0.1, 0.6), ("link", "no"): (1.0, 0.4), ("place", "in"): (1.0, 0.1), ("place", "out"): (0.1, 1.0)}
PRIOR |= {("block", h): (0.5, 0.3) for h in (*sorted(HEADINGS), "blockquote", "pre", "figcaption")}
SMOOTH = 0.01
#: Bounds of the weights of one kind, of a word, and of what a tag costs.
KIND_MOST, WORD_LEAST, WORD_MOST, TAG_LEAST, TAG_MOST = 3.0, -1.0, 2.0, 0.05, 2.0
#: What a noise element costs where the page names no region, outside of a region and inside of it.
NOISE_COST = {-1: 1.0, 0: TAG_MOST, 1: TAG_LEAST}
#: How far down the open elements are searched for one that a tag ends.
DEEP = 256

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|textarea|title|xmp|noembed|noframes)(?=[\s/>])(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(tag: str, attributes: str, within: int) -> tuple[int, bool, int]:
    """How an element is noise: 0 not, 1 but for headings, 2 whole; whether only by its class or id; and as which region it counts, 1
    main or 2 article."""
    place = 2 if tag == "article" else 1 if tag == "main" else 0
    noise = (1 if tag == "header" and within else 2) if tag in NOISE_TAGS else 0
    named = False
    if attributes:
        for kind, *values in _NAMED.findall(attributes):
            value = values[0] or values[1] or values[2]
            if kind.lower() == "role":
                place = max(place, {"article": 2, "main": 1}.get(value.lower(), 0))
                noise = 2 if value.lower() in NOISE_ROLES else noise
            elif kind.lower() == "itemprop":
                place = 2 if value.lower() == "articlebody" else place
            elif not noise and tag not in ("html", "body", "main"):
                words = {w.lower() for w in _PARTS.findall(value)}
                if words & NOISE or (place != 2 and tag not in HEADINGS and words & SOFT_NOISE):
                    noise, named = 2, True
    return noise, named, place


@dataclass
class Run:
    """Text between tags: the block that it belongs to, that block's tag, and where it stands."""

    block: int
    text: str
    tag: str
    link: bool
    noise: int
    place: int
    words: int = 0


@dataclass
class Page:
    """Tokens in order: a Run, or a tag's name with the noise that it stands in and its place."""

    tokens: list[Run | tuple[str, int, int]] = field(default_factory=list)
    noise: list[int] = field(default_factory=list)  # by marked element: 0, 1 or 2, ancestors counted


class _Parser:
    """One pass over the tags, with a stack of open elements."""

    def __init__(self) -> None:
        self.page, self.block = Page(), 0
        #: tag, marked element, in a link, region, tag of the nearest block
        self.open: list[tuple[str, int, bool, int, str]] = [("", 0, False, 0, "")]
        self.opened: Counter[str] = Counter()
        #: by marked element: its parent, noise, whether by name only, whether a name that an article lifts; holds h1 or main, article
        self.marked: list[list] = [[0, 0, False, False, False]]

    def _pop(self, size: int) -> None:
        for frame in self.open[size:]:
            self.opened[frame[0]] -= 1
        del self.open[size:]

    def _end_before(self, tags: set[str], beyond: set[str] | None) -> None:
        """Ends the nearest open element of `tags`, unless one of `beyond`, by default any other block, is nearer."""
        if not any(self.opened[t] > 0 for t in tags):
            return
        for k in range(len(self.open) - 1, max(0, len(self.open) - DEEP), -1):
            tag = self.open[k][0]
            if tag in tags:
                self._pop(k)
                return
            if tag in beyond if beyond is not None else tag in BLOCKS:
                return

    def _holds(self, element: int, main: bool) -> None:
        at = 3 if main else 4
        while element and not self.marked[element][at]:
            self.marked[element][at] = True
            element = self.marked[element][0]

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.block += 1
            self._end_before({"p"}, None)
            if tag in ENDS:
                self._end_before(*ENDS[tag])
            if tag == "body" and self.opened["head"] > 0:
                self._pop(next(k for k, f in enumerate(self.open) if f[0] == "head"))
        _, element, link, place, block = self.open[-1]
        noise, named, region = _marks(tag, attributes, place)
        if tag in ("h1", "main", "article"):
            self._holds(element, tag != "article")
        if noise and tag not in VOID:
            self.marked.append([element, noise, named, tag in ("h1", "main"), tag == "article"])
            element = len(self.marked) - 1
        self.page.tokens.append((tag, element, place))
        if tag in BLOCKS or region or element != self.open[-1][1] or tag == "a":
            if tag not in VOID:
                self.open.append((tag, element, link or tag == "a", max(place, region), tag if tag in BLOCKS else block))
                self.opened[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if self.opened[tag] > 0:
            if tag in BLOCKS:
                k = len(self.open) - 1
                while self.open[k][0] != tag:
                    k -= 1
                self._pop(k)
            else:
                self._end_before({tag}, None)
        frame = self.open[-1]
        self.page.tokens.append((tag, frame[1], frame[3]))

    def text(self, text: str) -> None:
        _, element, link, place, block = self.open[-1]
        self.page.tokens.append(Run(self.block, text, block, link, element, place))

    def done(self, soft: list[bool]) -> Page:
        noise = [0]
        for k, (parent, own, named, holds, holds_article) in enumerate(self.marked):
            if k:
                lifted = named and (holds or (holds_article and soft[k]))
                noise.append(max(noise[parent], 0 if lifted else own))
        self.page.noise = noise
        return self.page


def parse(html: str) -> Page:
    parser, at, soft = _Parser(), 0, [False]
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parser.text(html[at : m.start()])
        at = m.end()
        if m[3] is None or not m[5]:
            continue
        tag, before = m[3].lower(), len(parser.marked)
        if tag == "br":
            parser.text(" ")
        elif m[2]:
            parser.end(tag)
        else:
            parser.start(tag, m[4])
        if len(parser.marked) > before:
            soft.append(not _hard(m[4]))
    if at < len(html):
        parser.text(html[at:])
    page = parser.done(soft)
    # text of noise is never looked at again; that of the others is decoded and counted once
    for k, token in enumerate(page.tokens):
        if isinstance(token, Run):
            level = page.noise[token.noise]
            token.noise = int(level == 2 or (level == 1 and token.tag not in HEADINGS))
            if not token.noise:
                token.text = unescape(token.text) if "&" in token.text else token.text
                token.words = len(token.text.split())
        else:
            page.tokens[k] = (token[0], int(page.noise[token[1]] == 2), token[2])
    return page


def _hard(attributes: str) -> bool:
    return any(w.lower() in NOISE for kind, *v in _NAMED.findall(attributes) if kind.lower() in ("class", "id") for w in _PARTS.findall(v[0] or v[1] or v[2]))


def region_of(page: Page) -> int:
    """The least place that counts as inside: 2 if an article has words, else 1 if a main element has, else 0: the page names no region."""
    return max((t.place for t in page.tokens if isinstance(t, Run) and t.words), default=0)


def counted(page: Page, counts: Counter[tuple[str, str, int]]) -> None:
    """Adds a labelled page's words and tags, by feature and side (1 inside)."""
    least = region_of(page)
    if not least:
        return
    for token in page.tokens:
        if isinstance(token, Run):
            if token.words:
                side = int(token.place >= least)
                for name in (("block", token.tag), ("link", "yes" if token.link else "no"), ("place", "in" if side else "out")):
                    counts[*name, side] += token.words
        else:
            counts["tag", token[0] if token[0] in BLOCKS or token[0] in _KNOWN else "", int(token[2] >= least and not token[1])] += 1


#: Tags beside blocks that have rates of their own; others count as one.
_KNOWN = VOID | NOISE_TAGS | set("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())


class Weights:
    """Log-ratios of smoothed rates, from counts by (kind, name, side)."""

    def __init__(self, counts: dict[tuple[str, str, int], int]) -> None:
        self.counts = counts
        self.total = Counter()
        for (kind, _, side), n in counts.items():
            self.total[kind, side] += n
        self.word: dict[tuple[str, bool, int], float] = {}
        self.tag: dict[tuple[str, int], float] = {}

    def _ratio(self, kind: str, name: str) -> float:
        rate = [self.counts.get((kind, name, side), 0) / max(1, self.total[kind, side]) for side in (1, 0)]
        prior = PRIOR.get((kind, name), (0.5, 0.5))
        return math.log((rate[0] + SMOOTH * prior[0]) / (rate[1] + SMOOTH * prior[1]))

    def _place(self, inside: int) -> float:
        return 0.0 if inside < 0 else self._ratio("place", "in" if inside else "out")

    def of_word(self, tag: str, link: bool, inside: int) -> float:
        """inside: -1 where the page names no region."""
        key = (tag, link, inside)
        if key not in self.word:
            bound = lambda x: max(-KIND_MOST, min(KIND_MOST, x))
            sum_ = bound(bound(self._ratio("block", tag)) + bound(self._ratio("link", "yes" if link else "no"))) + 2 * bound(self._place(inside))
            self.word[key] = max(WORD_LEAST, min(WORD_MOST, sum_))
        return self.word[key]

    def of_tag(self, tag: str, inside: int) -> float:
        key = (tag, inside)
        if key not in self.tag:
            name = tag if tag in BLOCKS or tag in _KNOWN else ""
            self.tag[key] = -max(TAG_LEAST, min(TAG_MOST, -self._ratio("tag", name) - self._place(inside)))
        return self.tag[key]


def scored(page: Page, weights: Weights) -> list[float]:
    """The score of each token; a noise element costs its opening tag, whatever is in it."""
    least, out, quiet = region_of(page), [], 0
    for token in page.tokens:
        if isinstance(token, Run):
            quiet = token.noise
            out.append(0.0 if token.noise or not token.words else token.words * weights.of_word(token.tag, token.link, -1 if not least else int(token.place >= least)))
        else:
            inside = -1 if not least else int(token[2] >= least)
            out.append((0.0 if quiet else -NOISE_COST[inside]) if token[1] else weights.of_tag(token[0], inside))
            quiet = token[1]
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum, the first of equal ones; (0, 0) if no sum is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, where = total, (start, k + 1)
    return where


def extract(html: str | None, weights: Weights) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = parse(html)
    start, end = best_region(scored(page, weights))
    least = region_of(page)
    wanted = lambda t: isinstance(t, Run) and not t.noise and t.place >= least
    kept = {t.block for t in page.tokens[start:end] if wanted(t) and t.words}
    blocks: dict[int, list[str]] = {}
    for token in page.tokens:
        if isinstance(token, Run) and token.block in kept and wanted(token):
            blocks.setdefault(token.block, []).append(token.text)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


def learn(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages. The counts are a few hundred numbers, whatever the pages."""
    common.small_batches(pages.sparkSession)
    schema = common.shape("kind string, name string, side int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, int]] = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                if html:
                    counted(parse(html), counts)
        kinds, names, sides = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(sides, pa.int32()), pa.array(counts.values(), pa.int64())], schema=schema)

    found = pages.select(pages[html_col].alias("html")).mapInArrow(run, common.spark_type(schema)).groupBy("kind", "name", "side").agg(F.sum("n").alias("n"))
    return Weights({(r["kind"], r["name"], r["side"]): r["n"] for r in found.collect()})


def main_text(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row. weights: by default those of df's own labelled pages."""
    common.small_batches(pages.sparkSession)
    weights = learn(pages, html_col) if weights is None else weights
    schema = common.shape("page_id long, url string, text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html")).mapInArrow(run, common.spark_type(schema))
