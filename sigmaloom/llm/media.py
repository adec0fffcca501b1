"""Media columns as interleaved document sequences.

A page becomes an ordered sequence of items {position, kind, text, digest, caption}: text items and
references to media, in the order in which the HTML has them. Payloads lie in a media table keyed by the
SHA-256 of their content; a reference names that digest, and a join on it resolves the payload. Positions
and captions stay with their item through the join.

Payloads are stored as 8-bit greyscale PNG images, 64 samples wide: lossless, one sample for each byte.

Edge cases: null and empty HTML give an empty sequence; unclosed, wrongly nested and unknown tags are
tolerated, and the content of script, style and comments is no text; a reference without a known digest stays, with
null payload columns; a payload that many references name is resolved once for each of them; payloads
of equal content have equal digests and stored bytes, and are stored and decoded once for each row that brings them; null payloads count as empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 64
ITEM = "position int, kind string, text string, digest string, caption string"
#: How a reference names a digest.
SCHEME = "media:sha256,"
_PNG = b"\x89PNG\r\n\x1a\n"
_SILENT = {"script", "style", "template", "noscript"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "figure", "blockquote", "pre", "header", "footer", "nav", "title"}
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media"}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """The payload, of a positive multiple of 64 bytes, as the samples of a greyscale PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png wrote; raises ValueError if it is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter is used")
    return lines[:, 1:].tobytes()


def padded(content: bytes) -> bytes:
    """The content and bytes 0 up to a positive multiple of 64."""
    return content + bytes(-len(content) % WIDTH or (0 if content else WIDTH))


def features(payload: bytes) -> str:
    """A short text of what the samples look like: rows, mean, standard deviation, entropy of the 16 levels, mean step."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x >> 4, minlength=16) / len(x)
    entropy = -sum(float(p) * float(np.log2(p)) for p in share if p)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"rows={len(x) // WIDTH};mean={x.mean():.3f};sd={x.std():.3f};entropy={entropy:.3f};step={step:.3f}"


#: Ends of these close a caption that was left open.
_HOLDERS = {"figure", "div", "section", "article", "main", "body", "html", "td", "li"}


class _Items(HTMLParser):
    def __init__(self, silent_tags: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.silent_tags = silent_tags
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.silent = 0
        self.figure: list[int] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self._add("text", text=text)
        self.text = []

    def _add(self, kind: str, text: str | None = None, digest: str | None = None, caption: str | None = None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def end_caption(self, whole: bool) -> None:
        """Closes the caption: it belongs to the figure's media if it was closed as one, or is text like other."""
        if self.caption is None:
            return
        said, self.caption = " ".join("".join(self.caption).split()), None
        if whole and len(self.figure) > 1:
            for i in self.figure[1:]:
                self.items[i]["caption"] = said or self.items[i]["caption"]
        elif said and not whole:
            self._add("text", text=said)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.silent_tags:
            self.silent += 1
        elif self.silent:
            return
        elif tag in _MEDIA:
            src = dict(attrs).get("src") or ""
            if tag in ("audio", "video") and not src:
                return
            self._flush()
            self._add(_MEDIA[tag], digest=src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, text=None if src.startswith(SCHEME) else src or None, caption=dict(attrs).get("alt") or None)
            if self.figure:
                self.figure.append(len(self.items) - 1)
        elif tag == "figcaption":
            self._flush()
            self.end_caption(whole=False)
            self.caption = []
        elif tag in _BLOCK:
            self._flush()
            if self.caption is not None:
                self.caption.append(" ")
            if tag == "figure":
                self.end_caption(whole=False)
                self.figure = [-1]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent_tags:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "figcaption":
            self.end_caption(whole=True)
        elif tag in _BLOCK | _HOLDERS:
            self._flush()
            if tag in _HOLDERS and self.caption is not None:
                self.end_caption(whole=tag == "figure")
            if tag == "figure":
                self.figure = []

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page, in order. A template or noscript that is opened more often than closed hides nothing; a caption that is left open
    ends with what holds it, or with the page, and is text unless its figure ends there."""
    html = html or ""
    open_ = {t for t in ("template", "noscript") if len(re.findall(rf"(?i)<{t}[\s/>]", html)) > len(re.findall(rf"(?i)</{t}[\s/>]", html))}
    parser = _Items(_SILENT - open_)
    parser.feed(html)
    parser.close()
    parser._flush()
    parser.end_caption(whole=False)
    return parser.items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each item of each page: page_id, position, kind, text, digest, caption."""
    common.small_batches(pages.sparkSession)
    schema = common.shape("page_id long, position int, kind string, text string, digest string, caption string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for item in parse(html):
                    out["page_id"].append(page_id)
                    for k, v in item.items():
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].alias("html")).mapInArrow(run, common.spark_type(schema))


def media_column(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, n_bytes, digest (of the padded content) and media (its stored form) of each row's whole content, text as UTF-8."""
    common.small_batches(df.sparkSession)
    schema = common.shape("id long, n_bytes long, digest string, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            contents = [x.encode() if isinstance(x, str) else x or b"" for x in batch.column(1).to_pylist()]
            payloads = [padded(x) for x in contents]
            digests = [hashlib.sha256(x).hexdigest() for x in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, contents), pa.int64()), pa.array(digests, pa.string()), pa.array(map(to_png, payloads), pa.binary())], schema=schema)

    return df.select(df[id_col].cast("long").alias("id"), df[content_col].alias("content")).mapInArrow(run, common.spark_type(schema))


def described(media: DataFrame) -> DataFrame:
    """Reads stored media back: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    Damaged media raise an error; null media have null columns."""
    schema = common.shape("digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stored is None:
                    out.append((digest, *[None] * 6))
                    continue
                payload = from_png(stored)
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return media.select("digest", "media").mapInArrow(run, common.spark_type(schema))


def resolve(items: DataFrame, media: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Items with the columns of `media`, one row for each digest, that their reference names.

    Every item stays, once. The media side is reduced to a row for each digest before the join, with partial
    aggregation, so a payload that a third of all references name is no hot key on that side; the items' side can be
    split by the adaptive skew join."""
    columns = columns or [c for c in media.columns if c != "digest"]
    one = media.groupBy(F.col("digest").alias("_digest")).agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns))
    return items.join(one.hint("merge"), F.col("digest") == F.col("_digest"), "left").drop("_digest")


def page_of(digest: F.Column, caption: F.Column) -> F.Column:
    """HTML of a page that shows one stored payload."""
    return F.concat(F.lit(f'<article><figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def page_html(parts: list[tuple[str, str, str]]) -> str:
    """HTML of (kind, text or digest, caption) parts; the inverse of parse for text and image parts."""
    show = lambda k, x, c: f"<p>{escape(x)}</p>" if k == "text" else f'<figure><img src="{SCHEME}{escape(x)}"><figcaption>{escape(c)}</figcaption></figure>'
    return "<article>" + "".join(show(*p) for p in parts) + "</article>"


def document_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as media, shows it on a page of its own, parses the page, and resolves its reference by digest.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption;
    a row for each input row. The stored media are written to the shared folder once and read back from there."""
    stored = common.staged(media_column(df, id_col, text_col), "media")
    pages = stored.select(F.col("id").alias("page_id"), page_of(F.col("digest"), F.concat(F.lit("n_bytes="), F.col("n_bytes"))).alias("html"))
    items = sequences(pages).where(F.col("kind") == "image").withColumn("n_bytes", F.regexp_extract("caption", r"n_bytes=(\d+)", 1).cast("long"))
    found = resolve(items, described(stored))
    return found.select(F.col("page_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
