r"""URL filters with redirect equivalence.

A rule (host, path) fits its host and all subdomains, if the URL's path starts with the rule's; of the rules that fit a
URL the longest decides, and of two equally long ones the allow rule. URLs without a rule take the verdict of the URLs
that they are equivalent to: pages that redirect to each other (meta refresh) or name each other as canonical
form a component, found by distributed star rounds over these links. A component with a URL that a rule blocks is
blocked, whether that URL is a row or only the end of a link; a page that a rule allows stays allowed in it. What no component
decides is allowed.

The node of a URL is its host, path and query: scheme and fragment tell no pages apart. Links are taken relative to the
page's URL, from its folder, with . and .. resolved; rel may hold other words beside canonical. Character references in links are
resolved as HTML resolves them in attributes. Redirects that a crawler saw can be given as a table.

SQL below knows neither blocked URLs that are no rows nor character references nor .. nor inert elements other than scripts; without such links the rows are the same.

Edge cases: a null URL, or one without "://", has an empty host and path, no rule and no node, and is allowed; null HTML
has no links; a link to itself is none; repeated rows and page_ids give a row each; other columns are not read;
an empty table gives an empty table. DataFrame operations only, but for the resolution of links.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Sequence
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

Rule = tuple[str, str, str]  # verdict, host, path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def split_node(node: Column) -> tuple[Column, Column]:
    """Host and path of a node: hosts have no / and ?, paths have no ? and begin with / or are empty."""
    return F.regexp_extract(node, r"(?s)^([^/?]*)", 1), F.regexp_extract(node, r"(?s)^[^/?]*([^?]*)", 1)


# A name without a semicolon is none in an attribute if = or a letter or digit follows, as in ?a=1&copy=2.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|([A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9]))))")


def unescaped(text: str) -> str:
    """An attribute's text with its character references resolved."""
    return _REFERENCE.sub(lambda m: html5.get(m[1], m[0]) if m[1] else _html.unescape(m[0]), text)


def joined(url: Column, link: Column) -> Column:
    """The absolute URL of a page's link, or null if it has none."""

    def one(base: str, to: str) -> str | None:
        try:
            return to if "://" in to.split("?")[0] else urljoin("http://" + base.split("://", 1)[1], to)
        except ValueError:  # not a URL
            return None

    @F.arrow_udf("string")
    def run(urls: pa.Array, links: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else one(a, b) for a, b in zip(urls.to_pylist(), links.to_pylist(), strict=True)], pa.string())

    return run(url, link)


def resolved(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([t if t is None or "&" not in t else unescaped(t) for t in x.to_pylist()], pa.string())

    return run(text)


def decide(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the rule that decides, or null. rules is a list in the program, so the expression is as long as
    that list; see decide_by_join for rules that are a table."""
    found = [
        F.when((F.concat(F.lit("."), host).endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    if not found:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    best = found[0] if len(found) == 1 else F.greatest(*found)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def decide_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (key, host, path) with rule and verdict from a table of rules (verdict, host, path) of any length. A URL meets the
    rules of its host's suffixes, one row for each label, by an equi-join; hosts are pre-aggregated, so a hot host meets its rules
    once for each of its paths."""
    pages = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = pages.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    r = rules.select(F.col("verdict").alias("v"), F.col("host").alias("h"), F.col("path").alias("p"))
    met = suffixes.join(r, suffixes["suffix"] == r["h"]).where(F.col("path").startswith(F.col("p")))
    best = F.max(F.struct((F.length("h") + F.length("p")).alias("length"), (F.col("v") == "allow").alias("allow"), F.concat("h", "p").alias("rule"), F.col("v").alias("verdict")))
    decided = met.groupBy("host", "path").agg(best.alias("best")).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best.rule", "best.verdict")
    return urls.join(decided, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


#: What holds no tags of the page: comments, and elements whose content is text or inert. One that is left open goes to the end.
_NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|xmp|iframe)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """u, v: nodes of pages and of the URLs that their HTML redirects to or names as canonical. Tags in comments, scripts and the like are none."""
    html, url = F.col(html_col), F.col(url_col)
    shown = F.regexp_replace(html, _NO_TAGS, " ")
    tags = F.filter(F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\brel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)") | t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    is_link = F.col("tag").rlike("(?i)^<link")
    # a link's href is cut out and then resolved; a refresh's URL is a part of its attribute's resolved text
    cut = F.when(is_link, F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).otherwise(F.col("tag"))
    target = F.when(F.col("link"), F.col("text")).otherwise(F.regexp_extract("text", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    some = pages.where(html.rlike("(?i)canonical|refresh") & url.contains("://")).select(url.alias("url"), F.explode(tags).alias("tag")).select("url", is_link.alias("link"), cut.alias("cut"))
    some = some.select("url", "link", resolved(F.col("cut")).alias("text")).select("url", F.trim(target).alias("to")).where("to <> ''")
    return some.select(node_of(F.col("url")).alias("u"), node_of(joined(F.col("url"), F.col("to"))).alias("v")).where("u <> v")


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row. redirects: from_url, to_url of further links, both absolute."""
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = urls.withColumn("own", decide(F.col("host"), F.col("path"), rules))
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")).where("u <> v"))
    parts = common.staged(components(links).withColumnRenamed("node", "_node"), "aliases")
    # a component is blocked if any node of it is, a row or not; a node without a link has its own rule or none
    spread = parts.where(decide(*split_node(F.col("_node")), rules)["verdict"] == "block").select(F.col("component").alias("_component")).distinct()
    aliases = parts.join(spread, parts["component"] == spread["_component"], "left_semi").select("_node")
    open_ = judged.where("own is null")
    caught = open_.join(aliases, open_["node"] == aliases["_node"], "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("_node").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return judged.where("own is not null").select("page_id", "host", "path", "own.rule", "own.verdict").union(caught)


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)?', 1) AS query FROM pages),
n AS (SELECT *, CASE WHEN contains(url, '://') THEN host || path || query END AS node FROM p),
rules(v, h, x) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
own AS (SELECT page_id, url, node, arg_max(h || x, length(h || x)) AS rule, arg_max(v, length(h || x)) AS verdict FROM n JOIN rules ON ends_with('.' || host, '.' || h) AND starts_with(path, x) GROUP BY ALL),
tags AS (SELECT url, host, path, node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM n WHERE node IS NOT NULL),
targets AS (SELECT host, path, node, trim(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END) AS t
  FROM tags WHERE regexp_matches(tag, '(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)|\bhttp-equiv\s*=\s*["'']?refresh\b')),
fulls AS (SELECT node, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t ELSE 'http://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || t END AS f FROM targets WHERE t <> ''),
links AS (SELECT node AS a, translate(regexp_extract(f, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(f, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(f, '(?s)^.*?://[^?#]*(\?[^#]*)?', 1) AS b FROM fulls),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
bad AS (SELECT DISTINCT node FROM own WHERE verdict = 'block' AND node IS NOT NULL UNION SELECT b FROM bad JOIN both_ways ON bad.node = a)
SELECT n.page_id, n.host, n.path, own.rule, coalesce(own.verdict, CASE WHEN bad.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM n LEFT JOIN (SELECT DISTINCT url, rule, verdict FROM own) own ON n.url = own.url LEFT JOIN bad ON n.node = bad.node
"""
