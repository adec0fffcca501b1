"""Main text of pages whose parts are known, and the linear scan against all regions."""

import random
import re
from html import escape, unescape

import pytest

from sigmaloom.llm import extraction

PRIOR = extraction.Weights({})


def sentence(rng, n=None):
    words = "a of the Été straße kept & more <ok> one two three four word".split()
    return " ".join(rng.choice(words) for _ in range(n or rng.choice([1, 2, 8, 30])))


def page(rng, wrap):
    """(html, text) of a page with all kinds of noise around and inside of its article."""
    blocks = [("h1", sentence(rng, 5)), *((rng.choice(["p", "p", "p", "h2", "li", "blockquote"]), sentence(rng)) for _ in range(rng.randrange(2, 9))), ("p", sentence(rng))]
    noise = ['<nav><ul><li><a href="/x">Menu entry</a></li></ul></nav>', '<aside>Other news of the day</aside>', '<div class="ad">Buy this now please</div>', '<form><label>Mail</label><input name="m"><button>Send</button></form>', "<script>var t='</p>';</script>", '<div id="cookie-notice"><p>We use cookies a lot here</p></div>', "<!-- <p>hidden</p> -->", '<section class="comments"><h3>Comments</h3><article class="comment"><p>I say so too, and more than once</p></article></section>', '<div role="complementary"><p>side by side with all</p></div>', '<p class="related-links"><a href="/y">More on this</a></p>']
    inside = []
    for tag, text in blocks:
        shown = escape(text).replace(" ", rng.choice([" ", "\n ", " <b>", "<br>", "&nbsp;"]), 1)
        inside.append(f"<ul><li>{shown}</ul>" if tag == "li" else f"<{tag}>{shown}" + rng.choice([f"</{tag}>", f"</{tag}>\n"] + ([""] if tag == "p" else [])))
        if rng.random() < 0.3 and tag != "h1":
            inside.append(rng.choice(noise))
    html = f"<!DOCTYPE html><html><head><title>{escape(sentence(rng))}</title><style>p{{margin:0}}</style></head><body class=\"has-sidebar comments-open\"><header><h1>Site</h1><p>Slogan of the site</p></header>{noise[0]}{noise[2]}"
    html += wrap.format("".join(inside)) + rng.choice(noise) + noise[1] + '<footer><p>&copy; All of it is ours and no one else can have it</p></footer>' + rng.choice(["</body></html>", "", "<p"])
    return html, "\n\n".join(" ".join(t.split()) for _, t in blocks)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="layout sidebar-left"><article class="post">{}</article></div>', '<main><div class="page-header"></div><article>{}</article></main>'])
def test_named_regions(wrap):
    rng = random.Random(1)
    for _ in range(300):
        html, text = page(rng, wrap)
        assert extraction.extract(html, PRIOR) == text


def test_regions_without_a_name():
    """The scan alone finds the region: words of paragraphs against tags, links and marked noise."""
    rng = random.Random(2)
    good = 0
    for _ in range(200):
        html, text = page(rng, '<div id="c">{}</div>')
        good += extraction.extract(html, PRIOR) == text
    assert good >= 190
    links = "".join(f'<div><a href="/{i}">Go there</a></div>' for i in range(40))
    html = f"<body>{links}<div><p>This is what the page is about, in so many words.</p><p>And more.</p></div>{links}</body>"
    assert extraction.extract(html, PRIOR) == "This is what the page is about, in so many words.\n\nAnd more."


def test_scan_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(0, 25))]
        start, end = extraction.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:end]) == max(best, 0)


def test_markup():
    say = lambda x: extraction.extract(x, PRIOR)
    assert say("<article><p>a&amp;b &lt;i&gt; caf&eacute; &#8212; x</p></article>") == "a&b <i> café — x"
    assert say("<article><p>one<p>two<div>three</div>four</article>five") == "one\n\ntwo\n\nthree\n\nfour"
    assert say("<article><header><h1>Title</h1><p>by someone</p></header><p>Of.</p><footer>end</footer></article>") == "Title\n\nOf."
    assert say('<article><p>in<b>li</b>ne <a href="x>y">link</a> text</p></article>') == "inline link text"
    assert say("<article><p title=it's>kept</p><p>1 < 2 and 3 > 2</p></article>") == "kept\n\n1 < 2 and 3 > 2"
    assert say("<article><p>kept</p><p>cut <a hre") == "kept\n\ncut"
    assert say("<article><p>kept</p><script>if (a < b) x('<p>no</p>')") == "kept"
    assert say("<article><p>long enough to be read</p><div class=ad>no</div><p>Of.</p></article>") == "long enough to be read\n\nOf."
    assert [say(x) for x in (None, "", " ", "<nav>x</nav>", "<p", "<!-- x", "<article></article>")] == [""] * 7
    assert say("no markup at all") == "no markup at all"


@pytest.mark.parametrize("text", ["<" * 200_000, "<a " * 100_000, '<a b="' * 100_000, "<div>" * 100_000 + "x", "<p><b>" * 50_000 + "</i>" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "x " * 500_000, "<ul><li>" * 30_000 + "</div>" * 30_000, "&amp" * 200_000])
def test_hostile_pages_take_linear_time(text):
    extraction.extract(text, PRIOR)


def test_pages_of_a_table(spark):
    """Weights are learnt over all pages; every row has its text, whatever its other columns are called."""
    rng = random.Random(4)
    pages = [(i, f"u{i}", *page(rng, "<article>{}</article>")) for i in range(60)]
    pages += [(100, None, None, ""), (None, "x", "", ""), (7, "u7", pages[7][2], pages[7][3]), (101, "y", "<article><p>" + "word " * 200_000 + "</p></article>", ("word " * 200_000).strip())]
    df = spark.createDataFrame([(i, u, h, "t", 9) for i, u, h, _ in pages], "page_id long, url string, html string, text string, n_chars long").repartition(3)
    want = sorted(((i, u, t, len(t)) for i, u, _, t in pages), key=repr)
    assert sorted((tuple(r) for r in extraction.main_text(df).collect()), key=repr) == want
    assert extraction.main_text(df.limit(0)).count() == 0
    weights = extraction.learn(df)
    assert weights.of_word("p", False, -1) > 0 > weights.of_tag("nav", -1) and weights.of_tag("nav", -1) < weights.of_tag("p", -1)


def test_equals_what_the_article_holds():
    """On pages like those of the tables: all text between the article's tags, by blocks."""
    rng = random.Random(5)
    for _ in range(50):
        paragraphs = [sentence(rng) for _ in range(6)]
        body = "".join(rng.choice([f"<p>{escape(p)}</p>", f"<p><b>{escape(p)}<br>"]) for p in paragraphs)
        html = f'<!DOCTYPE html><html lang="en"><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/Y">Y</a></li></ul></nav><!-- ad 3 --><div class="ad">Ad it is</div><article><h1>Head</h1>{body}</article><footer>&copy; x &middot; y z</footer>'
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert extraction.extract(html, PRIOR) == "\n\n".join(x for x in want if x)
