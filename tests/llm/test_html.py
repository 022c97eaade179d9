import random
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest

from glossaflow.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";x("<p>no</p>")</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div class="ad">Buy our fine things today.</div><!-- <p>hidden</p> -->
<article><h1>The title of it</h1><p><b>First &amp; fore&shy;most,   this is <i>text</i> of the article,
with enough words to be read.<br>And more of it.<p>Second &lt;p&gt; paragraph &#169; with a <a href="x>y">link</a> inside, and again enough words.</p>
<div class="ad">Sponsored: buy.</div><p>A third paragraph that closes the matter, as such paragraphs do.</p></article>
<div class="comments"><h3>Comments</h3><div class="comment">I like it.</div></div>
<form><label>Search</label><button>Go</button></form><footer>&copy; site &middot; all rights</footer></body></html>"""


def test_blocks():
    texts = [b.text for b in html.blocks(PAGE)]
    assert "hidden" not in " ".join(texts) and "No" not in texts and not any("var t" in t for t in texts)
    assert "First & fore­most, this is text of the article, with enough words to be read. And more of it." in texts
    assert "Second <p> paragraph © with a link inside, and again enough words." in texts
    assert html.blocks(None) == [] and html.blocks("") == []
    for cut in range(0, len(PAGE), 7):
        html.blocks(PAGE[:cut])
    long = "<p class='" + "<" * 200_000
    assert html.blocks(long + "x") == html.blocks(long + "x")


class Plain(HTMLParser):
    """A plain reading of well-formed pages: text between block-level tags, nothing from raw elements."""

    INLINE = {"b", "i", "a", "em", "span", "br", "img", "input", "wbr", "meta"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.raw = [], [], 0

    def flush(self):
        if text := " ".join("".join(self.held).split()):
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "textarea"):
            self.raw += 1
        elif tag in ("br", "img", "input"):
            self.held.append(" ")
        elif tag not in self.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "textarea"):
            self.raw -= 1
        elif tag not in self.INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.raw:
            self.held.append(data)


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    p.flush()
    return p.out


def test_blocks_match_a_plain_parser():
    import pyarrow.parquet as pq

    r = random.Random(31)
    pages = [html.generated(r)[0] for _ in range(150)] + pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    for page in pages:
        assert [b.text for b in html.blocks(page)] == plain(page)


def test_paths():
    """The marks of a block are those of the elements around it."""
    page = '<div class="One two"><p id=three>a<p>b</div><ul><li>c<li><div>d</div></ul><form>e'
    bit = lambda t, last=False: 1 << html._TAG_NO[t] + last * len(html._TAGS)
    word = lambda w, near=False: 1 << html._AT_NAMES + html._HASH_NAMES * near + html._slot(w, html._HASH_NAMES)
    around = word("one") | word("two")
    near = word("one", True) | word("two", True)
    assert [(b.text, b.marks) for b in html.blocks(page)] == [
        ("a", bit("div") | bit("p") | bit("p", True) | around | word("three") | word("three", True)),
        ("b", bit("div") | bit("p") | bit("p", True) | around | near),
        ("c", bit("ul") | bit("li") | bit("li", True)),
        ("d", bit("ul") | bit("li") | bit("div") | bit("div", True)),
        ("e", bit("form") | bit("form", True)),
    ]


@pytest.mark.parametrize("page", ["<div class='c%d'>" * 1, "</div>x", "<li>x", "<p>x"])
def test_deep_and_long_pages(page):
    """A hundred thousand nested or lone elements: time and memory stay in proportion."""
    n = 100_000
    source = "".join(page.replace("%d", str(i)) for i in range(n)) + "end" if "%d" in page else "<div>" * n + page * n
    tracemalloc.start()
    found = html.blocks(source)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) in (1, n) and peak < 400e6
    if len(found) > 1:
        some = found[:20_000]
        tracemalloc.start()
        whole = html.model().label([some], cells=1 << 12)[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6 and np.allclose(whole, html.model().label([some])[0], atol=1e-4)


ARTICLE = "<article><h1>Short news</h1><p>A short article with one paragraph, that says little but says it well.</p><p>And one more of the kind.</p></article>"
GOLD = ["Short news", "A short article with one paragraph, that says little but says it well.", "And one more of the kind."]
SIDE = "<aside><h3>Related</h3>" + "".join(f"<p>Related story number {i}: the mayor of the town spoke at length about plans for a new harbour and its costs.</p>" for i in range(6)) + "</aside>"
FORM = "<form action=x>" + "".join(f"<p>Please tell us about question {i}, and be as complete as you can in your answer to us.</p>" for i in range(5)) + "<button>Send</button></form>"


@pytest.mark.parametrize(
    "page, gold",
    [
        (f"<html><body>{ARTICLE}{SIDE}</body></html>", GOLD),
        (f"<html><body>{SIDE}{ARTICLE}</body></html>", GOLD),
        (f"<html><body>{ARTICLE}{FORM}</body></html>", GOLD),
        (f"<html><body><form id=aspnet>{ARTICLE}</form></body></html>", GOLD),
        (
            "<body><article><h1>T is here</h1><p>Some words of an article that goes on a while.</p><p>1<br>2</p><p>More words of it follow here, as they do.</p><p>1234 5678</p></article><footer>c 2020</footer></body>",
            ["T is here", "Some words of an article that goes on a while.", "1 2", "More words of it follow here, as they do.", "1234 5678"],
        ),
        (
            "<body><article><h1>T is here</h1><p>Some words of an article that goes on a while.</p><form><p>Enter your email to get our letter.</p><button>Go</button></form><p>More words of it follow here, as they do.</p></article></body>",
            ["T is here", "Some words of an article that goes on a while.", "More words of it follow here, as they do."],
        ),
        ("<article><p>one two three words of it</p><!--><p>two is here as well, with words</p><p>three is the last of these</p></article>", ["one two three words of it", "two is here as well, with words", "three is the last of these"]),
        ("<article><p>one two three words of it</p><!-- a --!><p>two is here as well, with words</p><p>three is the last of these</p></article>", ["one two three words of it", "two is here as well, with words", "three is the last of these"]),
    ],
)
def test_hand_written_pages(page, gold):
    """Sidebars that outweigh the article, page-wide forms, forms amid it, figures, odd comments."""
    assert html.main_texts([page], html.model()) == [gold]


def test_main_text():
    (got,) = html.main_texts([PAGE], html.model())
    assert got == [
        "The title of it",
        "First & fore­most, this is text of the article, with enough words to be read. And more of it.",
        "Second <p> paragraph © with a link inside, and again enough words.",
        "A third paragraph that closes the matter, as such paragraphs do.",
    ]


def test_held_out_accuracy():
    r = random.Random(2024)
    made = [html.generated(r) for _ in range(150)]
    found = html.main_texts([p for p, _ in made], html.model())
    right = sum(len(set(g) & set(f)) for (_, g), f in zip(made, found))
    assert right / sum(len(set(f)) for f in found) > 0.95
    assert right / sum(len(set(g)) for _, g in made) > 0.95


def test_gradients():
    rng = np.random.default_rng(1)
    m = html.Labeller(hidden=3, seed=2)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    pages = [(rng.normal(size=(n, html.WIDTH)) * 0.1, rng.integers(0, 2, n).astype(float)) for n in (4, 2)]
    x, mask, y = html.padded(pages)

    def loss():
        s = m._scores(m._run(x, mask, "f", False)[0], m._run(x, mask, "b", False)[0])
        p = m._sigmoid(s)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grad = m.step(x, y, mask)
    for k in ("hf", "hb", "cf", "cb", "o", "xf"):
        at = tuple(rng.integers(0, n) for n in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-2
        up = loss()
        m.p[k][at] = old - 1e-2
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-3


def test_extract(spark):
    df = spark.createDataFrame([(1, PAGE, "t"), (1, PAGE, "t"), (2, None, "t"), (None, "", None), (4, "<p>" + "long words, many of them. " * 40_000, "t")], "page_id long, html string, text string")
    out = html.extract(df)
    assert out.columns == [*df.columns, "_text"]
    rows = out.collect()
    assert len(rows) == 5
    assert [r["_text"] for r in rows if r["html"] in (None, "")] == ["", ""]
    assert len({r["_text"] for r in rows if r["page_id"] == 1}) == 1
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_broken_pages_keep_their_article():
    want = html.main_texts([PAGE], html.model())[0]
    page = PAGE.replace("as such paragraphs do", "as such paragraphs do, " + "and go on for a while, with words and more words, " * 12 + "to the end")
    for tag in ("noscript", "object", "svg", "math", "template", "iframe", "xmp"):
        (got,) = html.main_texts([PAGE.replace("<article>", f"<{tag}><article>")], html.model())
        assert got == want, tag
    for tag in ("math", "object"):
        (got,) = html.main_texts([PAGE.replace("<i>text</i>", f"<{tag}>text</{tag}>")], html.model())
        assert got == want, tag
    (want,) = html.main_texts([page], html.model())
    assert len(want) == 4
    formula = PAGE.replace("<i>text</i>", "<math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><text>y</text></svg>")
    assert "this is x=2 and y of the article" in html.main_texts([formula], html.model())[0][1]
    for tag in ("form", "aside", "nav"):
        (got,) = html.main_texts([page.replace("<article>", f"<{tag}><article>")], html.model())
        assert set(want) <= set(got), tag
    (got,) = html.main_texts([page.replace("<body>", "<body><form>").replace("</body>", "</form></body>")], html.model())
    assert set(want) <= set(got)
    (got,) = html.main_texts([page.replace("</head>", "")], html.model())
    assert set(want) <= set(got)
    # what HTML itself carries to the end of the page
    assert html.blocks("<p>a<script>x<p>b")[0].text == "a" and len(html.blocks("<p>a<script>x<p>b")) == 1
