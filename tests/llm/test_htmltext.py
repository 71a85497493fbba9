import math
import random
import re
from functools import lru_cache
from itertools import product

import pytest

from prefmill.llm import htmltext
from prefmill.llm.labelled_pages import labelled_pages


@lru_cache
def model():
    return htmltext.train()


def text_of(html):
    return htmltext.main_text(html, model())


def marked(html):
    """The text under marks, without the model."""
    page = htmltext.Page(html)
    return page.text([1.0 if x else 0.0 for x in page.label])


@pytest.mark.parametrize("seed", range(5))
def test_marginals_equal_sums_over_all_labels(seed):
    r = random.Random(seed)
    n = 9
    parent = [-1] + [r.randrange(i) for i in range(1, n)]
    potential = [r.gauss(0, 2) for _ in range(n)]
    pairs = ((r.gauss(0, 1), r.gauss(0, 1)), (r.gauss(0, 1), r.gauss(0, 1)))
    total, share = 0.0, [0.0] * n
    for y in product((0, 1), repeat=n):
        weight = math.exp(sum(u * s for u, s in zip(potential, y, strict=True)) + sum(pairs[y[parent[i]]][y[i]] for i in range(1, n)))
        total += weight
        share = [a + weight * s for a, s in zip(share, y, strict=True)]
    assert htmltext.marginals(parent, potential, pairs) == pytest.approx([s / total for s in share])


def test_wide_and_deep_trees_stay_finite():
    wide = htmltext.marginals([-1] + [0] * 5000, [0.5] * 5001, ((0.5, -3.0), (-0.2, 2.0)))
    deep = htmltext.marginals(list(range(-1, 5000)), [0.1] * 5001, ((0.5, -3.0), (-0.2, 2.0)))
    assert all(0 <= p <= 1 for p in wide + deep)


def test_held_out_pages():
    pages = labelled_pages(150, seed=77)
    plain = [re.sub(r' data-y="[01]"', "", p) for p in pages]
    exact = sum(text_of(a) == marked(b) for a, b in zip(plain, pages, strict=True))
    assert exact >= 0.9 * len(pages)


BODY = "<article><h1>Tha Title</h1><p>First paragraph of the piece, with <b>bold</b>ness &amp; more.</p><p>Second one, which\n goes  on for some time.<br>And ends here.</p></article>"
MAIN = "Tha Title First paragraph of the piece, with boldness & more. Second one, which goes on for some time. And ends here."


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>{}",
        "<header><a href='/'>The Site</a><p>News for everybody, every day.</p></header>{}<footer>&copy; 2020 The Site. All rights reserved.</footer>",
        "{}<aside class='sidebar'><h3>Most read</h3><p>Another story that is popular right now.</p></aside>",
        "<div class='cookie-banner'><p>We use cookies to make this site better.</p><button>OK</button></div>{}",
        "{}<div class='ad'>Buy this thing now, it is cheap.</div>",
        "<form action='/s' class='search'><label>Search</label><input name=q><p>Find what you want.</p></form>{}",
        "{}<script>var a = '<p>not text</p>';</script><style>p{{}}</style><!-- <p>nor this</p> -->",
        "{}<section class='comments'><h2>3 comments</h2><div class='comment'><p>I do not agree with this piece.</p></div><div class='comment'>Well said, this is true.</div></section>",
        "<div hidden><p>This is not shown to anyone at all.</p></div>{}<div style='display:none'>Nor is this, whatever it says.</div>",
        "<template><p>hidden away</p></template><noscript><p>turn it on</p></noscript>{}",
    ],
)
def test_what_stands_around_the_article_goes(around):
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + around.replace("{{}}", "{}").replace("{}", BODY, 1) + "</body></html>"
    assert text_of(page) == MAIN


def test_markup():
    page = htmltext.Page("<p>a<p>b<b>c</b><i>d<table><tr><td>1<td>2<tr><td>3</table></p>x &lt;y&gt; &eacute;&#233; <5 a<br/>b <a title='>'>l</a>")
    joined = page.text([1.0] * len(page.parent))
    assert joined == "a bcd 1 2 3 x <y> éé <5 a b l"
    assert htmltext.Page("<div>a</span></p>b<script>c</div>").text([1.0] * 9) == "a b"
    assert htmltext.Page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>").text([1.0] * 9) == "a b c d"
    assert htmltext.Page("<!-- open <p>a").text([1.0] * 9) == ""
    assert htmltext.Page("<p title=don't>it's <a href=\"x>y\" t='>'>one</a> don't <b c=\"open>two</b></p>").text([1.0] * 9) == "it's one don't two"
    long = "<div " + "a" * 200_000 + "\"" * 3
    assert htmltext.Page(long).pieces


def test_rows(spark):
    rows = [(1, "u", BODY, 1), (1, "u", BODY, 1), (2, None, None, 2), (3, "v", "", 3), (None, "w", "<p></p>", 4), (4, "x", "plain words only, in one line.", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmltext.extract(pages, model())
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in got.collect())
    assert found[:1] == [(0, "", 0)] and found[1] == found[2] == (1, MAIN, len(MAIN)) and found[3:5] == [(2, "", 0), (3, "", 0)]
    assert htmltext.extract(pages.limit(0), model()).count() == 0
    many = "<article>" + "<p>One more paragraph of a long piece of text.</p>" * 20_000 + "</article>"
    assert text_of(many).count("paragraph") == 20_000
