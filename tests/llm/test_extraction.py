import random

import pytest
from pyspark.sql import functions as F

from drayage.llm import extraction, queries
from drayage.llm.boosting import BoostedTrees
from drayage.llm.dom import Page
from tests.conftest import DATA


def article_blocks(source):
    """The blocks inside <article> by the DOM alone, for pages of the given layout."""
    page = Page(source)
    inside = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        inside[i] = inside[page.parents[i]] or page.tags[i] == "article"
    return "\n".join(t for node, t in page.blocks if inside[node])


def test_blocks_of_broken_html():
    def blocks(source):
        return [t for _, t in Page(source).blocks]

    assert blocks("<p>a <b>b<br>c<p>d</b> e</div>f") == ["a b c", "d ef"]
    assert blocks("<!-- x <p>no</p> --><script>var a='</p>'</script><p>A&amp;B &copy;&nbsp; &#x41;\n\t z</p>") == ["A&B © A z"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("x<div title='>'>y</div>z<p") == ["x", "y", "z"]
    assert blocks("a < b and c > d") == ["a < b and c > d"]
    assert blocks("<head><title>t</title><body>u") == ["u"]
    assert blocks("<style>p{}") == [] and blocks("") == [] and blocks("<!-- open") == []
    assert blocks("<form>q<select><option>1</select></form>w") == ["q", "w"]


def test_no_element_swallows_the_page():
    def blocks(source):
        return [t for _, t in Page(source).blocks]

    assert blocks("<html><head><title>t</title><article><p>text") == ["text"]
    assert blocks("<head><title>t</title><meta name=a><p>a<header>b</header>c") == ["a", "b", "c"]
    assert blocks("<head><style>x</style></head><body>u") == ["u"] and blocks("<head>") == []
    for name in ("button", "iframe", "object", "video", "audio", "svg", "math", "canvas", "noscript", "textarea", "template"):
        assert " ".join(blocks(f"<p>a</p><{name}><p>b</p>c<{name}>d")).split() == ["a", "b", "c", "d"], name
    assert blocks("<title>t<p>a") == ["a"] and blocks("<select><option>1<option>2<p>a</p>b") == ["a", "b"]
    assert blocks("<select><option>1") == [] and blocks("<script>a<p>b") == []
    assert blocks("<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><object><p>c</p></object></article>") == ["a x = 2 b", "c"]
    assert blocks("<p>a <svg><g><path d=x /><title>t</title><text>u</text></g></svg> b</p>c") == ["a u b", "c"]
    assert blocks("<svg><g><p>a</p></g></svg><div>b</div>") == ["a", "b"]
    page = Page("<article><p>a <math><mi>x</mi></math> b</p></article>")
    assert page.tags == ["#page", "article", "p"]
    assert Page("<div>" + "<button>x" * 20_000 + "<p>a</p></div>").blocks[-1][1] == "a"


def test_trees_learn_an_interaction():
    import numpy as np

    draw = np.random.default_rng(0)
    x = draw.random((2000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 2] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.93


def test_decoding_keeps_nothing_inside_what_it_cuts():
    page = Page("<div><section><p>a</p><div><p>b</p></div></section><p>c</p></div>")
    kept = extraction._decode(page, __import__("numpy").array([-6, -6, 6, 6, -6, 0.1, -6.0]))
    assert [t for node, t in page.blocks if kept[node]] == ["a"]


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_given_pages_and_held_out_layouts(spark, model):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    held = spark.read.parquet(DATA.replace("0.001", "0.01") + "/pages.parquet").collect()
    for some in (rows, held):
        texts = extraction.extract([Page(r.html or "") for r in some], model)
        right = sum(t == article_blocks(r.html or "") for t, r in zip(texts, some))
        assert right >= 0.98 * len(some)
    draw = random.Random(77)
    other = [t for r in held[:100] for _, t in Page(r.html).blocks]
    right = total = 0
    for r in held[100:200]:
        main = article_blocks(r.html).split("\n")
        page, y = extraction._layout_nodes(extraction._layout(draw, main, other))
        right += extraction.extract([page], model)[0] == "\n".join(t for node, t in page.blocks if y[node])
        total += 1
    assert right >= 0.85 * total


@pytest.mark.parametrize("marked", [0, 5, 200])
def test_pages_without_main_elements(spark, marked):
    """Where few pages or none have <article>, the others' text is found all the same."""
    rows = spark.read.parquet(DATA.replace("0.001", "0.01") + "/pages.parquet").orderBy("page_id").collect()
    names = [("div", "div"), ("section", "section"), ("div class=content", "div")]

    def plain(i, source):
        opening, closing = names[i % len(names)]
        return source.replace("<article>", f"<{opening}>").replace("</article>", f"</{closing}>")

    assert all("<article>" in r.html for r in rows)
    mixed = [(r.page_id, r.html if i < marked else plain(i, r.html), article_blocks(r.html)) for i, r in enumerate(rows)]
    pages = spark.createDataFrame([m[:2] for m in mixed], "page_id long, html string")
    model = extraction.train(pages)
    texts = extraction.extract([Page(html) for _, html, _ in mixed], model)
    same = [t == want for t, (_, _, want) in zip(texts, mixed)]
    assert sum(same[marked:]) >= 0.8 * len(same[marked:]), (sum(same[:marked]), sum(same[marked:]))
    assert sum(same[:marked]) >= 0.8 * marked, (sum(same[:marked]), sum(same[marked:]))


def test_labels_leave_out_what_is_named_otherwise():
    def text(source):
        page = Page(source)
        y = extraction._labels(page)
        return [t for node, t in page.blocks if y[node]]

    assert text("<article><p>a</p><div class='advert-box'><p>b</p></div><p>c</p></article>") == ["a", "c"]
    assert text("<article><p>long text</p><section id=comments><article class=x><p>b, which is long as well</p></article></section></article>") == ["long text"]
    assert text("<article><p>long text</p><article><p>a reply</p></article></article>") == ["long text"]
    assert text("<main><div class=promo><p>a</p></div><article><p>some long text</p></article><p>b</p></main>") == ["some long text"]
    assert text("<article><p>a</p></article><article><p>the longer one</p></article>") == ["the longer one"]
    assert text("<div class=comments><article><p>much longer than the text</p></article></div><article><p>text</p></article>") == ["text"]
    assert text("<article class='post promoted'><p>a</p></article>") in (["a"], [])
    assert text("<p>a</p>") == []


@pytest.mark.parametrize("spoiled", [0, 20, 100, 200])
def test_adverts_and_comments_inside_the_article(spark, spoiled):
    """However many training pages have them, they are cut from held-out pages."""
    rows = spark.read.parquet(DATA.replace("0.001", "0.01") + "/pages.parquet").orderBy("page_id").collect()
    assert len(rows) == 250

    def with_parts(i, source):
        words = "Buy the best kettle now, only today, and save a lot of money on it."
        advert = f"<div class='{('advert', 'ad', 'sponsored')[i % 3]}'><p>{words}</p></div>"
        said = "".join(f"<article class=comment><p>Reader {k} says that this is quite well told.</p></article>" for k in range(1 + i % 3))
        source = source.replace("<article>", "<article>" + advert, 1)
        return source.replace("</article>", f"<section class=comments><h3>Comments</h3>{said}</section></article>", 1)

    training = [with_parts(i, r.html) if i < spoiled else r.html for i, r in enumerate(rows[:200])]
    model = extraction.fit(training)
    held = rows[200:]
    found = extraction.extract([Page(with_parts(i, r.html)) for i, r in enumerate(held)], model)
    assert sum(t == article_blocks(r.html) for t, r in zip(found, held)) >= 45


def test_long_pages_teach_too(spark):
    page = "<nav><a href=x>menu</a></nav><article>" + "<p>Some long text, told at length.</p>" * 4000 + "</article>"
    pages = spark.createDataFrame([(i, page) for i in range(20)], "page_id long, html string")
    assert extraction.train(pages) is not None


def test_query_and_odd_pages(spark, model):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r.page_id: r for r in queries.op5_html_extraction(spark, DATA).collect()}
    assert len(found) == pages.count()
    assert all(r.n_chars == len(r.text) for r in found.values())
    html = pages.filter("html is not null").first().html
    long = html.replace("</article>", "<p>" + "long text. " * 100_000 + "</p></article>")
    rows = [(1, "u", html), (1, "u", html), (2, None, None), (None, "u", ""), (3, "u", "<" * 1000), (4, "u", "plain"), (5, "u", long)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extraction.main_texts(odd, model).collect()
    assert len(got) == len(rows)
    texts = {r.id: r.text for r in got}
    assert texts[1] == article_blocks(html) and texts[2] == "" and texts[None] == ""
    assert texts[5].endswith("long text.") and len(texts[5]) > 1_000_000
    none = extraction.train(odd.limit(0))
    assert none is None and extraction.main_texts(odd, none).filter("text <> ''").isEmpty()
    assert extraction.main_texts(odd.limit(0), model).isEmpty()
