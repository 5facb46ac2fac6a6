"""Main text of web pages by boosted trees over DOM nodes and a hierarchical decoding.

Every block element of a page is scored by gradient-boosted trees on its subtree
(characters, links, tags, sentences, share of the page), its place (depth,
siblings) and the tokens of its tag, class, id and role and of its ancestors'.
Decoding labels all elements at once: along every path from the root a page goes
from outside to inside the main text and from there to parts cut out of it, never
back, so no element is kept within one that is cut.  Blocks inside are joined in
page order.

The trees are fitted on a bounded sample of the pages themselves, first of those
with an <article> or <main> element: what lies in it is text, except in parts that
are named as adverts, notices, forms, lists of links or comments; all else is not.  So
that they do not hang on those two names, each sampled page is also laid out anew,
its text among differently named and nested containers, menus, notices, forms and
comments made of other pages' text.  A page without such an element teaches
nothing as it stands; the element that holds most sentences is laid out anew.

A null or empty page has no text.  Tags that are never closed, cut off or wrongly
nested end where HTML lets them end.  A page of any length is read whole.
Repeated rows are treated alike.  Without any page with text every text is
empty; an empty table gives no rows.  Only id, url and html are read.
"""

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drayage.llm.boosting import BoostedTrees
from drayage.llm.common import map_batches, text_bytes
from drayage.llm.dom import NUMBERS, SENTENCE, Page

TRAIN_PAGES = 200
TRAIN_CHARS = 100_000
LAYOUTS = 3
#: Tokens that the trees know: those on this many elements of the training pages.
TOKEN_NODES = 20
ENTER, CUT = 1.0, 2.0
#: Characters of a block that may be main text where no element says so.
PROSE_CHARS = 60

MAIN_TAGS = {"article", "main"}
_MARKED = r"(?i)<(article|main)[\s/>]"
_MAIN = re.compile(r"(<(article|main)\b[^>]*>)(.*?)(?=</\2>|\Z)", re.S | re.I)
OUTSIDE_TAGS = {"nav", "header", "footer", "aside", "form"}

# Words, and beginnings of words, in the class, id or role of an element
# that holds something else than the text around it.
FOREIGN = {"ad", "ads", "adbox", "banner", "cookie", "cookies", "notice", "alert", "widget", "popup", "share", "social", "nav", "menu", "tags", "replies", "related", "disqus"}
FOREIGN_STEMS = ("advert", "sponsor", "promo", "newsletter", "sidebar", "footer", "copyright", "subscri", "disclaimer", "comment", "discussion", "review", "breadcrumb", "navigation")

# Names that pages give to containers.
MAIN_NAMES = [
    "article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "section class=story",
    "div class=article-body", "div id=main-text", "div role=main", "div itemprop=articleBody", "div class=post-body", "td class=text", "div", "section", "td",
]
WRAP_NAMES = ["div class=page", "div id=wrapper", "div class=container", "section", "div class=row", "div", "main", "div class=layout"]
LIST_NAMES = [
    "nav", "div class=menu", "ul class=nav", "div id=navigation", "header", "div class=header", "div class=breadcrumbs", "div class=tags",
    "div class=related", "aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=share", "div class=social",
]
PROSE_NAMES = [
    "div class=ad", "div class=advert", "div class=banner", "div class=sponsored", "div class=promo", "div class=cookie-notice", "div class=notice",
    "div role=alert", "div class=newsletter", "aside", "div class=sidebar", "div class=widget", "footer", "div class=footer", "div id=footer",
    "div class=copyright", "header", "div class=popup", "div class=subscribe", "div class=disclaimer", "div class=author-box",
]
COMMENT_NAMES = ["div class=comments", "section id=comments", "div id=disqus", "ol class=comment-list", "div class=replies", "section class=discussion", "div class=reviews"]


@dataclass
class Model:
    tokens: dict[str, int]
    trees: BoostedTrees


def _page_features(page: Page, tokens: dict[str, int]) -> np.ndarray:
    """Numbers, then for each known token whether the element has it and whether an ancestor has it."""
    own = np.zeros((len(page.tags), len(tokens)), np.float32)
    above = np.zeros_like(own)
    for i, (tag, names) in enumerate(zip(page.tags, page.tokens)):
        for name in ("<" + tag, *names):
            at = tokens.get(name)
            if at is not None:
                own[i, at] = 1
        if i:
            p = page.parents[i]
            above[i] = np.maximum(above[p], own[p])
    return np.concatenate([page.numbers(), own, above], 1)


def _decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each element is inside, by the best labelling outside > inside > cut along every path."""
    n = len(page.tags)
    worth = np.clip(odds, -6, 6).tolist()
    outside, inside, cut = [-w / 2 for w in worth], [w / 2 for w in worth], [-w / 2 for w in worth]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        outside[p] += max(outside[i], inside[i] - ENTER)
        inside[p] += max(inside[i], cut[i] - CUT)
        cut[p] += cut[i]
    state = [0] * n
    state[0] = int(inside[0] - ENTER > outside[0])
    for i in range(1, n):
        above = state[page.parents[i]]
        if above == 0:
            state[i] = int(inside[i] - ENTER > outside[i])
        elif above == 1:
            state[i] = 1 if inside[i] >= cut[i] - CUT else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


def extract(pages: list[Page], model: Model | None) -> list[str]:
    if not model or not pages:
        return [""] * len(pages)
    odds = model.trees.score(np.concatenate([_page_features(p, model.tokens) for p in pages]))
    out, at = [], 0
    for page in pages:
        kept = _decode(page, odds[at : at + len(page.tags)])
        at += len(page.tags)
        out.append("\n".join(text for node, text in page.blocks if kept[node]))
    return out


# -- training -----------------------------------------------------------


def _foreign(page: Page, i: int) -> bool:
    """The element's names say that what it holds is not of the text around it."""
    return page.tags[i] in OUTSIDE_TAGS or any(t in FOREIGN or t.startswith(FOREIGN_STEMS) for t in page.tokens[i])


def _main_element(page: Page) -> int | None:
    """The <article> or <main> that holds the page's text.

    An article in an article, or in an element of a foreign name, is a comment or a
    teaser.  Of several the one with most characters counts, and an <article> that has
    most of its <main> stands for it.
    """
    within = [0] * len(page.tags)  # the innermost candidate around each element, -1 below a foreign element
    candidates = []
    for i in range(1, len(page.tags)):
        above = within[page.parents[i]]
        if above < 0 or (above and page.tags[above] == "article" and page.tags[i] in MAIN_TAGS) or _foreign(page, i):
            within[i] = -1 if page.tags[i] not in MAIN_TAGS or above else 0
        else:
            within[i] = above
        if page.tags[i] in MAIN_TAGS and within[i] >= 0:
            within[i] = i
            candidates.append(i)
    chars = dict.fromkeys(candidates, 0)
    for node, text in page.blocks:
        i = within[node]
        while i > 0:
            chars[i] += len(text)
            i = max(0, within[page.parents[i]])
    if not candidates:
        return None
    best = max(candidates, key=lambda i: (chars[i], i))
    for i in candidates:
        if page.tags[best] == "main" and page.tags[i] == "article" and i > best and 2 * chars[i] > chars[best]:
            best = i
    return best


def _labels(page: Page) -> list[int]:
    """1 for elements of the main text, as the page's own element names tell.

    Adverts, notices, forms, lists of links and comments within it are not of it.
    """
    inside, best = [0] * len(page.tags), _main_element(page)
    for i in range(1, len(page.tags)):
        cut = _foreign(page, i) or (page.tags[i] == "article" and inside[page.parents[i]])
        inside[i] = 1 if i == best else int(inside[page.parents[i]] and not cut)
    return inside


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _element(name: str, content: str) -> str:
    return f"<{name}>{content}</{name.split()[0]}>"


def _layout(draw: random.Random, main: list[str], other: list[str]) -> str:
    """A page around the main blocks, with marks around them and around parts among them that are not text."""

    def words(least: int, most: int) -> str:
        text = draw.choice(other).split()
        size = draw.randint(least, most)
        start = draw.randrange(max(1, len(text) - size + 1))
        return _escaped(" ".join(text[start : start + size]))

    def links() -> str:
        items = "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(draw.randint(2, 9)))
        return _element(draw.choice(LIST_NAMES), f"<ul>{items}</ul>" if draw.random() < 0.8 else items)

    def prose() -> str:
        inner = "".join(draw.choice(("<p>{}</p>", "{}", "<div>{}</div>")).format(words(3, 40)) for _ in range(draw.randint(1, 3)))
        return _element(draw.choice(PROSE_NAMES), inner)

    def form() -> str:
        return f"<form>{words(1, 5)}<input name=q><p>{words(2, 12)}</p></form>"

    def comments() -> str:
        each = "".join(_element(draw.choice(("div class=comment", "li class=comment", "div", "article class=comment")), f"<p>{words(5, 60)}</p>") for _ in range(draw.randint(1, 5)))
        return _element(draw.choice(COMMENT_NAMES), f"<h3>{words(1, 3)}</h3>{each}")

    name = draw.choice(MAIN_NAMES)
    body = [f"<h1>{_escaped(main[0][:60])}</h1>"] if draw.random() < 0.6 else []
    for text in main:
        shape = draw.random()
        body.append(f"<p>{_escaped(text)}</p>" if shape < 0.8 else f"<blockquote>{_escaped(text)}</blockquote>" if shape < 0.87 else f"<h2>{_escaped(text[:50])}</h2>" if shape < 0.93 else f"<ul><li>{_escaped(text)}</li></ul>")
    for part in draw.sample((links, prose, prose, form), draw.randint(0, 2)):
        body.insert(draw.randrange(1, len(body) + 1), f"\0{part()}\1")
    if draw.random() < 0.25:
        body.append(f"\0{comments()}\1")
    before = "".join(draw.choice((links, links, prose, form))() for _ in range(draw.randint(1, 4)))
    after = "".join(draw.choice((links, prose, form, comments))() for _ in range(draw.randint(1, 5)))
    wraps = draw.sample(WRAP_NAMES, draw.randint(0, 2))
    opening = "".join(f"<{w}>" for w in wraps)
    closing = "".join(f"</{w.split()[0]}>" for w in reversed(wraps))
    whole = f"<html><body>{before}{opening}\2{_element(name, ''.join(body))}\3{closing}{after}</body></html>"
    return whole


def _layout_nodes(source: str) -> tuple[Page, list[int]]:
    """The page of a marked layout (\\2 main \\3, with parts \\0 not of it \\1) and its labels."""
    marked = source
    for mark, tag in (("\2", "<x-main>"), ("\3", "</x-main>"), ("\0", "<x-out>"), ("\1", "</x-out>")):
        marked = marked.replace(mark, tag)
    with_marks = Page(marked)
    inside = [0] * len(with_marks.tags)
    for i in range(1, len(inside)):
        tag = with_marks.tags[i]
        inside[i] = 1 if tag == "x-main" else 0 if tag == "x-out" else inside[with_marks.parents[i]]
    labels = [inside[i] for i, tag in enumerate(with_marks.tags) if tag not in ("x-main", "x-out")]
    page = Page(source.translate({0: None, 1: None, 2: None, 3: None}))
    return page, labels


def _shortened(source: str) -> str:
    """The page with only the first two blocks of its main text."""
    found = _MAIN.search(source)
    if not found:
        return source
    ends = [m.end() for m in re.finditer("</(?:p|h[1-6]|li|blockquote)>", found[3])]
    inner = found[3][: ends[min(1, len(ends) - 1)]] if ends else found[3]
    return source[: found.start(3)] + inner + source[found.end(3) :]


def _prose(page: Page) -> list[bool]:
    """Which blocks of a page without main element read like its text: those of the element that holds most sentences, but links."""
    outside = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        outside[i] = outside[page.parents[i]] or page.tags[i] in OUTSIDE_TAGS
    fit = [not outside[node] and 2 * link < len(text) for (node, text), link in zip(page.blocks, page.links)]
    told = [0] * len(page.tags)
    for f, (node, text) in zip(fit, page.blocks):
        if f and len(text) >= PROSE_CHARS and SENTENCE.search(text):
            told[max(0, page.parents[node])] += len(text)
    if any(told):
        inside = [False] * len(page.tags)
        inside[told.index(max(told))] = True
        for i in range(1, len(page.tags)):
            inside[i] = inside[i] or inside[page.parents[i]]
        return [f and inside[node] for f, (node, _) in zip(fit, page.blocks)]
    most = max((len(text) for f, (_, text) in zip(fit, page.blocks) if f), default=0)
    return [f and len(text) == most for f, (_, text) in zip(fit, page.blocks)]


def fit(sources: list[str]) -> Model | None:
    """Train on pages; None when they hold no text."""
    draw = random.Random(5)
    real, mains, other = [], [], []
    for source in sources:
        page = Page(source)
        if not page.blocks:
            continue
        y = _labels(page)
        if any(tag in MAIN_TAGS for tag in page.tags):
            real.append((page, y))
            mains.append([t for node, t in page.blocks if y[node]])
            other += [t for _, t in page.blocks]
        else:
            prose = _prose(page)
            mains.append([t for p, (_, t) in zip(prose, page.blocks) if p])
            other += [t for p, (_, t) in zip(prose, page.blocks) if not p]
    mains = [m for m in mains if m]
    if not mains:
        return None
    other = other or [t for m in mains for t in m]
    labelled = list(real)
    for main in mains:
        for _ in range(LAYOUTS):
            short = main[: draw.randint(1, 2)] if draw.random() < 0.3 else main
            page, y = _layout_nodes(_layout(draw, short, other))
            if len(page.tags) == len(y):
                labelled.append((page, y))
    brief = [Page(_shortened(s)) for s in sources if _MAIN.search(s)]
    labelled += [(p, _labels(p)) for p in brief if p.blocks and any(tag in MAIN_TAGS for tag in p.tags)]
    counts: dict[str, int] = {}
    for page, _ in labelled:
        for tag, names in zip(page.tags, page.tokens):
            for name in {"<" + tag, *names}:
                counts[name] = counts.get(name, 0) + 1
    tokens = {t: i for i, t in enumerate(sorted(t for t, n in counts.items() if n >= TOKEN_NODES))}
    x = np.concatenate([_page_features(p, tokens) for p, _ in labelled])
    y = np.concatenate([np.array(y, float) for _, y in labelled])
    return Model(tokens, BoostedTrees().fit(x, y))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model | None:
    """Fit on the beginnings of at most TRAIN_PAGES pages, those with a main element first, chosen by a hash of their id."""
    html = F.substring(F.col(html_col), 1, TRAIN_CHARS)
    rows = pages.select(F.col(id_col).alias("id"), html.alias("html")).filter("id is not null and html <> ''")
    rows = rows.withColumn("marked", F.col("html").rlike(_MARKED))
    ids = rows.groupBy("id").agg(F.max("marked").alias("marked"))
    chosen = ids.orderBy(F.desc("marked"), F.xxhash64("id"), "id").limit(TRAIN_PAGES)
    found = rows.join(F.broadcast(chosen), ["id", "marked"]).groupBy("id").agg(F.min("html").alias("html"))
    return fit([r.html for r in sorted(found.collect(), key=lambda r: str(r.id))])


def main_texts(pages: DataFrame, model: Model | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url and text."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            found = extract([Page(h.decode("utf-8", "replace")) for h in batch.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["id", "url", "text"])

    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("html"))
    return map_batches(plain, run, f"id {kinds[0]}, url {kinds[1]}, text string")
