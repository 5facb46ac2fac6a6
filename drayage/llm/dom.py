"""A small DOM: block elements of a page with their features, and its runs of text."""

import html
import math
import re

import numpy as np

# Element names by their role in HTML.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
#: A raw element other than these that is never closed (or not before the next one of its name) is its start tag alone.
TO_THE_END = {"script", "style"}
#: So are these; closed, they are ordinary elements.
CLOSED_ONLY = set("button object video audio canvas svg math".split())
#: Within these, elements of any name stand in the line; a start tag of ENDS_PARAGRAPH or ENDS ends them.
FOREIGN = {"svg", "math"}
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag ends an open element of these names, up to the next container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S
)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKENS = re.compile("[a-z]+").findall
#: What a select cannot hold.
_ENDS_SELECT = re.compile(r"</select(?=[\s/>])|<(?!/?(?:option|optgroup|hr|script|template|select)(?=[\s/>]))/?[a-z]", re.I)
SENTENCE = re.compile("[.!?…](?:\\s|$)")

NUMBERS = (
    "depth children place siblings same_tag chars share links_share tags_per_char longest blocks mean_block sentences "
    "items headings inputs begins parent_share"
).split()


class Page:
    """Block elements in page order: tag, tokens, parent, and what their subtrees hold."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#page"]
        self.tokens: list[list[str]] = [[]]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[int] = []  # characters of each block inside links
        self.inner_tags: list[int] = [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block element that each is or lies in
        run: list[str] = []
        linked = 0
        in_link = 0
        foreign = 0  # open elements of FOREIGN
        at = 0
        next_tag: dict[str, re.Match | None] = {}
        tags, tokens, parents, inner = self.tags, self.tokens, self.parents, self.inner_tags

        def close_run() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.blocks.append((stack[-1][1], text))
                    self.links.append(min(linked, len(text)))
                run.clear()
                linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if "&" in text:
                text = html.unescape(text)
            run.append(text)
            if in_link:
                linked += len(text)

        def end_of(name: str) -> int:
            """Where the open element's end tag begins, or -1 when it has none before the next start tag of its name."""
            if name not in next_tag or next_tag[name] and next_tag[name].start() < at:
                closing = "/" if name in TO_THE_END else "/?"
                next_tag[name] = re.compile(rf"<{closing}{name}(?=[\s/>])", re.I).search(source, at)
            tag = next_tag[name]
            return tag.start() if tag and source[tag.start() + 1] == "/" else -1

        def leave(depth: int) -> None:
            """Close the open elements from the given one on."""
            nonlocal in_link
            for t, _ in stack[depth:]:
                in_link -= t == "a"
            del stack[depth:]

        while True:
            found = _TAG.search(source, at)
            if not found:
                break
            if found.start() > at:
                add(source[at : found.start()])
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                if name == "p" and all(t != "p" for t, _ in stack):
                    close_run()
                    continue
                depth = len(stack) - 1
                while depth and stack[depth][0] != name:
                    depth -= 1
                if depth:
                    if stack[-1][1] != stack[depth - 1][1]:
                        if stack[depth][1] == stack[depth - 1][1]:
                            continue  # an inline end tag does not close blocks
                        close_run()
                    foreign -= sum(t in FOREIGN for t, _ in stack[depth:])
                    leave(depth)
                continue
            if name == "head":
                continue  # what it cannot hold ends it; all that it can hold has no text
            inner[stack[-1][1]] += 1
            if foreign and (name in ENDS_PARAGRAPH or name in ENDS or name == "body"):
                leave(next(i for i, (t, _) in enumerate(stack) if t in FOREIGN))
                foreign = 0
            if name in CLOSED_ONLY and (found[3].endswith("/") or end_of(name) < 0):
                run.append(" ")
                continue
            if name in FOREIGN or foreign and name not in RAW and name not in INLINE:
                run.append(" ")
                if not found[3].endswith("/") and name not in VOID:
                    foreign += name in FOREIGN
                    stack.append((name, stack[-1][1]))
                continue
            if name in INLINE:
                if name in VOID:
                    run.append(" ")
                else:
                    if name == "a":
                        in_link += 1
                    stack.append((name, stack[-1][1]))
                continue
            if name in RAW:
                if not found[3].endswith("/"):
                    end = end_of(name)
                    if end >= 0 or name in TO_THE_END:
                        at = end if end >= 0 else len(source)
                    elif name == "title":
                        start = source.find("<", at)
                        at = start if start >= 0 else len(source)
                run.append(" ")
                continue
            if name == "select":
                end = _ENDS_SELECT.search(source, at)
                at = end.start() if end else len(source)
                run.append(" ")
                continue
            close_run()
            if name in ENDS_PARAGRAPH:
                depth = len(stack) - 1
                while depth and stack[depth][0] in INLINE:
                    depth -= 1
                if depth and stack[depth][0] == "p":
                    leave(depth)
            elif name in ENDS:
                depth = len(stack) - 1
                while depth and stack[depth][0] not in ENDS[name] and stack[depth][0] not in CONTAINERS:
                    depth -= 1
                if depth and stack[depth][0] in ENDS[name]:
                    leave(depth)
            if name in VOID:
                continue
            tags.append(name)
            parents.append(stack[-1][1])
            attributes = found[3]
            own = []
            if attributes:
                for _, value in _NAMED.findall(attributes):
                    own += _TOKENS(html.unescape(value).lower())
            tokens.append(own)
            inner.append(0)
            stack.append((name, len(tags) - 1))
        if at < len(source):
            rest = source[at:]
            add(rest[: rest.rfind("<")] if re.search(r"<[/!?a-zA-Z][^>]*\Z", rest) else rest)
        close_run()

    def numbers(self) -> np.ndarray:
        """One row of NUMBERS for each element."""
        n = len(self.tags)
        parents = self.parents
        chars, linked, blocks, longest, sentences = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        begins = [-1] * n
        total = 0
        for (node, text), link in zip(self.blocks, self.links):
            chars[node] += len(text)
            linked[node] += link
            blocks[node] += 1
            longest[node] = max(longest[node], len(text))
            sentences[node] += len(SENTENCE.findall(text))
            if begins[node] < 0:
                begins[node] = total
            total += len(text)
        items = [int(t == "li") for t in self.tags]
        headings = [int(len(t) == 2 and t[0] == "h" and t[1].isdigit()) for t in self.tags]
        inputs = [int(t in ("form", "fieldset", "input")) for t in self.tags]
        inner = list(self.inner_tags)
        depth, children = [0] * n, [0] * n
        by_tag: dict[tuple[int, str], int] = {}
        place = [0] * n
        for i in range(1, n):
            p = parents[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            key = (p, self.tags[i])
            by_tag[key] = by_tag.get(key, 0) + 1
        for i in range(n - 1, 0, -1):
            p = parents[i]
            for sums in (chars, linked, blocks, sentences, items, headings, inputs, inner):
                sums[p] += sums[i]
            longest[p] = max(longest[p], longest[i])
            if begins[i] >= 0 and (begins[p] < 0 or begins[i] < begins[p]):
                begins[p] = begins[i]
        whole = max(1, total)
        rows = np.empty((n, len(NUMBERS)), np.float32)
        for i in range(n):
            p = max(0, parents[i])
            c = chars[i]
            rows[i] = (
                depth[i],
                children[i],
                place[i],
                children[p],
                by_tag.get((p, self.tags[i]), 1) / max(1, children[p]),
                math.log1p(c),
                c / whole,
                linked[i] / max(1, c),
                inner[i] / max(20, c),
                math.log1p(longest[i]),
                blocks[i],
                c / max(1, blocks[i]),
                100 * sentences[i] / max(1, c),
                items[i],
                headings[i],
                inputs[i],
                max(0, begins[i]) / whole,
                c / max(1, chars[p]),
            )
        return rows
