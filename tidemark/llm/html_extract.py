"""Main text of web pages by tree scoring.

A page is parsed into its tree of block elements and, in page order, its blocks: runs of text between two block
boundaries. Parts that are never text of the article (menus, footers, asides, forms, scripts, what is hidden, what
its names call an advert, a notice or comments) are left out on the way. Each paragraph then passes points (for itself,
its commas and its length) to its parent, half of them to the next ancestor and ever fewer to the others; an element's
points count only as far as its text isn't links. The best element, widened to the article or main element that
it is in, is kept, with those siblings that score well or read like a paragraph or heading. Lists of links in it go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements at which the search for an open one stops.
SCOPE = frozenset("button caption html marquee object table td template th".split())
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: What a start tag ends, if it is open, and the elements that are looked into no further.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "caption"), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Blocks that pass their points to their parent; others are containers and keep them.
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th figcaption caption summary address".split())
#: Elements whose text is never the article's, and values of role that say the same.
NOT_TEXT = frozenset("aside audio button canvas dialog embed fieldset footer head iframe input label legend menu nav noscript object optgroup option search select svg template video".split())
NOT_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())

# Words in classes and ids.
COMMENT_WORDS = frozenset("comment comments disqus discussion replies reply respond responses".split())
OTHER_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs colophon consent cookie cookies copyright footer form gdpr login menu modal nav navbar navigation newsletter "
    "notice notification overlay pager pagination paywall popular popup promo promoted promotion rail recommendations recommended related search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toast toolbar topbar trending widget widgets".split()
)
GOOD_WORDS = frozenset("article blog body content entry hentry main post story text".split())
#: A word after one of these says what the element's neighbours are.
MODIFIERS = frozenset("has no with without".split())

#: Share of points by distance to the container, on from its parent: 1, 1/2, then a third of the distance.
LEVELS = 5
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "td": 3.0, "blockquote": 3.0}
SIBLING_SHARE, MENU_LINKS, MENU_SHARE, FORM_SHARE = 0.2, 2, 0.7, 0.5
COMMAS = re.compile("[,،、，]")

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
GAP = re.compile(r"[\s/]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Tree:
    """Block elements (parent, tag, what is known of them) and blocks of text (element, text, length of its links)."""

    def __init__(self):
        self.parent, self.tag, self.bonus = [-1], ["html"], [0.0]
        self.blocks: list[tuple[int, str, int, int]] = []

    def sums(self) -> tuple[list[int], list[int], list[int]]:
        """Length of text, length of links and number of links under each element."""
        text, linked, links = ([0] * len(self.tag) for _ in range(3))
        for at, block, chars, many in self.blocks:
            text[at] += len(block)
            linked[at] += chars
            links[at] += many
        for at in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            for of in (text, linked, links):
                of[self.parent[at]] += of[at]
        return text, linked, links


def attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from its name's end, and the place after the tag."""
    out: dict[str, str] = {}
    while True:
        at = GAP.match(html, at).end()
        if at >= len(html) or html[at] == ">":
            return out, at + 1
        m = ATTRIBUTE.match(html, at)
        if not m:  # a stray sign
            at += 1
            continue
        value = m[2] or ""
        if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out.setdefault(m[1].lower(), value)
        at = m.end()


def verdict(tag: str, has: dict[str, str], in_article: bool, hints: bool) -> tuple[bool, float]:
    """Whether an element is not part of an article, and what its names add to its points."""
    if "hidden" in has or has.get("aria-hidden") == "true" or HIDDEN.search(has.get("style", "")) or has.get("role", "").lower() in NOT_TEXT_ROLES:
        return True, 0.0
    if tag in ("html", "body", "main") or not hints:
        return False, 0.0
    good = other = comment = header = False
    for name in unescape(f"{has.get('class', '')} {has.get('id', '')}").split():
        words = [w.lower() for w in WORD.findall(name)]
        told = {w for w, before in zip(words, ["", *words], strict=False) if before not in MODIFIERS}
        comment |= bool(told & COMMENT_WORDS)
        bad = bool(told & OTHER_WORDS)
        other |= bad
        header |= bool(told & {"header", "masthead"}) and not told & GOOD_WORDS
        good |= bool(told & GOOD_WORDS) and not bad and not told & COMMENT_WORDS
    if comment or (other and not good and tag != "article"):
        return True, 0.0
    if header and not good and not in_article and tag not in HEADINGS and tag != "article":
        return True, 0.0
    body = has.get("itemprop", "").lower() == "articlebody" or has.get("role", "").lower() in ("main", "article")
    return False, 25.0 * body + 10.0 * good


def parse(html: str, hints: bool = True) -> Tree:
    """The tree of a page, in one pass. Open elements are found by their names' places on the stack, so depth costs nothing."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("html", 0)]  # tag, number of the nearest block element
    places: dict[str, list[int]] = {"html": [0]}
    blocks, scopes = [0], [0]  # places of block elements and of scopes
    gone = 0  # place of the outermost element that is left out
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                links = [" ".join(t.split()) for t, link in held if link]
                tree.blocks.append((stack[-1][1], text, min(len(text), sum(map(len, links))), sum(map(bool, links))))
            held = []

    def close(to: int) -> None:
        """Ends all elements from that place on."""
        nonlocal gone
        if blocks[-1] >= to:
            flush()
        while len(stack) > to:
            tag, _ = stack.pop()
            places[tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            if scopes[-1] == len(stack):
                scopes.pop()
        if gone >= to:
            gone = 0

    def last(tags: tuple[str, ...], within: tuple[str, ...]) -> int:
        """The place of the last open element of some tags that is within the last of others, or -1."""
        edge = max((places[t][-1] for t in within if places.get(t)), default=0)
        found = [p for t in tags for p in places.get(t, ())[-1:] if p > edge]
        return min(found) if found else -1

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at and not gone:
            held.append((unescape(html[at:start]), bool(places.get("a"))))
        if start >= size:
            break
        sign = html[start + 1 : start + 2]
        if sign == "!" and html.startswith("<!--", start):
            end = html.find("-->", start + 2)
            at = size if end < 0 else end + 3
            continue
        m = NAME.match(html, start + 2) if sign == "/" else None
        if sign in ("!", "?") or (sign == "/" and not m):
            end = html.find(">", start)
            at = size if end < 0 else end + 1
            continue
        if m:
            tag = m[0].lower()
            _, at = attributes(html, m.end())
            if at > size:
                break
            if tag == "br" and not gone:
                held.append((" ", False))
            elif tag == "p" and not places.get("p") and not gone:
                flush()
            elif tag not in ("html", "body") and places.get(tag):
                place = places[tag][-1]
                edge = places["table"][-1] - 1 if tag in TABLE and places.get("table") else min(scopes[-1], place - 1) if tag in SCOPE else scopes[-1]
                if place > edge and (tag in BLOCK or tag in SCOPE or place > blocks[-1]):
                    close(place)
            continue
        m = NAME.match(html, start + 1)
        if not m:
            if not gone:
                held.append(("<", bool(places.get("a"))))
            at = start + 1
            continue
        tag = m[0].lower()
        if html[m.end() : m.end() + 1] == ">":
            has, at = {}, m.end() + 1
        else:
            has, at = attributes(html, m.end())
            if at > size:
                break  # the page ends within a tag
        if tag in RAW:
            end = CLOSERS[tag].search(html, at)
            if tag in BLOCK:
                flush()
            at = size if end is None else min(size, html.find(">", end.end()) + 1 or size)
            continue
        if tag in ("html", "body") and (tag == "html" or places.get("body")):
            continue
        if places.get("head") and tag not in IN_HEAD and places["head"][-1] == blocks[-1]:
            close(places["head"][-1])
        if tag in ENDS_P and places.get("p") and places["p"][-1] > scopes[-1]:
            close(places["p"][-1])
        if tag in IMPLIED and (place := last(*IMPLIED[tag])) > 0:
            close(place)
        if tag == "a" and places.get("a") and places["a"][-1] > blocks[-1]:
            close(places["a"][-1])
        if tag in VOID:
            if not gone:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr"):
                    held.append((" " if tag == "br" else "", False))
            continue
        if tag in BLOCK and not gone:
            flush()
        in_article = bool(places.get("article") or places.get("main"))
        out, bonus = (False, 0.0) if gone else verdict(tag, has, in_article, hints) if has else (False, 0.0)
        if not gone and (out or tag in NOT_TEXT or (tag == "header" and not in_article)):
            gone = len(stack)
        number = stack[-1][1]
        if tag in BLOCK:
            blocks.append(len(stack))
            if not gone:
                number = len(tree.tag)
                tree.parent.append(stack[-1][1])
                tree.tag.append(tag)
                tree.bonus.append(BONUS.get(tag, 0.0) + bonus)
        if tag in SCOPE:
            scopes.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, number))
    if not gone:
        flush()
    return tree


def chosen(tree: Tree) -> list[str]:
    """The blocks of the main text, in page order."""
    size, (text, linked, links) = len(tree.tag), tree.sums()
    whole = text[0]
    left_out = [tree.tag[i] == "form" and text[i] < FORM_SHARE * whole for i in range(size)]
    density = lambda i: linked[i] / text[i] if text[i] else 0.0
    for i in range(1, size):
        left_out[i] = left_out[i] or left_out[tree.parent[i]]
    points, scored = [0.0] * size, [False] * size
    for at, block, chars, _ in tree.blocks:
        if left_out[at] or tree.tag[at] in HEADINGS:
            continue
        worth = (1 + len(COMMAS.findall(block)) + min(len(block) / 100, 3.0)) * (1 - chars / len(block))
        node = tree.parent[at] if tree.tag[at] in PARAGRAPHS and at else at
        for level in range(LEVELS):
            if node < 0:
                break
            points[node] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[node] = True
            node = tree.parent[node]
    score = [(points[i] + tree.bonus[i]) * (1 - density(i)) if scored[i] else 0.0 for i in range(size)]
    best = max(range(size), key=lambda i: (score[i], -i))
    if score[best] <= 0:  # nothing but headings or links
        return [b for at, b, chars, _ in tree.blocks if not left_out[at] and 2 * chars <= len(b)]
    within, up = None, best
    while up > 0:
        if tree.tag[up] == "article" or (tree.tag[up] == "main" and within is None):
            within = up
            if tree.tag[up] == "article":
                break
        up = tree.parent[up]
    best = best if within is None else within
    kept, least = [False] * size, max(1e-9, SIBLING_SHARE * points[best])  # of a sibling's points, whatever its kind
    loose = -1  # the element whose own text is looked at, too
    if best:
        above = tree.parent[best]
        for i in range(1, size):
            if tree.parent[i] != above or density(i) > 0.5:
                continue
            if within is not None:
                kept[i] = tree.tag[i] == tree.tag[best] and points[i] >= least
            else:
                kept[i] = points[i] >= least or tree.tag[i] in HEADINGS or (tree.tag[i] == "p" and text[i] > 80 and density(i) < 0.25)
        loose = above if within is None else -1
    kept[best] = True
    for i in range(1, size):
        menu = tree.tag[i] in ("ul", "ol", "dl", "div", "section", "table", "menu") and links[i] >= MENU_LINKS and density(i) >= MENU_SHARE
        left_out[i] = left_out[i] or left_out[tree.parent[i]] or (menu and i != best)
        kept[i] = kept[i] or kept[tree.parent[i]]
    out = []
    for at, block, chars, _ in tree.blocks:
        if not left_out[at] and (kept[at] or (at == loose and len(block) > 80 and chars < 0.25 * len(block))):
            out.append(block)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = chosen(parse(html))
    return "\n".join(blocks or chosen(parse(html, hints=False)))


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with their main text in ``into`` (which is replaced, if there is such a column): blocks in page order,
    one a line.

    Character references are decoded, white space within a block becomes one blank, line breaks included. Null and
    empty pages, and pages without text, have an empty one. Broken markup is mended as browsers do in the main: missing and
    misplaced end tags, tags and comments that the page ends in. Whole pages are taken, very long ones in linear time.
    Rows are judged alone, so ties, repeats and empty tables need no rule.
    """
    kept = pages.select(*(c for c in pages.columns if c != into))
    schema = kept.withColumn(into, F.lit("")).schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = batch.column(batch.schema.get_field_index("html made text"))
            found = pa.array([main_text(p.as_py()) for p in page], pa.string())
            yield pa.record_batch([*batch.columns[:-1], found], schema.names)

    return kept.withColumn("html made text", F.col(html).cast("string")).mapInArrow(texts, schema)
