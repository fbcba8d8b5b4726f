"""Main text of HTML pages from streamed parser events.

The standard library's parser feeds blocks ("lines"): text between borders of block elements, each character with the element it stands in, so that what a dropped
inline element holds never joins the block around it.  Every block has a text-to-tag ratio; the ratios' logarithms (so that one very long paragraph doesn't make
all others look short) are smoothed by a Gaussian over neighbouring blocks and split in two clusters around a threshold; the blocks of the upper one are the content.

The region is all outer articles (or mains) if they hold the larger part of the content, else the innermost element that holds all of it (links apart).  All blocks of the
region are the text, short and linked ones too, but for boilerplate:

* elements that are never text (scripts, menus, forms, buttons, embedded media, footers and the like), and a header outside an article;
* elements named as boilerplate: a class, id or role of which every word is a mark or a word of layout ("cookie-notice", "sidebar-right").  Such a name counts
  for nothing if its element holds the page's article or most of its text, unless it names readers' comments or a demand for consent;
* inside an article names are judged by what they hold where they may tell of its subject: words such as "social" or "banner", the id of a section, any name of a
  paragraph or quotation.  Such an element goes only if less than half of its text is content outside links.  The id of a heading counts for nothing;
* elements most of whose blocks are outside the content and most of whose text is links, if a mark stands among other words in their name ("market-share") or the page has no
  article or main.

Null and empty pages have no text.  Unclosed elements end with their parent; pages cut off in mid-tag keep what came before.  Work grows with the page's length,
however deep its elements are nested or however many stay open.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIGMA = 1.5
#: Share of the content that the articles must hold to be the region.
REGION_SHARE = 0.6
#: Characters a tag, after smoothing, that make a block content on any page, also where other blocks have many more.
ENOUGH = 5

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("head title script style noscript template svg math canvas iframe object audio video nav menu footer aside form button select textarea input dialog".split())
REGIONS = frozenset("article main section div td body".split())
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus dialog footer form gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split())
#: Those of them that an article may bear, first words of names that tell of a layout, and words that make a header an article's own.
ARTICLE_MARKS = frozenset("ad advert advertisement comment comments promo promoted related reply sponsored teaser".split())
LAYOUT = frozenset("has no with without".split())
HEADED = frozenset("article entry post story content".split())
#: Marks of readers' comments and of demands for consent: their elements go however much they hold.
HARD = frozenset("comment comments consent cookie cookies disqus gdpr replies reply respond".split())
#: Marks that may also tell what a part of an article is about.
TOPICS = frozenset("banner copyright navigation search sharing social".split())
#: Elements of an article's own text.
PROSE = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 p pre q table td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marks that often stand at the head of a word without a border ("commentlist").
JOINED = ("comments", "comment", "cookie", "disqus", "gdpr", "newsletter", "replies", "reply", "sidebar")
#: Words that tell where or in what shape an element is, or whose it is, not what it holds.
SHAPES = frozenset("all backdrop blog customer facebook form guest latest layer new overlay public reader readers recent screen thread threads user users visitor wall wp your area articles bar block body bottom box btn button buttons center col column container content count counter fixed float footer group head header holder icon icons inline inner item items label left line link links list main menu module outer page panel popup post posts primary right row secondary section site slot small sticky stories strip tab text title top unit view wrap wrapper".split())
WEAK, TOPIC, NAMED, LASTING, NEVER = 1, 2, 3, 4, 5
_P_ENDERS = BLOCK - {"br", "option", "caption", "td", "th", "tr"}
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")


class _Node:
    """An element: what its name marks, whether it or one around it is left out, how deep it is, the block element it is or stands in, and sums over the blocks
    inside it (all text, linked text, content outside links, blocks, blocks of the content)."""

    __slots__ = ("block", "blocks", "content", "dense", "depth", "dropped", "flag", "held", "linked", "mark", "parent", "tag")

    def __init__(self, tag: str, parent: _Node | None, mark: int) -> None:
        self.tag, self.parent, self.mark = tag, parent, mark
        self.dropped = mark >= NAMED or parent is not None and parent.dropped
        self.depth = 0 if parent is None else parent.depth + 1
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.flag, self.held, self.linked, self.content, self.blocks, self.dense = False, 0, 0, 0, 0, 0

    def links_only(self) -> bool:
        """Most blocks inside are outside the content, and most of the text is links."""
        return 2 * self.dense < self.blocks and 2 * self.linked > self.held

    def judged(self) -> bool:
        """Whether what its name only suggests holds."""
        return self.mark == WEAK and self.links_only() or self.mark == TOPIC and 2 * self.content < self.held


class Blocks(HTMLParser):
    """Blocks of a page: (text, tags seen, characters in links, element); all its elements, outer ones first.

    A block's element is the block element it stands in; text of dropped elements is a block of its own, in the element that drops it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = _Node("", None, 0)
        self.nodes = [self.node]
        self.open: dict[str, list[_Node]] = {}  # open elements of each name, inner ones last
        self.open_blocks: list[_Node] = []  # open block elements but for paragraphs
        self.blocks: list[tuple[str, int, int, _Node]] = []
        self.runs: list[tuple[str, bool, _Node]] = []
        self.tags = self.in_link = 0

    def innermost(self, *tags: str) -> _Node | None:
        """The innermost open element of some names."""
        found = [self.open[t][-1] for t in tags if self.open.get(t)]
        return max(found, key=lambda n: n.depth, default=None)

    def enter(self, tag: str, attrs: list) -> None:
        self.node = _Node(tag, self.node, self.marked(tag, attrs))
        self.nodes.append(self.node)
        self.open.setdefault(tag, []).append(self.node)
        if tag in BLOCK and tag != "p":
            self.open_blocks.append(self.node)

    def leave(self, up: _Node) -> None:
        """Close all elements up to and with this one."""
        while True:
            self.open[self.node.tag].pop()
            if self.open_blocks and self.open_blocks[-1] is self.node:
                self.open_blocks.pop()
            done, self.node = self.node is up, self.node.parent
            if done:
                return

    def border(self) -> None:
        kept, dropped = [], {}
        for run in self.runs:
            if run[2].dropped:
                dropped.setdefault(run[2], []).append(run)
            else:
                kept.append(run)
        for node, runs in ([(kept[-1][2].block, kept)] if kept else []) + list(dropped.items()):
            text = " ".join("".join(r[0] for r in runs).split())
            if text:
                self.blocks.append((text, self.tags, sum(len(r[0]) for r in runs if r[1]), node))
                self.tags = 0
        self.runs.clear()

    def marked(self, tag: str, attrs: list) -> int:
        if tag in DROPPED:
            return NEVER
        if tag in ("body", "html", "main"):
            return 0
        inside = self.inside_article()
        if tag == "header":
            return 0 if inside else NEVER
        marks, found = ARTICLE_MARKS if tag == "article" else MARKS, 0
        for k, v in attrs:
            if k not in ("class", "id", "role") or not v or k == "id" and tag in HEADINGS:
                continue
            for name in v.split():
                w = [x for word in _WORD.findall(_HUMP.sub(r"\1 \2", name).lower()) for x in _parted(word)]
                if not w or w[0] in LAYOUT:
                    continue
                hits = marks.intersection(w)
                if hits and all(x in marks or x in SHAPES for x in w):
                    found = max(found, _named(tag, k, hits, inside))
                elif hits:
                    found = max(found, WEAK)
                elif tag != "article" and "header" in w and HEADED.isdisjoint(w) and not inside:
                    found = max(found, NAMED)
        return found

    def inside_article(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.border()
        self.tags = 0 if tag == "body" else self.tags + 1
        if tag in ("article", "main") and self.node.dropped:
            self.leave_unclosed()
        if tag in _P_ENDERS:
            self.close_p()
        if tag == "a":
            self.in_link = 1
        if tag not in VOID:
            self.enter(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe"):
            self.handle_endtag(tag)

    def leave_unclosed(self) -> None:
        """An article or main never stands in a menu, head or footer: such an element was left open."""
        up = self.innermost("nav", "footer", "header", "menu", "form", "head")
        if up is not None and not up.parent.dropped:
            self.leave(up)

    def close_p(self) -> None:
        """A new block ends a paragraph that no other block stands in between."""
        p = self.innermost("p")
        if p is not None and (not self.open_blocks or self.open_blocks[-1].depth < p.depth):
            self.leave(p)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.border()
        if tag == "a":
            self.in_link = 0
        up = self.innermost(tag)
        if up is None:
            return
        if tag in ("p", "b", "i", "em", "strong", "span", "a"):
            holds = self.innermost("article", "main", "body", "table")
            if holds is not None and holds.depth > up.depth:
                return
        self.leave(up)

    def handle_data(self, data: str) -> None:
        if self.node.tag not in ("script", "style"):
            self.runs.append((data, bool(self.in_link), self.node))

    def close(self) -> None:
        super().close()
        self.border()


def _parted(word: str) -> list[str]:
    """A word, or its two parts if it is a mark and a word of layout without a border between."""
    if word in MARKS or word in SHAPES:
        return [word]
    for head in JOINED:
        if word.startswith(head) and word[len(head) :] in SHAPES:
            return [head, word[len(head) :]]
    return [word]


def _named(tag: str, attribute: str, hits: frozenset[str], inside: bool) -> int:
    """What a name of marks and words of layout means."""
    if inside and (tag in PROSE or hits <= TOPICS or attribute == "id" and tag == "section" and hits.isdisjoint(HARD)):
        return TOPIC
    return NAMED if hits.isdisjoint(HARD) else LASTING


_COMMENT_END = re.compile(r"--\s*!?>")


def _finished(html: str) -> str:
    """The page without a tag or comment that it breaks off in, which the parser would look for again at each "<" of the rest."""
    last = 0
    for m in _COMMENT_END.finditer(html):
        last = m.end()
    opened = html.find("<!--", last)
    if opened >= 0:
        html = html[:opened]
    closed = html.rfind(">") + 1
    tag = re.compile(r"<[A-Za-z/!?]").search(html, closed)
    return html if tag is None else html[: tag.start()]


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    n, out = len(values), []
    for i in range(n):
        weight = total = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), kernel, strict=True):
            if 0 <= k < n:
                weight += w
                total += w * values[k]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Between the means of two clusters (k-means in one dimension); the smallest value if all are equal."""
    low, high = min(values), max(values)
    if high - low < 1e-9:
        return low
    cut = (low + high) / 2
    for _ in range(32):
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below or not above:
            break
        new = (sum(below) / len(below) + sum(above) / len(above)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return min(cut, high)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Blocks()
    parser.feed(_finished(html))
    parser.close()
    nodes = parser.nodes
    blocks = _unmarked(nodes, parser.blocks)
    if not blocks:
        return ""
    ratios = smoothed([math.log1p(max(0, len(b[0]) - b[2]) / max(1, b[1])) for b in blocks])
    cut = min(threshold(ratios), math.log1p(ENOUGH))
    _sum_up(nodes, blocks, [r >= cut for r in ratios])
    for n in nodes[1:]:
        n.dropped = n.parent.dropped or n.judged()
    _choose(nodes)
    return " ".join(text for text, _, _, node in blocks if node.flag and not node.dropped)


def _sum_up(nodes: list[_Node], blocks: list[tuple[str, int, int, _Node]], content: list[bool]) -> None:
    for n in nodes:
        n.held = n.linked = n.content = n.blocks = n.dense = 0
    for (text, _, linked, node), is_content in zip(blocks, content, strict=True):
        node.held += len(text)
        node.linked += linked
        node.blocks += 1
        if is_content:
            node.content += max(0, len(text) - linked)
            node.dense += 1
    for n in reversed(nodes[1:]):  # inner elements come after outer ones
        n.parent.held += n.held
        n.parent.linked += n.linked
        n.parent.content += n.content
        n.parent.blocks += n.blocks
        n.parent.dense += n.dense


def _flag(nodes: list[_Node], chosen: Callable[[_Node], bool]) -> None:
    """Set flag for the chosen elements and all inside them."""
    nodes[0].flag = chosen(nodes[0])
    for n in nodes[1:]:
        n.flag = n.parent.flag or chosen(n)


def _unmarked(nodes: list[_Node], blocks: list[tuple[str, int, int, _Node]]) -> list[tuple[str, int, int, _Node]]:
    """Blocks outside boilerplate; sets dropped anew without weak marks.  Where no article or main stands outside it, a name (or form) counts for nothing if its
    element holds most of the page's text, or the article that is larger than all text outside."""
    _flag(nodes, lambda n: n.tag in ("article", "main"))
    kept = [b for b in blocks if not b[3].dropped]
    if len(kept) < len(blocks) and not any(b[3].flag for b in kept):
        _flag(nodes, lambda n: n.mark >= LASTING and n.tag != "form")
        possible = [b for b in blocks if not b[3].flag]
        _sum_up(nodes, possible, [False] * len(possible))
        spared = {n for n in nodes if n.mark and n.mark != LASTING and 2 * n.held > nodes[0].held}
        articles = [n for n in nodes if n.tag in ("article", "main") and not n.mark]
        if articles and (up := max(articles, key=lambda n: n.held)).held > sum(len(b[0]) for b in kept):
            while up is not None:
                spared.add(up)
                up = up.parent
        for n in nodes[1:]:
            n.dropped = n.parent.dropped or n.mark >= NAMED and n not in spared
        kept = [b for b in blocks if not b[3].dropped]
    return kept


def _choose(nodes: list[_Node]) -> None:
    """Set flag for the region's elements: all outer articles (or mains) that have content or aren't mostly links, if they hold the larger part of the content; else
    the innermost element that holds all of it, without what is only links."""
    total = nodes[0].content
    for tags in (("article",), ("article", "main")):
        _flag(nodes, lambda n, tags=tags: n.tag in tags)
        outer = {n for n in nodes if n.tag in tags and not n.parent.flag and (n.content or n.held > 2 * n.linked)}
        if sum(n.content for n in outer) >= REGION_SHARE * total:
            _flag(nodes, outer.__contains__)
            return
    region = max((k for k, n in enumerate(nodes) if n.tag in REGIONS and total and n.content == total), default=0)
    _flag(nodes, lambda n: n is nodes[region])
    for n in nodes[1:]:
        n.dropped = n.dropped or n.parent.dropped or n.parent.flag and n.links_only()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; null and empty pages give an empty text; repeated rows give repeated rows."""

    def rows(batch: pa.RecordBatch) -> list:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    return common.mapped(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), rows, "page_id bigint, url string, text string, n_chars bigint")
