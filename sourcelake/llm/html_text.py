"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into blocks, the page's
lines: runs of text between block-level tags.  Elements that are never content
(menus, headers, footers, forms, scripts, adverts and the like, by their tag,
role or class) are left out on the way.  Each block has a ratio of characters
to tags; the ratios are smoothed with a Gaussian kernel, and blocks over a
threshold, their standard deviation, form clusters.  The region with most of
the clusters' text is the main text: an article or main element, or the deepest
container that holds nearly all of it, with its short blocks too; if only the
body holds it, the clusters themselves.

A class, an id or a form can stand around a whole article.  If leaving such
elements out leaves next to nothing, the page is read again with those kept that
hold an article or main element, or else the outermost that holds most of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import chunks, in_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("html body main article section div td center".split())
NEVER = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video nav header footer aside form fieldset select button label textarea dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer comment comments respond reply replies discussion disqus cookie cookies notice consent gdpr alert popup modal overlay newsletter "
    "subscribe signup share sharing social related recommended recommendations widget toolbar pagination pager search login hidden copyright legal disclaimer".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What a start tag of the first kind closes, if it is open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA, RADIUS = 1.0, 2
#: Share of the clusters' text that a container must hold to be the region.
MOST = 0.9
#: Blocks under the threshold that don't part a cluster.
GAP = 2
#: Elements that may hold a whole article although they are left out otherwise.
WRAPPERS = frozenset(("form", "fieldset"))
#: A page that keeps a smaller share of its text is read again with wrappers kept.
LEAST = 0.05
#: Nested wrappers that are tried one by one.
TRIES = 8


class Blocks(HTMLParser):
    """Parser events to blocks: (text, tags, innermost container that is open or -1).

    Containers and wrappers are numbered as they begin, so what lies inside one has
    the numbers from its own to the last begun in it.  ``kept``: wrappers that are
    read like any element.
    """

    def __init__(self, kept: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.kept = kept
        self.blocks: list[tuple[str, int, int]] = []
        self.tag_of: list[str] = []  # of each container, and the one around it
        self.parent: list[int] = []
        self.around: list[int] = []  # of each wrapper, the one around it, its own text, and whether it holds an article
        self.wrapped: list[int] = []
        self.article: list[bool] = []
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, out of content, container or -1, wrapper or -1
        self.open: Counter[str] = Counter()  # tags on the stack
        self.out = 0
        self.hard = 0
        self.path: list[int] = []
        self.wrappers: list[int] = []
        self.held: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held = []
            if text:
                self.blocks.append((text, max(1, self.tags), self.path[-1] if self.path else -1))
                self.tags = 0

    def pop(self) -> str:
        tag, out, container, wrapper = self.stack.pop()
        self.open[tag] -= 1
        self.out -= out
        self.hard -= out and wrapper < 0
        if container >= 0:
            self.path.pop()
        if wrapper >= 0:
            self.wrappers.pop()
        return tag

    def close_open(self, tags: frozenset | set) -> None:
        """Close the innermost of these elements, unless a container lies between."""
        if not any(self.open[tag] for tag in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag, _, container, _ = self.stack[k]
            if tag in tags:
                while len(self.stack) > k:
                    self.pop()
                return
            if container >= 0 or tag in ("ul", "ol", "table", "dl"):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
            self.close_open({"p"})
            if tag in CLOSES:
                self.close_open(CLOSES[tag])
        elif tag == "br":
            self.held.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        hard, soft = tag in NEVER and tag not in WRAPPERS or self.hidden(tag, attrs), tag in WRAPPERS or self.marked(tag, attrs)
        wrapper = -1
        if soft and not hard and not self.hard:
            wrapper = len(self.around)
            self.around.append(self.wrappers[-1] if self.wrappers else -1)
            self.wrapped.append(0)
            self.article.append(False)
            self.wrappers.append(wrapper)
        elif tag in ("article", "main") and self.wrappers and not self.hard and not self.named(attrs):
            self.article[self.wrappers[-1]] = True
        out = hard or soft and wrapper not in self.kept
        if out and tag in INLINE and not self.out:
            self.flush()
        container = -1
        if tag in CONTAINERS and not self.out and not out:
            container = len(self.tag_of)
            self.tag_of.append(tag)
            self.path.append(container)
            self.parent.append(self.path[-2] if len(self.path) > 1 else -1)
        self.stack.append((tag, out, container, wrapper))
        self.open[tag] += 1
        self.out += out
        self.hard += out and wrapper < 0

    @staticmethod
    def named(attrs: list) -> bool:
        return any(w.lower() in MARKS for name, value in attrs if name in ("class", "id") for w in WORD.findall(value or ""))

    def marked(self, tag: str, attrs: list) -> bool:
        return tag not in ("html", "body", "main", "article") and (self.named(attrs) or any(name == "role" and value in ROLES for name, value in attrs))

    @staticmethod
    def hidden(tag: str, attrs: list) -> bool:
        if tag in ("html", "body", "main", "article"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in INLINE and (self.stack[k][2] >= 0 or self.stack[k][0] not in INLINE):
                return  # it was closed with its block

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.held.append(data)
        if self.wrappers and not self.hard:
            self.wrapped[self.wrappers[-1]] += len("".join(data.split()))


def smoothed(ratio: np.ndarray) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    full = lambda x: np.convolve(x, k)[RADIUS : RADIUS + len(x)]
    return full(ratio) / full(np.ones(len(ratio)))


def read(html: str, kept: frozenset[int] = frozenset()) -> Blocks:
    parser = Blocks(kept)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def summed(own: list[int], parent: list[int]) -> list[int]:
    """Of each element, its own and what is inside it; a parent has a smaller number than its children."""
    total = list(own)
    for c in range(len(total) - 1, -1, -1):
        if parent[c] >= 0:
            total[parent[c]] += total[c]
    return total


def main_text(html: str) -> str:
    """Blocks of the main text, joined by line ends; empty if there is none."""
    parser, kept = read(html), frozenset()
    for turn in range(TRIES + 1):
        left = sum(len(b[0]) for b in parser.blocks)
        inside = summed(parser.wrapped, parser.around)
        wrapped = sum(n for n, up in zip(inside, parser.around, strict=True) if up < 0)
        if left >= LEAST * (left + wrapped) or not wrapped:
            break
        holds = [bool(n) for n in summed([int(x) for x in parser.article], parser.around)]
        large = [n > wrapped / 2 for n in inside]
        more = [c for c, yes in enumerate(holds if any(holds) else large) if yes and c not in kept]
        if not more:
            break
        kept |= set(more if any(holds) or turn == TRIES else more[:1])
        parser = read(html, kept)
    return chosen(parser)


def chosen(parser: Blocks) -> str:
    blocks = parser.blocks
    if not blocks:
        return ""
    chars = np.array([len(b[0]) for b in blocks])
    ratio = smoothed(chars / np.array([b[1] for b in blocks]))
    content = ratio >= min(ratio.std(), ratio.max())
    own, last = [0] * len(parser.tag_of), list(range(len(parser.tag_of)))
    for (_, _, c), n, on in zip(blocks, chars.tolist(), content.tolist(), strict=True):
        if on and c >= 0:
            own[c] += n
    weight = summed(own, parser.parent)
    for c in range(len(last) - 1, -1, -1):  # the last container begun inside
        if parser.parent[c] >= 0:
            last[parser.parent[c]] = max(last[parser.parent[c]], last[c])
    total = int(chars[content].sum())
    named = [c for c, n in enumerate(weight) if n and parser.tag_of[c] in ("article", "main")]
    if named:
        # the first of those with the most text: the outermost of nested ones, and articles beside it
        region = max(named, key=lambda c: (weight[c], -c))
        regions = [c for c in named if c == region or parser.tag_of[c] == parser.tag_of[region] == "article" and parser.parent[c] == parser.parent[region]]
    else:
        region = max((c for c, n in enumerate(weight) if n and n >= MOST * total), default=-1)
        regions = [region]
    if region >= 0 and parser.tag_of[region] not in ("html", "body"):
        return "\n".join(b[0] for b in blocks if any(r <= b[2] <= last[r] for r in regions))
    on = np.flatnonzero(content).tolist()
    keep = set(on)
    for a, b in zip(on[:-1], on[1:], strict=True):
        if b - a <= GAP + 1:
            keep.update(range(a, b))
    return "\n".join(b[0] for k, b in enumerate(blocks) if k in keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``df``.

    White space inside a block becomes one space (a line break too), character
    references are decoded, blocks are trimmed and joined by one line end.  A
    page that is null, empty or without content has an empty text and 0
    characters (code points).  Rows map one to one; null ids and urls stay; a
    cut-off page gives what it has; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            pages = batch.column(2)
            for lo, hi in chunks([n or 0 for n in pa.compute.binary_length(pages).to_pylist()]):
                texts = [main_text(x) for x in pages.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    import pyarrow.compute  # noqa: F401

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return in_batches(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
