"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text. Elements that are menus, forms, scripts and the like are left out by
name, others by the words of their class, id or role; lines in an article or main element are marked as certain. Text lengths
(links count nothing) are summed over sliding windows of lines; the text starts at the surge, where a sum first reaches a threshold,
and ends at the dive, after which no sum does. Certain lines reach the threshold by themselves, and count nothing in the sums of others.

A class that only holds such a word ("has-sidebar") may be that of a wrapper: its block stays if most of the page's text is in it.
Within an article, where titles have names such as "post-header", only adverts, reader comments, notices and sidebars go by name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the length of text at which a window belongs to the main text.
WINDOW, THRESHOLD = 3, 80

#: Elements whose content is no main text.
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe svg math canvas object button select textarea menu dialog head title audio video map datalist".split())
#: Elements whose content is text, not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split()
)
#: Words of class, id and role that name what is no main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer comment comments disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager search complementary contentinfo skip".split()
)
#: Of these, those that name foreign matter wherever they stand in a class, and those that within an article are no name of its own parts.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising adsense sponsored cookie cookies comment comments disqus".split())
#: Words that make a class a state of what surrounds the named thing.
STATES = frozenset("has no with without is open closed enabled disabled".split())
OF_ARTICLES = frozenset("header masthead banner main article social search reply skip".split())
_KEPT = frozenset(("html", "body", "main", "article"))
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def _named(attributes: str, in_article: bool) -> int:
    """Whether class, id and role, or an attribute that hides, tell that an element is no main text: 0 no, 1 perhaps (a wrapper may be named so), 2 yes."""
    if _HIDDEN.search(attributes):
        return 2
    found = 0
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            parts = [w.lower() for w in _WORD.findall(token)]
            state = not STATES.isdisjoint(parts)
            if not FOREIGN.isdisjoint(parts) and not state or token.lower() in NAMES and not (in_article and token.lower() in OF_ARTICLES):
                return 2
            if not in_article and not NAMES.isdisjoint(parts):
                found = 1
    return found


class _Lines:
    """Reads a page's markup once, from left to right; every step takes the same time however deep the elements are."""

    def __init__(self) -> None:
        #: text, characters outside of links, whether it is certain, number of the innermost named block
        self.found: list[tuple[str, int, bool, int]] = []
        #: of each block that is named, or an article: the one around it, and what _named says of it; 0 is the page
        self.around, self.named = [0], [0]
        self.text: list[str] = []
        self.plain = self.out_of = self.links = self.certain = 0
        #: open elements: name, whether it is left out, the block before it
        self.stack: list[tuple[str, bool, int]] = []
        self.open: dict[str, list[int]] = {}
        self.block = 0

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.found.append((line, self.plain, self.certain > 0, self.block))
        self.text.clear()
        self.plain = 0

    def add(self, piece: str) -> None:
        if piece and not self.out_of:
            piece = html.unescape(piece)
            self.text.append(piece)
            if not self.links:
                self.plain += len(piece.strip())

    def enter(self, name: str, left_out: bool, block: int) -> None:
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, left_out, self.block))
        self.out_of += left_out
        self.certain += name in ("article", "main")
        self.block = block

    def leave(self, name: str) -> None:
        """Closes the last open element of that name and all in it."""
        at = self.open.get(name)
        if not at:
            return
        for _ in range(len(self.stack) - at[-1]):
            n, left_out, self.block = self.stack.pop()
            self.open[n].pop()
            self.out_of -= left_out
            self.certain -= n in ("article", "main")

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.links = 1
        if name in INLINE:
            if name not in VOID and (name in LEFT_OUT or _named(attributes, self.certain > 0) == 2):
                self.enter(name, True, self.block)
            return
        self.end_line()
        if name in VOID or attributes.rstrip().endswith("/") and name in ("p", "div", "svg"):
            return
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == name:  # these end by themselves
            self.leave(name)
        article = name in ("article", "main")
        named = 0 if name in _KEPT else _named(attributes, self.certain > 0)
        block = self.block
        if named or article:
            block = len(self.around)
            self.around.append(self.block)
            self.named.append(named)
        self.enter(name, name in LEFT_OUT, block)
        if name == "article":
            self.links = 0

    def end(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name not in INLINE:
            self.end_line()
        self.leave(name)

    def read(self, page: str) -> None:
        at = 0
        while m := _TAG.search(page, at):
            self.add(page[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            elif m[1] or m[4]:
                self.end(name)
            elif name in RAW:
                end = re.compile(rf"</{name}\s*>?|\Z", re.IGNORECASE).search(page, at)
                if name not in LEFT_OUT:
                    self.add(page[at : end.start()])
                at = end.end() if end[0] else len(page)
                if end[0] and not end[0].endswith(">"):
                    at = (page.find(">", at) + 1) or len(page)
            else:
                self.start(name, m[3] or m[6] or "")
        self.add(page[at:])
        self.end_line()

    def kept(self) -> list[tuple[str, int, bool]]:
        """The lines but for those in named blocks that go: surely named ones with all in them, and others that don't hold most of the text, but for articles in them."""
        held, n = [0] * len(self.around), len(self.around)
        for _, plain, _, block in self.found:
            held[block] += plain
        for b in range(n - 1, 0, -1):  # a block's number is greater than that of the one around it
            held[self.around[b]] += held[b]
        sure, goes = [False] * n, [False] * n
        for b in range(1, n):
            sure[b] = self.named[b] == 2 or sure[self.around[b]]
            small = self.named[b] == 1 and 2 * held[b] <= held[0]
            article = not self.named[b]
            goes[b] = sure[b] or small or goes[self.around[b]] and not article
        return [(line, plain, certain) for line, plain, certain, b in self.found if not goes[b]]


def lines(page: str) -> list[tuple[str, int, bool]]:
    """The text of each block outside of what is left out, how much of it is no link, and whether it is certain."""
    reader = _Lines()
    reader.read(page)
    return reader.kept()


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """Blocks between the first surge and the last dive. Without a surge all blocks are kept that are not just links."""
    found = lines(page or "")
    weights = [0 if sure else plain for _, plain, sure in found]
    starts, ends = [], []
    total = 0
    for k, w in enumerate(weights):
        total += w - (weights[k - window] if k >= window else 0)
        if found[k][2]:
            starts.append(k)
            ends.append(k)
        if total >= threshold:
            of = [j for j in range(max(0, k - window + 1), k + 1) if weights[j]]
            starts.append(of[0])
            ends.append(of[-1])
    if not starts:
        return "\n".join(line for line, plain, _ in found if plain)
    return "\n".join(line for line, _, _ in found[min(starts) : max(ends) + 1])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(h) for h in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty html, and pages without main text, give an empty text. Rows are independent: null and repeated
    ids are kept as they are, null urls stay null, other columns are ignored whatever their names. Damaged and cut-off
    markup is read as far as it goes.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
