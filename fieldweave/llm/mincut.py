"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks (text between block-level tags). A classifier gives every block the cost
of calling it boilerplate and of calling it content; these are the capacities of its edges to the
two terminals. Neighbours in page order and blocks that hang near each other in the tree are joined
by smoothness edges, so a short block follows its surroundings. The maximum flow separates content
from boilerplate. The classifier is a fixed table of costs over the roles that enclosing tags and their
names state, link density, sentence marks and length; elements that never hold article text get an
unpayable cost. A name is only a hint: it has a finite cost, and an article or main element inside
overrides it. It learns nothing, so a page's result depends on the page alone.
"""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from fieldweave.llm.common import map_columns, texts

# HTML elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style head title noscript template svg math iframe object canvas audio video select textarea button option datalist".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = set("nav footer aside form menu dialog fieldset".split())
CONTENT = set("article main".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar"}
BAD_NAME = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|comments?|comment-?list|disqus|replies|widget|pagination|pager|tags?|copyright|legal|skip)(?:$|[-_\s])", re.I)
GOOD_NAME = re.compile(r"(?:^|[-_\s])(?:article|article-?body|content|main|main-?content|post|post-?body|entry|entry-?content|story|body|text)(?:$|[-_\s])", re.I)
#: Names of a page's layout ("with-sidebar", "page-no-footer") and of an article's own head; they say nothing bad.
PLAIN_NAME = re.compile(r"(?:^|(?<=\s))(?:(?:\S*[-_])?(?:no|with|without|has)[-_]\S+|(?:article|post|entry|story)[-_]{1,2}header)(?=$|\s)", re.I)
IN_HEAD = set("html head base basefont bgsound link meta title script style noscript template".split())
RAW = set("title script style noscript template".split())  # what stands in these does not end a head
SPACE = re.compile(r"\s+")
MARKS = re.compile(r"[.!?。！？](?:\s|$)")
NEVER = 1e6
ARTICLE, NAMED, GOOD = 6.0, -5.0, 4.0  # log-odds of elements and names


class Blocks(HTMLParser):
    """Blocks of a page: text, characters inside links, path of enclosing element numbers, role cost."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, float]] = []  # element, number, stated role
        self.number, self.links, self.silent = 0, 0, 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, int, tuple[int, ...], float, str]] = []

    def _end_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            kind = next((t for t, _, _ in reversed(self.open) if t not in INLINE), "")
            path = tuple(n for t, n, _ in self.open if t not in INLINE)
            self.blocks.append((text, self.linked, path, self._role(), kind))
        self.parts, self.linked = [], 0

    def _role(self) -> float:
        worst = best = 0.0
        for _, _, role in self.open:
            if role >= ARTICLE and worst > -NEVER:
                worst = 0.0  # names outside an article are overridden
            worst, best = min(worst, role), max(best, role)
        return worst or best

    def _stated(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        names = {k: v or "" for k, v in attrs}
        inside = any(t in CONTENT for t, _, _ in self.open)
        if tag in BOILERPLATE or names.get("role", "").lower() in ROLES or "hidden" in names or names.get("aria-hidden") == "true":
            return -NEVER
        if tag == "header":
            return 0.0 if inside else -NEVER
        named = f"{names.get('class', '')} {names.get('id', '')}"
        good, bad = GOOD_NAME.search(named), BAD_NAME.search(PLAIN_NAME.sub(" ", named))
        if tag in CONTENT or names.get("role", "").lower() in ("main", "article"):
            return NAMED if bad and not good else ARTICLE  # an article named a comment is one
        if tag in ("html", "body"):
            return 0.0
        return NAMED if bad else GOOD if good else 0.0

    def _leave_head(self) -> None:
        """An open head ends before what cannot stand in it, as its end tag may be left out."""
        for i, (t, _, _) in enumerate(self.open):
            if t == "head":
                if not any(x in RAW for x, _, _ in self.open[i:]):
                    self._cut(i)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent and tag not in IN_HEAD:
            self._leave_head()
        elif tag == "head" and any(t == "head" for t, _, _ in self.open):
            return
        if tag not in INLINE:
            self._end_block()
        if tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        elif tag == "li":
            self._close("li", {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close("dt", {"dl"})
            self._close("dd", {"dl"})
        elif tag in ("td", "th"):
            self._close("td", {"tr", "table"})
            self._close("th", {"tr", "table"})
        elif tag == "tr":
            self._close("tr", {"table"})
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        self.number += 1
        self.open.append((tag, self.number, self._stated(tag, attrs)))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash closes nothing but void elements

    def _close(self, tag: str, within: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._cut(i)
                return
            if self.open[i][0] in within:
                return

    def _cut(self, i: int) -> None:
        if any(t not in INLINE for t, _, _ in self.open[i:]):
            self._end_block()
        for t, _, _ in self.open[i:]:
            self.silent -= t in SILENT
            self.links -= t == "a"
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in INLINE and any(t not in INLINE for t, _, _ in self.open[i:]):
                    return  # a stray inline end tag closes no block
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        if self.silent and data.strip():
            self._leave_head()
        if not self.silent:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.links else 0


def read_blocks(html: str) -> list[tuple[str, int, tuple[int, ...], float, str]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser._end_block()
    return parser.blocks


def leaning(block: tuple[str, int, tuple[int, ...], float, str]) -> float:
    """Log-odds that the block is content."""
    text, linked, _, role, kind = block
    density = min(1.0, linked / max(1, len(text)))
    odds = role + 0.8 * min(4, len(MARKS.findall(text))) + min(3.0, len(text) / 80) - 6.0 * density - 1.5
    odds += {"p": 1.0, "blockquote": 1.0, "pre": 1.0, "h1": 1.0, "h2": 0.5, "h3": 0.5, "li": -1.0, "td": -0.5}.get(kind, 0.0)
    return odds - (2.0 if text.startswith(("©", "(c) ")) else 0.0)


def source_side(n: int, odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the content terminal in a minimum cut (levels and blocking flows)."""
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        join(source, i, x, 0.0) if x > 0 else join(i, sink, -x, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        next_edge, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while next_edge[a] < len(head[a]):
                e = head[a][next_edge[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                next_edge[a] += 1
            if next_edge[a] < len(head[a]):
                path.append(head[a][next_edge[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                next_edge[a] += 1
            else:
                break


def labelled(html: str, smooth: float = 1.0) -> list[tuple[str, bool]]:
    """Every block with text, in page order, and whether it is content."""
    blocks = read_blocks(html)
    edges, by_parent = [], {}
    for i, (_, _, path, _, _) in enumerate(blocks):
        if i:
            before = blocks[i - 1][2]
            common = next((k for k, (a, b) in enumerate(zip(before, path)) if a != b), min(len(before), len(path)))
            edges.append((i - 1, i, smooth / (1 + len(before) + len(path) - 2 * common)))
        parent = path[:-1]
        if parent in by_parent:
            edges.append((by_parent[parent], i, smooth / 2))
        by_parent[parent] = i
    keep = source_side(len(blocks), [leaning(b) for b in blocks], edges)
    return [(b[0], k) for b, k in zip(blocks, keep)]


def main_text(html: str) -> str:
    return "\n".join(text for text, kept in labelled(html) if kept)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds text (content blocks in page order, joined by a line feed) and n_chars (its code points).

    Null and empty pages give the empty text. Rows are kept as they are; input columns named text or
    n_chars are replaced. An empty table gives an empty table. A page is one task's work whatever its
    length; nothing is cut.
    """
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = [main_text(h) for h in texts(batch, html_col)]
        return {"text": out, "n_chars": [len(t) for t in out]}

    return map_columns(pages, run, text=T.StringType(), n_chars=T.LongType())


def extraction_report(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
