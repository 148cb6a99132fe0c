"""Main text of web pages: the best contiguous region by scores of words and tags.

Words outside boilerplate elements score positive and tags negative, with weights from hand-labelled pages (log-odds of standing inside the
main text).  One linear scan finds the run of highest total score.  The run is then widened to whole blocks, and to the
element that closely holds it (article, main, section, td or div, never the body), so that a short heading or last line is not lost.

Left out are elements that are never main text by their tag.  Class words decide alone only outside an article or main: there elements with a
word of NEVER_WORDS in class, id or role go, unless they hold more of the page's words than all the rest or hold the longest article or main.
Inside an article or main only whole sections (SECTIONS) go: those with a word of INSIDE_WORDS, and those with another word of NEVER_WORDS
whose words are mostly links.  Elsewhere a list of links that no paragraph stands beside is a menu: it goes, and weighs nothing in the scan, so that
a region may reach over it.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from assetspan.llm._common import chunks
from assetspan.llm.html_pages import PAGES

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^<>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Never main text.  Annotations repeat a formula in another notation and aren't shown.
NEVER = set("nav aside form button menu head option annotation annotation-xml".split())
#: The page's own, unless they stand in the article; a footer only in a quotation.
NEVER_OUTSIDE = {"header", "dialog", "fieldset", "label"}
#: Words of boilerplate; wrappers of a whole page and articles have them too (with-sidebar, comments-open), so that they don't decide alone.
NEVER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets toolbar tabs pagination pager comment comments respond reply replies "
    "disqus discussion footer foot copyright masthead topbar share sharing social related recommended newsletter subscribe subscription signup login search skip contentinfo complementary".split()
)
#: Words that mark what a reader of the article is not meant to read as part of it.
INSIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup comment comments respond reply replies disqus popup modal".split()
)
SECTIONS = {"div", "section", "ul", "ol", "dl", "table", "article"}
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}
#: Share of an element's words in links from which on it is mostly links.
MOSTLY = 0.8
HOLDERS = {"article", "main", "section", "div", "td"}
IMPLIED_END = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SPACE = re.compile(r"\s+")


class Page:
    """Segments in page order: ("text", decoded text, dead, in a link) and ("tag", name, dead); elements with their extent.

    Tags inside a formula are all named math.
    """

    def __init__(self, source: str):
        self.parts: list[tuple] = []
        self.elements: list[list] = []  # [name, first part, last part, dead]
        marked: dict[int, int] = {}  # elements with a word of NEVER_WORDS, and the closest such element around each
        linked: set[int] = set()  # of these, those that go only if they are mostly links
        lists: list[tuple[int, int]] = []  # lists outside an article or main, and what they stand in
        texts: set[int] = set()  # elements in which a paragraph or heading stands
        open_ended: set[int] = set()
        stack: list[int] = []
        dead = links = holders = maths = at = 0

        def close(depth: int) -> None:
            nonlocal dead, links, holders, maths
            while len(stack) > depth:
                open_ended.add(stack[-1])
                e = self.elements[stack.pop()]
                e[2] = len(self.parts)
                dead -= e[3]
                links -= e[0] == "a"
                holders -= e[0] in ("article", "main")
                maths -= e[0] == "math"

        def text(raw: str) -> None:
            if raw:
                self.parts.append(("text", html.unescape(raw), dead > 0, links > 0))

        for m in TOKEN.finditer(source):
            text(source[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                if m["raw"]:
                    self.parts.append(("tag", m["raw"].lower(), True))
                continue
            if m["end"]:
                for depth in range(len(stack) - 1, -1, -1):
                    if self.elements[stack[depth]][0] == name:
                        self.parts.append(("tag", "/math" if maths else "/" + name, dead > 0))
                        i = stack[depth]
                        close(depth)
                        open_ended.discard(i)
                        break
                else:
                    self.parts.append(("tag", "/" + name, dead > 0))
                continue
            words = set(re.split(r"[^a-z0-9]+", " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(m["attrs"])).lower()))
            quoted = name == "footer" and any(self.elements[i][0] == "blockquote" for i in stack)
            never = name in NEVER or name == "footer" and not quoted or name in NEVER_OUTSIDE and not holders
            while stack and name in IMPLIED_END.get(self.elements[stack[-1]][0], ()):
                close(len(stack) - 1)
            if name in BLOCK and stack:  # inline elements left open inside a paragraph end with it
                depth = len(stack)
                while depth and self.elements[stack[depth - 1]][0] in ("b", "i", "em", "strong", "span", "u", "font", "small"):
                    depth -= 1
                if depth and self.elements[stack[depth - 1]][0] == "p" and name in IMPLIED_END["p"]:
                    close(depth - 1)
            maths += name == "math"
            self.parts.append(("tag", "math" if maths else name, dead > 0 or never))
            if name not in VOID:
                if words & NEVER_WORDS and name not in ("body", "html", "article", "main") and (not holders or name in SECTIONS):
                    marked[len(self.elements)] = next((i for i in reversed(stack) if i in marked), -1)
                    if holders and not words & INSIDE_WORDS:
                        linked.add(len(self.elements))
                if name in ("ul", "ol") and not holders and not dead:
                    lists.append((len(self.elements), stack[-1] if stack else -1))
                elif name in TEXTS and stack:
                    texts.add(stack[-1])
                stack.append(len(self.elements))
                self.elements.append([name, len(self.parts), len(self.parts), never])
                dead += never
                links += name == "a"
                holders += name in ("article", "main")
        text(source[at:])
        close(0)
        menus = {i for i, around in lists if around not in texts} if lists else set()
        if menus or linked:
            every, inner = [0], [0]
            for p in self.parts:
                n = count_words(p[1]) if p[0] == "text" else 0
                every.append(every[-1] + n)
                inner.append(inner[-1] + n * (n > 0 and p[3]))
            share = lambda i: (inner[self.elements[i][2]] - inner[self.elements[i][1]]) >= MOSTLY * (every[self.elements[i][2]] - every[self.elements[i][1]])
            menus = {i for i in menus if share(i)}
            for i in linked:
                if not share(i):
                    up = marked.pop(i)
                    marked.update({k: up for k, v in marked.items() if v == i})
        self.menus = [(self.elements[i][1], self.elements[i][2]) for i in sorted(menus)]
        if marked:
            self._cut(marked, open_ended)
        for a, b in self.menus:
            for i in range(a, b):
                p = self.parts[i]
                self.parts[i] = (p[0], p[1], True, *p[3:])

    def _cut(self, marked: dict[int, int], open_ended: set[int]) -> None:
        """Make dead the marked elements that hold at most half of the words, the smallest first; words in dead ones count no more."""
        upto = [0.0]
        for p in self.parts:
            upto.append(upto[-1] + (count_words(p[1]) * (0.25 if p[3] else 1.0) if p[0] == "text" and not p[2] else 0.0))
        held = lambda e: upto[e[2]] - upto[e[1]]
        named = [e for e in self.elements if e[0] in ("article", "main") and not e[3]]
        starts = [e[1] for e in named]
        for i in marked.keys() & open_ended:  # an advert or notice that was never closed does not hold the article
            e, k = self.elements[i], bisect_left(starts, self.elements[i][1])
            if k < len(starts) and starts[k] <= e[2]:
                e[2] = starts[k] - 1
        longest = [max((e for e in named if e[0] == n), key=held, default=None) for n in ("article", "main")]
        left, gone = upto[-1], dict.fromkeys([*marked, -1], 0.0)
        edges = [0] * (len(self.parts) + 1)
        for i in sorted(marked, key=lambda i: (held(self.elements[i]), -i)):
            e = self.elements[i]
            words = max(0.0, held(e) - gone[i])
            if 2 * words <= left and not any(x and e[1] <= x[1] and x[2] <= e[2] for x in longest):
                left -= words
                e[3] = True
                edges[e[1]] += 1
                edges[e[2]] -= 1
            gone[marked[i]] += held(e) if e[3] else gone[i]
        for i, depth in enumerate(accumulate(edges[:-1])):
            if depth:
                p = self.parts[i]
                self.parts[i] = (p[0], p[1], True, *p[3:])


def count_words(text: str) -> int:
    return len(text.split())


def learn(pages: list[str] = PAGES) -> dict[str, float]:
    """Weights: "word" positive, tags by name negative, "tag" for other tags."""
    inside, outside = Counter(), Counter()
    for p in pages:
        a, b = p.index("[["), p.index("]]")
        for part, into in ((p[a + 2 : b], inside), (p[:a] + p[b + 2 :], outside)):
            for kind, value, *_ in Page(part).parts:
                if kind == "text":
                    into["word"] += count_words(value)
                else:
                    into[value.lstrip("/")] += 1
    odds = {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in inside | outside}
    shift = math.log((sum(inside.values()) + 0.5) / (sum(outside.values()) + 0.5))
    weights = {k: -0.2 - max(0.0, shift - v) for k, v in odds.items() if k != "word"}
    return weights | {"word": max(0.5, odds["word"]), "tag": -0.5}


WEIGHTS = learn()


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the first run with the highest positive total; (0, 0) if none is positive."""
    best, total, start, out = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, out = total, (start, i + 1)
    return out


def main_text(source: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    if not source:
        return ""
    page = Page(source)
    scores = []
    for p in page.parts:
        if p[0] == "text":
            scores.append(0.0 if p[2] else weights["word"] * count_words(p[1]) * (0.25 if p[3] else 1.0))
        else:
            scores.append(0.0 if p[1].lstrip("/") == "math" else weights.get(p[1].lstrip("/"), weights["tag"]))
    for a, b in page.menus:
        scores[max(0, a - 1) : b + 1] = [0.0] * (min(len(scores), b + 1) - max(0, a - 1))
    start, end = best_run(scores)
    if start == end:
        return ""
    breaks = [p[0] == "tag" and p[1].lstrip("/") in BLOCK for p in page.parts]
    while start and not breaks[start - 1]:
        start -= 1
    while end < len(breaks) and not breaks[end]:
        end += 1
    words = [i for i in range(start, end) if page.parts[i][0] == "text" and not page.parts[i][2] and page.parts[i][1].strip()]
    first, last = words[0], words[-1]
    around = [e for e in page.elements if not e[3] and e[0] in HOLDERS and e[1] <= first and last < e[2]]
    if around:
        closest = min(around, key=lambda e: e[2] - e[1])
        named = [e for e in around if e[0] in ("article", "main")]
        _, start, end, _ = min(named, key=lambda e: e[2] - e[1]) if named else closest
    blocks, now = [], []
    for i in range(start, end):
        p = page.parts[i]
        if breaks[i]:
            blocks.append("".join(now))
            now = []
        elif p[0] == "text" and not p[2]:
            now.append(p[1])
        elif p[0] == "tag" and p[1] == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(b for b in (SPACE.sub(" ", x).strip() for x in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text (empty for null or empty html, or where no word is), n_chars.

    Other columns are ignored; repeated rows give repeated rows; an empty table gives an empty one.  Of runs and articles that tie the first counts.
    A page of any length is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html", 4 << 20):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
