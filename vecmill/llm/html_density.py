"""Main text of web pages by composite text density.

A lenient parser builds the element tree of the whole page (void elements, implied ends
of p, li, td and the like, raw text of script and style, pages cut off anywhere). Parts
that aren't text of the article by their element, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, comments) are left out. A class or id names such a part
if its head word does: the last one but for words of layout and for what follows has, with
or no. An element so named stays if it holds an article or main, or if the greatest density
sum is in it and is ten times the greatest outside such elements, or more. For every other
element the composite density is

    C / T * log(C / LC * T / LT, base ln(C / nLC * LC + LCb / Cb * C + e))

with C characters, T tags, LC link characters, nLC other characters, LT link tags, of the
subtree, and Cb, LCb of the body (Sun, Song and Liao, "DOM based content extraction via
text density"). An element's density sum is that of its children; the greatest sum names
the subtree of the text, raised to the container that it belongs to. The least density on
the path from there to the body is the threshold by which siblings along the path belong
to the text, too, if links don't make up half of them. Where no article or main holds the
text, so do siblings of less density that have paragraphs or headings and no link at all,
such as a short lead or a closing line in an element of its own.

Blocks are the runs of text between block-level tags. A null or empty page has the text "".
Each row is a page of its own, repeated ids and all; ids and urls may be null, an empty table
gives no rows, and columns but the named ones are left out, whatever they are called.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, text_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("script style noscript template iframe object embed svg canvas nav footer aside form button select option textarea input dialog menu head title noembed noframes xmp plaintext audio video map figure_ad".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body html blockquote center".split())
#: A start tag ends these open elements, up to one of the barriers.
ENDS = {t: frozenset({"p"}) for t in BLOCK if t not in ("body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend")}
ENDS |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
ENDS |= {t: frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "p"}) for t in ("tbody", "thead", "tfoot")}
BARRIER = frozenset("table ul ol dl body html article section div main aside nav form blockquote td th button select header footer".split())
BARRIERS = {"tr": frozenset({"table"}), "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"}), "tbody": frozenset({"table"}), "thead": frozenset({"table"}), "tfoot": frozenset({"table"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion comment comments disqus reply replies respond sidebar sidenav nav navbar navigation menu topbar masthead breadcrumb breadcrumbs pagination pager footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar skip copyright".split()
)
#: Words of layout at a name's end: the word before says what it is.
LAYOUT = frozenset("area bar block bottom box button buttons cell col column container wrapper wrap group holder inner outer item items layout left right top list panel row section slot unit zone".split())
BESIDE = frozenset("has with without no not".split())
MUCH = 10.0
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
#: One attribute after another, so that values and longer names are never taken for attributes.
ATTR = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'|=\s*[^\s"'>]*""", re.S)
WANTED = re.compile("class|id|role|hidden|style", re.I)
END = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in RAW}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
INSIDE = frozenset({"article", "main"})


def _head(name: str) -> str:
    """What a class or id calls its element: "sidebar" for left-sidebar and sidebar-box, "page" for page-with-sidebar."""
    words = [w for w in SPLIT.split(CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
    for i, w in enumerate(words):
        if w in BESIDE:
            words = words[:i]
            break
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return words[-1] if words else ""


def _noise(tag: str, attrs: str, inside: bool) -> int:
    """2 if an element is no part of any article by its kind, role or hiding, 1 if by its class or id, else 0."""
    if tag in DROPPED or tag == "header" and not inside:
        return 2
    if not attrs or tag in ("body", "html") or not WANTED.search(attrs):
        return 0
    named = 0
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return 2
        if name == "role" and value.lower() in ROLES:
            return 2
        if name in ("class", "id") and tag not in INSIDE:
            for one in value.split():
                head = _head(one)
                if head in NOISE or not inside and head == "header":
                    named = 1
    return named


class Page:
    """Elements in document order as parallel lists; element 0 is the root."""

    def __init__(self, html: str):
        self.tag, self.parent, self.chars, self.links, self.tags, self.link_tags = ["#"], [-1], [0], [0], [0], [0]
        #: text runs (element, text) and None where a block ends
        self.runs: list[tuple[int, str] | None] = []
        #: elements that their names call noise
        self.named: list[int] = []
        self.out: list[bool] = []
        self._parse(html)

    def _add(self, tag: str, parent: int) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.chars, 0), (self.links, 0), (self.tags, 0), (self.link_tags, 0)):
            column.append(value)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack = [(0, "#", False, False, False)]  # element, tag, dropped, inside of article, inside of link
        at, size = 0, len(html)
        search, runs = TAG.search, self.runs
        while at < size:
            m = search(html, at)
            if m is None:
                self._text(html[at:], stack[-1])
                break
            if m.start() > at:
                self._text(html[at : m.start()], stack[-1])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), stack[-1])
                continue
            tag = name.lower()
            if m[1] or m[4]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == tag:
                        if tag in BLOCK or any(s[1] in BLOCK for s in stack[i:]):
                            runs.append(None)
                        del stack[i:]
                        break
                else:
                    if tag in BLOCK:
                        runs.append(None)
                continue
            ends = ENDS.get(tag)
            if ends:
                barrier = BARRIERS.get(tag, BARRIER)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] in ends:
                        del stack[i:]
                        if tag not in ("li", "tr", "td", "th", "dt", "dd", "tbody", "thead", "tfoot"):
                            break
                    elif stack[i][1] in barrier:
                        break
            if tag in BLOCK:
                runs.append(None)
            top = stack[-1]
            attrs = m[3] or m[6] or ""
            inside = top[3] or tag in INSIDE
            noise = 2 if top[2] else _noise(tag, attrs, top[3])
            dropped = noise == 2
            if tag == "br":
                self._text(" ", top)
            if dropped:
                i = top[0]
            else:
                i = self._add(tag, top[0])
                if noise:
                    self.named.append(i)
            if tag in RAW and not attrs.endswith("/"):
                end = END[tag].search(html, at)
                close = html.find(">", end.end()) if end else -1
                at = size if close < 0 else close + 1
            elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
                stack.append((i, tag, dropped, inside, top[4] or tag == "a"))

    def _text(self, raw: str, top: tuple) -> None:
        if top[2]:
            return
        text = unescape(raw) if "&" in raw else raw
        self.runs.append((top[0], text))
        n = len(SPACE.sub(" ", text).strip())
        self.chars[top[0]] += n
        if top[4]:
            self.links[top[0]] += n

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and density sum of each element; those that are out have none."""
        n, out = len(self.tag), self.out
        if out:
            for column in (self.chars, self.links):
                column[:] = [0 if o else v for v, o in zip(column, out)]
        for i in range(n - 1, 0, -1):
            if out and out[i]:
                continue
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.links[p] += self.links[i]
            self.tags[p] += self.tags[i] + 1
            self.link_tags[p] += self.link_tags[i] + (self.tag[i] == "a")
        body_chars, body_links = max(1, self.chars[0]), self.links[0]
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c = self.chars[i]
            if c:
                t, lc, lt = max(1, self.tags[i]), max(1, self.links[i]), max(1, self.link_tags[i])
                base = math.log(c / max(1, c - self.links[i]) * lc + body_links / body_chars * c + math.e)
                density[i] = max(0.0, c / t * math.log(c / lc * t / lt) / math.log(base)) if base > 1.0 else c / t
            if i and not (out and out[i]):
                sums[self.parent[i]] += density[i]
        return density, sums

    def under(self, named: list[int]) -> list[bool]:
        """Which elements are among the named or below one."""
        out = [False] * len(self.tag)
        for i in named:
            out[i] = True
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def decide(self) -> None:
        """Marks as out what is below elements named as noise that hold no article."""
        if not self.named:
            return
        holds = [False] * len(self.tag)
        for i in range(len(holds) - 1, 0, -1):
            if holds[i] or self.tag[i] in INSIDE:
                holds[self.parent[i]] = True
        named = [i for i in self.named if not holds[i]]
        own = [column[:] for column in (self.chars, self.links, self.tags, self.link_tags)]
        _, sums = self.densities()
        self.chars, self.links, self.tags, self.link_tags = own
        out = self.under(named)
        best = max(range(len(sums)), key=lambda i: (sums[i] if out[i] else -1.0, -i))
        if out[best] and self._outside(out) * MUCH <= sums[best]:
            up, above = best, set()
            while up > 0:
                above.add(up)
                up = self.parent[up]
            named = [i for i in named if i not in above]
            out = self.under(named)
        self.out = out

    def _outside(self, out: list[bool]) -> float:
        """The greatest density sum without what is out."""
        own = [column[:] for column in (self.chars, self.links, self.tags, self.link_tags)]
        self.out = out
        _, sums = self.densities()
        self.out = []
        self.chars, self.links, self.tags, self.link_tags = own
        return max(s for s, o in zip(sums, out) if not o)

    def content(self) -> list[bool]:
        """Which elements are in the text."""
        self.decide()
        density, sums = self.densities()
        n, out = len(self.tag), self.out or [False] * len(self.tag)
        inside = [False] * n
        if not self.chars[0]:
            return inside
        best = max(range(n), key=lambda i: (sums[i], density[i], -i))
        up, lifted = best, None
        while up > 0:
            if self.tag[up] in INSIDE:
                lifted = up
            up = self.parent[up]
        if lifted is None:
            lifted = best
            while lifted > 0 and self.tag[lifted] not in CONTAINER:
                lifted = self.parent[lifted]
        path, up = {lifted}, lifted
        threshold = density[lifted]
        while up > 0:
            up = self.parent[up]
            path.add(up)
            if self.tag[up] in CONTAINER:
                threshold = min(threshold, density[up])
        path.discard(lifted)
        prose = [False] * n  # what else may be of a text that no article or main holds: paragraphs without links
        if self.tag[lifted] not in INSIDE:
            for i in range(n - 1, 0, -1):
                prose[i] = (prose[i] or self.tag[i] in PROSE) and self.chars[i] > 0
                prose[self.parent[i]] |= prose[i]
        for i in range(n):
            p = self.parent[i]
            inside[i] = not out[i] and (i == lifted or p >= 0 and inside[p] or i not in path and p in path and (density[i] >= threshold and 2 * self.links[i] < self.chars[i] or prose[i] and not self.links[i]))
        return inside

    def text(self) -> str:
        inside, blocks, now = self.content(), [], []
        for run in self.runs:
            if run is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif inside[run[0]]:
                now.append(run[1])
        if now:
            blocks.append("".join(now))
        return "\n\n".join(b for b in (SPACE.sub(" ", b).strip() for b in blocks) if b)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame, html_col: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """op10: the columns, text and n_chars (code points) of every page. No shuffle."""

    text_batches(pages.sparkSession)
    body = max(columns, key=len, default="") + "_"

    def run(batches):
        release()
        for b in slices(batches, 64):
            texts = [main_text(h) for h in b[body].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*columns, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return pages.select(*columns, F.col(html_col).alias(body)).mapInArrow(run, f"{schema}, text string, n_chars long")
