"""Main text of web pages by tree scoring.

A page becomes a tree. Navigation, adverts, forms, comments and the like are set aside by element, role
and class, but no element for its name alone that holds the article or most of the page. Each remaining paragraph passes points for its length and commas to its ancestors, fewer
with each level; a container's points are discounted by the share of its text that is links. The
best container is kept, with siblings that score near it or read like its paragraphs; where it is in no
article or main, with all sibling blocks whose text isn't links, however short.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import numbered, unclashed
from .words import release

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
JUNK = frozenset("head script style title noscript template nav footer aside form button select option textarea input iframe object embed applet svg canvas math audio video map dialog menu noembed noframes xmp datalist".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "topnav sidenav subnav mainnav submenu copyright newsletter subscribe subscription signup comment comments disqus reply replies respond discussion sidebar aside widget widgets related recommended recommendations outbrain taboola "
    "share sharing social breadcrumb breadcrumbs menu nav navbar navigation topbar footer header masthead pagination pager toolbar login search skip hidden paywall".split()
)
GOOD_NAMES = frozenset("article body content entry main post story text blog".split())
SAFE = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of the named kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_LI = frozenset("ul ol menu dir dl table".split())
CLOSES_P = BLOCK - frozenset("html body caption legend option tbody td tfoot th thead tr select frameset summary".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIBLING_SHARE, DEPTH = 0.2, 5


class Page:
    """The tree of one page: nodes in page order (parents first) and text pieces with the node that holds each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.junk, self.named, self.weight, self.link = ["#root"], [0], [False], [False], [0], [False]
        self.pieces: list[tuple[int, str]] = []
        stack, open_tags = [0], {}
        at = 0
        n = len(source)

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                t = self.tag[stack.pop()]
                open_tags[t] -= 1
                if t in BLOCK:
                    self.pieces.append((stack[-1], "\n"))

        def close(name: str, barrier: frozenset = frozenset()) -> None:
            if open_tags.get(name):
                for d in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[d]]
                    if t == name:
                        pop_to(d)
                        return
                    if t in barrier:
                        return

        while at < n:
            m = _TOKEN.search(source, at)
            begin = m.start() if m else n
            if begin > at:
                self.pieces.append((stack[-1], html.unescape(source[at:begin])))
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if name in ("p", "br"):
                    self.pieces.append((stack[-1], "\n"))
                close(name)
                continue
            if name == "br" or name == "hr":
                self.pieces.append((stack[-1], "\n"))
            if name in VOID:
                continue
            if name in CLOSES_P:
                close("p", KEEPS_LI | {"td", "th", "button"})
            for other in CLOSES.get(name, ()):
                close(other, KEEPS_LI)
            if name in ("html", "body") and open_tags.get(name):
                continue
            node = len(self.tag)
            up = stack[-1]
            junk, named, weight = self._judge(name, m.group(3) or "", up)
            self.tag.append(name)
            self.parent.append(up)
            self.junk.append(self.junk[up] or junk)
            self.named.append(named)
            self.weight.append(weight)
            self.link.append(self.link[up] or name == "a")
            if name in BLOCK:
                self.pieces.append((up, "\n"))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if (m.group(3) or "").endswith("/") and name in ("svg", "path", "math"):
                continue
            stack.append(node)
            open_tags[name] = open_tags.get(name, 0) + 1

    def _judge(self, name: str, attrs: str, up: int) -> tuple[bool, bool, int]:
        """Whether an element is set aside, whether its names speak for that, and their weight."""
        if name in JUNK:
            return True, False, 0
        in_header = self.tag[up] == "header"
        if name == "header":
            x = up
            while x and self.tag[x] not in ("article", "main"):
                x = self.parent[x]
            if not x:
                return True, False, 0
        elif in_header and name not in HEADINGS and name not in ("hgroup", "div"):
            return True, False, 0
        if not attrs or attrs.isspace():
            return False, False, 0
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        if name in SAFE:
            first = {_SPLIT.split(x)[0] for x in (found.get("class", "") + " " + found.get("id", "")).lower().split()}
            return False, bool(first & JUNK_NAMES), 25 if name in ("article", "main") else 0  # such as a comment's article
        if "hidden" in found or found.get("role", "").lower() in JUNK_ROLES or "display:none" in found.get("style", "").replace(" ", "").lower():
            return True, False, 0
        if name in HEADINGS or name in ("a", "p", "span", "b", "i", "em", "strong"):
            names = set(found.get("class", "").lower().split())  # whole class names only, for elements of text
        else:
            names = set(_SPLIT.split(_HUMP.sub(" ", found.get("class", "") + " " + found.get("id", "")).lower()))
        return False, bool(names & JUNK_NAMES), 25 if names & GOOD_NAMES else 0

    def _set_aside(self) -> None:
        """Sets aside what is named like junk, outermost first, but no element whose loss would be the page's.

        If no article or main lies outside such names, an element stays that holds one, or that holds most of the page's
        paragraph points while well-named containers outside have less than a quarter of its. Articles and mains
        are never set aside by their own names, but one whose name begins like junk (a comment's) doesn't count here.
        """
        if not any(self.named):
            return
        n = len(self.tag)
        points, articles = self._points(), [0] * n
        within = [False] * n  # in or at an element named like junk
        good = [False] * n  # in or at an article, main or well-named container outside those
        outside_points, outside_article = 0.0, False
        for x in range(1, n):
            up = self.parent[x]
            within[x] = within[up] or self.named[x]
            real = self.tag[x] in ("article", "main") and not self.junk[x] and not self.named[x]
            articles[x] = int(real)
            good[x] = not within[x] and not self.junk[x] and (good[up] or real or self.weight[x] > 0)
            outside_points += points[x] * good[x]
        for x in range(n - 1, 0, -1):
            up = self.parent[x]
            points[up] += points[x]
            articles[up] += articles[x]
        for x in range(1, n):
            outside_article = outside_article or self.tag[x] in ("article", "main") and good[x] and points[x] > 0
        for x in range(1, n):
            if self.junk[self.parent[x]]:
                self.junk[x] = True
            elif self.named[x] and self.tag[x] not in SAFE and not self.junk[x]:
                most = 2 * points[x] > points[0] and outside_points < points[x] / 4
                self.junk[x] = outside_article or not (points[x] > 0 and (articles[x] or most))

    def _points(self) -> list[float]:
        """Each block's own points as a paragraph; for what isn't set aside."""
        n = len(self.tag)
        size, links, commas, block = [0] * n, [0] * n, [0] * n, [0] * n
        for x in range(1, n):
            block[x] = x if self.tag[x] in BLOCK else block[self.parent[x]]
        for x, t in self.pieces:
            if not self.junk[x] and (length := len(" ".join(t.split()))):
                b = block[x]
                size[b] += length
                commas[b] += t.count(",") + t.count("，") + t.count("、")
                links[b] += length * self.link[x]
        return [(1 + c + min((s - k) / 100, 3)) * (1 - k / s) if s > k else 0.0 for s, k, c in zip(size, links, commas)]

    def main_text(self) -> str:
        self._set_aside()
        best, also = self._container()
        if best is None:
            return ""
        keep = [False] * len(self.tag)
        keep[best] = True
        for x in also:
            keep[x] = True
        for x in range(1, len(self.tag)):
            keep[x] = (keep[x] or keep[self.parent[x]]) and not self.junk[x]
        return " ".join("".join(t for x, t in self.pieces if keep[x] or t == "\n").split())

    def _container(self) -> tuple[int | None, list[int]]:
        n = len(self.tag)
        size, links, commas = [0] * n, [0] * n, [0] * n
        has_block = [False] * n
        block = [0] * n
        for x in range(1, n):
            block[x] = x if self.tag[x] in BLOCK else block[self.parent[x]]
            if self.tag[x] in BLOCK and not self.junk[x]:
                has_block[block[self.parent[x]]] = True
        for x, t in self.pieces:
            if not self.junk[x] and (length := len(" ".join(t.split()))):
                b = block[x]
                size[b] += length
                commas[b] += t.count(",") + t.count("，") + t.count("、")
                if self.link[x]:
                    links[b] += length
        score: dict[int, float] = {}
        for b in range(n):
            if size[b] <= links[b]:
                continue
            points = (1 + commas[b] + min((size[b] - links[b]) / 100, 3)) * (1 - links[b] / size[b])
            x = b if has_block[b] or b == 0 else self.parent[b]
            for level in range(DEPTH):
                if x not in score:
                    score[x] = self.weight[x] + {"div": 5, "article": 8, "main": 8, "td": 3, "pre": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "th": -5}.get(self.tag[x], 0)
                score[x] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                if x == 0:
                    break
                x = self.parent[x]
        if not score:
            return None, []
        whole, linked = size[:], links[:]
        for x in range(n - 1, 0, -1):
            whole[self.parent[x]] += whole[x]
            linked[self.parent[x]] += linked[x]
        density = lambda x: linked[x] / whole[x] if whole[x] else 0.0
        final = {x: s * (1 - density(x)) for x, s in score.items()}
        best = min(final, key=lambda x: (-final[x], x))
        x = best
        while x and self.tag[x] not in ("article", "main"):
            x = self.parent[x]
        whole_article = bool(x)
        if whole_article:
            best = x  # the whole of the article that it lies in
        also = []
        if best:
            for x in range(1, n):
                if x != best and self.parent[x] == self.parent[best] and not self.junk[x]:
                    near = final.get(x, 0.0) >= max(10.0, SIBLING_SHARE * final.get(best, 0.0))
                    reads = self.tag[x] == "p" and whole[x] > 80 and density(x) < 0.25
                    part = not whole_article and self.tag[x] in BLOCK and whole[x] > 0 and density(x) < 0.25
                    if near or reads or part:
                        also.append(x)
        return best, also


def main_text(source: str | None) -> str:
    """The main text of one page; '' for null, empty or text-free pages."""
    return Page(source).main_text() if source else ""


def extract(df: DataFrame, html_column: str = "html") -> DataFrame:
    """df with main_text: blocks in page order, white space as single spaces.

    The whole page is read, nothing is capped. A null or empty page, and one without a paragraph
    outside the parts set aside, gives ''. Broken mark-up is closed as browsers do it roughly. Repeated
    rows are each extracted; an empty table gives an empty one; an input column main_text comes
    out as main_text_in.
    """
    rows, own = numbered(df)

    @arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        out = pa.array([main_text(x.as_py()) for x in pages], pa.string())
        release()
        return out

    return rows.withColumn("main_text", texts(F.col(f"in_{own.index(html_column)}"))).toDF(*unclashed(own, ["main_text"]), "main_text")
