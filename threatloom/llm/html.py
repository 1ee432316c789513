"""Main-text extraction from web pages."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Standard deviation of the smoothing kernel, in lines.
SIGMA = 1.5
#: Characters that the parser is fed at once.
CHUNK = 1 << 18

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
DROPPED = frozenset(
    "head title script style noscript template nav aside form button select textarea iframe object embed svg canvas audio"
    " video dialog menu search footer datalist map math".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id names that mark menus, notices, adverts and reader comments.
DROPPED_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice banner popup modal overlay"
    " newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus"
    " replies reply respond widget toolbar pagination pager skip hidden copyright disclaimer".split())
#: Words that such a word may be combined with; a name with any other part (``has-sidebar``, ``no-comments``) marks nothing.
JOINED_WORDS = frozenset(
    "site page post posts article articles story entry content main global top bottom left right header head bar box list lists"
    " item items link links container wrapper wrap inner outer block section area panel row column col button buttons form"
    " message text title primary secondary mobile desktop slot unit".split())
#: Elements that are kept or left out as a whole where no article is declared.
CONTAINERS = frozenset("div section td th center".split())
_NAMES = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_TAG_START = re.compile(r"<[A-Za-z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "summary", "option", "optgroup", "tbody", "thead", "tfoot", "tr"}


class _Lines(HTMLParser):
    """Parser events to lines: ``[parts, tags, region, container, heading]`` for each block outside of dropped elements.

    A part is ``(text, link characters, mark)``; marks are elements whose names are those of menus, adverts and the like.
    What becomes of them is decided at the end of the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.parts: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, bool, str, int, int]] = []  # element, whether dropped, region, mark, container
        self.tags = self.links = 0
        self.mark_parent, self.mark_region, self.mark_inside = [0], [False], [False]
        self.container_parent = [0]

    def flush(self) -> None:
        if any(t and not t.isspace() for t, _, _ in self.parts):
            top = self.open[-1] if self.open else ("", False, "", 0, 0)
            heading = any(x[0] in ("h1", "h2") for x in self.open[-4:])
            self.lines.append([list(self.parts), max(1, self.tags), top[2], top[4], heading])
        self.parts.clear()
        self.tags = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # like browsers; the inherited form raises on unknown sections

    def close_to(self, k: int) -> None:
        while len(self.open) > k:
            self.links -= self.open.pop()[0] == "a"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        dropped = bool(self.open) and self.open[-1][1]
        if not dropped:
            self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACES:
            self.parts.append((" ", 0, self.open[-1][3] if self.open else 0))
        if tag in _ENDS_P:
            self.close_one({"p"})
        if tag in _CLOSED_BY:
            self.close_one(_CLOSED_BY[tag])
        if tag in VOID:
            return
        _, dropped, region, mark, container = self.open[-1] if self.open else ("", False, "", 0, 0)
        if not dropped:
            dropped = tag in DROPPED or tag == "header" and not region or self.hidden(tag, attrs)
        if not dropped and self.marked(tag, attrs):
            self.mark_parent.append(mark)
            self.mark_region.append(False)
            self.mark_inside.append(bool(region))
            mark = len(self.mark_parent) - 1
        if tag in ("article", "main") and not dropped and not region:
            self.mark_region[mark] = True
        if tag == "article" and not dropped:
            region = f"article{len(self.lines)}" if not region.startswith("article") else region
        elif tag == "main" and not region:
            region = "main"
        if tag in CONTAINERS and not dropped:
            self.container_parent.append(container)
            container = len(self.container_parent) - 1
        self.links += tag == "a"
        self.open.append((tag, dropped, region, mark, container))

    def marked(self, tag: str, attrs: list) -> bool:
        """Whether a class or id is a word of menus, adverts and the like, or a known compound of it."""
        if tag in ("html", "body", "main", "h1", "h2"):
            return False
        for name, value in attrs:
            if name in ("class", "id"):
                for token in (value or "").split():
                    parts = [w.lower() for w in _NAMES.split(token) if w]
                    if any(w in DROPPED_WORDS for w in parts) and all(w in DROPPED_WORDS or w in JOINED_WORDS for w in parts):
                        return True
        return False

    def hidden(self, tag: str, attrs: list) -> bool:
        """Whether role, style or the like drop an element; the page can't be."""
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            value = value or ""
            if name == "role" and value.strip().lower() in DROPPED_ROLES or name == "hidden":
                return True
            if name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return True
        return False

    def kept_lines(self) -> list[list]:
        """``[text, tags, link characters, region, container, heading]`` without the marked elements that are dropped.

        A marked element outside of articles stays if it holds over half of the page's text, or the only declared article.
        """
        n = len(self.mark_parent)
        size = [0] * n
        total, free = 0, False
        for parts, _, region, _, _ in self.lines:
            for text, _, mark in parts:
                size[mark] += len(text)
                total += len(text)
                free = free or bool(region) and not mark and not text.isspace()
        for m in range(n - 1, 0, -1):
            size[self.mark_parent[m]] += size[m]
            self.mark_region[self.mark_parent[m]] |= self.mark_region[m]
        dead = [False] * n
        for m in range(1, n):
            wraps = not self.mark_inside[m] and (2 * size[m] > total or self.mark_region[m] and not free)
            dead[m] = dead[self.mark_parent[m]] or not wraps
        out = []
        for parts, tags, *rest in self.lines:
            live = [p for p in parts if not dead[p[2]]]
            text = " ".join("".join(p[0] for p in live).split())
            if text:
                out.append([text, tags, sum(p[1] for p in live), *rest])
        return out

    def close_one(self, tags: set[str]) -> None:
        """Closes the innermost of these elements, unless a list, table or section was opened in it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self.close_to(k)
                return
            if self.open[k][0] in BLOCKS or self.open[k][1]:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not (self.open and self.open[-1][1]):
            self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_to(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.parts.append((data, len(data.strip()) if self.links else 0, self.open[-1][3] if self.open else 0))


def _smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing, the kernel renormalised at the ends; the running time is linear in the lines."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Boundary between two clusters of values (2-means from the extremes); the largest value is never below it."""
    low, high = min(values), max(values)
    cut = (low + high) / 2
    while True:
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(below) / len(below) + sum(above) / len(above)) / 2 if below and above else cut
        if abs(new - cut) < 1e-9:
            return cut
        cut = new


def _content(smooth: list[float], cut: float) -> list[bool]:
    """Lines of the upper cluster; all of them where the two clusters are not apart."""
    below, above = [v for v in smooth if v < cut], [v for v in smooth if v >= cut]
    if below and 2 * len(above) * sum(below) >= len(below) * sum(above):
        return [True] * len(smooth)
    return [v >= cut for v in smooth]


def _regions(lines: list[list], content: list[bool], parent: list[int]) -> list[int]:
    """Lines of the containers that hold content, each kept whole; in them, containers of mostly links are left out.

    Several containers with content make their common parent one. Links before the first and after the last other line
    go; a title that stands directly before, with the lines up to the text, comes along.
    """
    links, size = [0] * len(parent), [0] * len(parent)
    for text, _, link, _, at, _ in lines:
        links[at] += link
        size[at] += len(text)
    mostly = [2 * a > b for a, b in zip(links, size)]
    plain = [2 * line[2] <= len(line[0]) for line in lines]
    chosen = {line[4] for line, c, p in zip(lines, content, plain) if c and p}
    seen: dict[int, int] = {}
    for at in chosen - {0}:
        seen[parent[at]] = seen.get(parent[at], 0) + 1
    chosen |= {p for p, n in seen.items() if n > 1}
    inside = [c in chosen for c in range(len(parent))]
    for c in range(1, len(parent)):
        inside[c] = inside[c] or inside[parent[c]]
    keep = [i for i, line in enumerate(lines) if inside[line[4]] and (plain[i] or not mostly[line[4]])]
    while keep and not plain[keep[0]]:
        keep.pop(0)
    while keep and not plain[keep[-1]]:
        keep.pop()
    if keep:
        first = keep[0]
        while first and plain[first - 1]:
            first -= 1
        title = next((i for i in range(first, keep[0]) if lines[i][5]), keep[0])
        keep = [*range(title, keep[0]), *keep]
    return keep


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's blocks in page order, joined by blank lines."""
    if not html:
        return ""
    # a tag that the page's end cuts off is no text, as in browsers; searched once, since the parser would start anew at each <
    last = html.rfind(">") + 1
    cut_off = _TAG_START.search(html, last)
    html = html[:cut_off.start()] if cut_off else html
    parser = _Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at:at + CHUNK])
    parser.close()
    parser.flush()
    lines = parser.kept_lines()
    if not lines:
        return ""
    # text to tags: a link's text counts against a line like a tag
    ratio = [math.log1p(max(0, len(text) - links) / tags) for text, tags, links, *_ in lines]
    smooth = _smooth(ratio, sigma)
    cut = _threshold(smooth)
    regions: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        regions.setdefault(line[3], []).append(i)
    for kind in ("article", "main"):
        named = {r: own for r, own in regions.items() if r.startswith(kind)}
        if named:
            # a declared region is taken whole if lines of it are content; else the one with the most text
            chosen = [r for r, own in named.items() if any(smooth[i] >= cut for i in own)]
            chosen = chosen or [max(named, key=lambda r: sum(len(lines[i][0]) for i in named[r]))]
            keep = sorted(i for r in chosen for i in named[r])
            break
    else:
        keep = _regions(lines, _content(smooth, cut), parser.container_parent)
    return "\n\n".join(lines[i][0] for i in keep)


def with_main_text(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars", sigma: float = SIGMA) -> DataFrame:
    """``pages`` with the main text of ``html`` and its length in code points.

    The standard parser's events give lines (blocks); menus, forms, adverts, comments and the like are dropped by
    element, role and class. Each line's text-to-tag ratio is smoothed with a Gaussian over its neighbours, the values
    are clustered into content and rest, and the regions with content are kept whole: declared articles, or else the
    containers of content. NULL and empty pages, and pages without text, give an empty text; repeated rows count each;
    other columns stay, the names of the new ones are arguments. Rows are independent: no shuffle.
    """
    @F.pandas_udf("string")
    def extract(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, sigma) for x in values], dtype=object)

    return pages.withColumn(text, extract.asNondeterministic()(F.col(html))).withColumn(n_chars, F.length(text).cast("bigint"))
