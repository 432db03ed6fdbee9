"""Main text of web pages from the events of the standard library's HTML parser.

The parser's events give lines: the text of one block, the number of tags met
since the line before, whether menus, forms, adverts and the like surround
it, and the containers it stands in. A line's text-to-tag ratio is smoothed
over its neighbours with a Gaussian; lines above a share of the page's mean
form clusters. Clusters say which container holds the content: the `article`
(or else `main`) elements that they touch, or without those the innermost
container with most of the clusters' text. All lines of that container that
nothing excluded surrounds are the text, short ones too.

White space inside a block becomes one space, blocks are joined by a line
break. Defined cases: null or empty html, or a page with nothing but excluded
parts, gives an empty text; a tag that the end of the page cuts off is not
text; unclosed elements end with their container; repeated rows repeat; other
columns are not read; pages may have any length.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from redpen.llm.tables import map_slices

SIGMA = 1.0
#: A smoothed ratio counts from this share of the page's mean on.
THRESHOLD = 0.5
#: A container holds the content if it has this share of the clusters' text.
MOST = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p"
    " pre script search section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
EXCLUDED_TAGS = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form frameset head iframe input label legend math"
    " menu nav noscript object option script search select style svg template textarea title video".split()
)
EXCLUDED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split()
)
#: Parts of class names and ids that mark something else than the article.
EXCLUDED_NAMES = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byads comment"
    " commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu"
    " modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion"
    " recommended related reply replies respond rail share sharebar sharing sidebar signup skiplink social sponsor"
    " sponsored subscribe subscription toolbar topbar widget".split()
)
LANDMARKS = ("article", "main")
#: Elements that can hold a page's content; paragraphs, headings and items only hold text.
CONTAINERS = frozenset("article blockquote body center div main section table td".split())
_NEVER = frozenset(("html", "body", "main"))
_PARTS = re.compile(r"[a-z0-9]+")
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


class _Element:
    __slots__ = ("tag", "excluded", "number", "landmarks")

    def __init__(self, tag: str, excluded: bool, number: int, landmarks: tuple):
        self.tag, self.excluded, self.number, self.landmarks = tag, excluded, number, landmarks


class Reader(HTMLParser):
    """Lines of a page: (text, tags, excluded, container numbers, landmarks)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, tuple[int, ...], tuple]] = []
        self.open: list[_Element] = []
        self.text: list[str] = []
        self.tags = self.count = 0

    def _excludes(self, tag: str, attributes, landmarks: tuple) -> bool:
        if tag in EXCLUDED_TAGS or tag == "header" and not landmarks:
            return True
        if tag in _NEVER:
            return False
        for name, value in attributes:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if not value:
                continue
            if name in ("class", "id"):
                if not EXCLUDED_NAMES.isdisjoint(_PARTS.findall(value.lower())):
                    return True
            elif name == "role":
                if value.lower() in EXCLUDED_ROLES:
                    return True
            elif name == "style" and "display:none" in value.lower().replace(" ", ""):
                return True
        return False

    def handle_starttag(self, tag, attributes):
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if tag == "li":
                self._close("li", ("ul", "ol", "menu", "dir"))
            elif tag in ("dd", "dt"):
                self._close("dd", ("dl",)) or self._close("dt", ("dl",))
            elif tag in ("td", "th", "tr"):
                self._close("td", ("tr", "table")) or self._close("th", ("tr", "table"))
                if tag == "tr":
                    self._close("tr", ("table", "tbody", "thead", "tfoot"))
            else:
                self._close("p", ("article", "body", "div", "li", "main", "section", "td"))
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        self.count += 1
        above = self.open[-1] if self.open else None
        landmarks = above.landmarks if above else ()
        excluded = bool(above and above.excluded) or self._excludes(tag, attributes, landmarks)
        if tag in LANDMARKS and not excluded:
            landmarks = (*landmarks, (tag, self.count))
        if above and above.excluded != excluded and self.text:
            self._end_line()
        self.open.append(_Element(tag, excluded, self.count, landmarks))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._end_line()
        self._close(tag, LANDMARKS if tag not in LANDMARKS else ())

    def _close(self, tag: str, stop: tuple[str, ...]) -> bool:
        """End the innermost open ``tag`` and what is open inside it, unless a ``stop`` lies between."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                if self.open[at].excluded != (at > 0 and self.open[at - 1].excluded):
                    self._end_line()
                del self.open[at:]
                return True
            if self.open[at].tag in stop:
                return False
        return False

    def handle_data(self, data):
        self.text.append(data)

    def _end_line(self):
        if not self.text:
            return
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if line:
            above = self.open[-1] if self.open else None
            excluded = bool(above and above.excluded)
            path = () if excluded else tuple(e.number for e in self.open if e.tag in CONTAINERS)
            self.lines.append((line, self.tags, excluded, path, above.landmarks if above else ()))
            self.tags = 0

    def finish(self):
        self.close()
        self._end_line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Weighted means over neighbours up to three sigma away; at the ends over those that exist."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(reach + 1)]
    out = []
    for at in range(len(values)):
        low, high = max(0, at - reach), min(len(values), at + reach + 1)
        own = [weights[abs(i - at)] for i in range(low, high)]
        out.append(sum(w * v for w, v in zip(own, values[low:high])) / sum(own))
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = Reader()
    cut = _CUT_TAG.search(html, max(0, html.rfind("<")))
    reader.feed(html[: cut.start()] if cut else html)
    lines = reader.finish()
    if all(line[2] for line in lines):
        return ""
    ratios = smoothed([0.0 if excluded else len(text) / max(1, tags) for text, tags, excluded, _, _ in lines])
    least = THRESHOLD * sum(ratios) / len(ratios)
    clustered = [line for line, ratio in zip(lines, ratios) if not line[2] and ratio >= least]
    usable = [line for line in lines if not line[2]]
    for kind in LANDMARKS:
        inside = [(line, next((n for t, n in line[4] if t == kind), None)) for line in usable]
        if any(n is not None for _, n in inside):
            touched = {n for line in clustered for t, n in line[4] if t == kind}
            return "\n".join(line[0] for line, n in inside if n is not None and (n in touched or not touched))
    weight: dict[int, int] = {}
    for text, _, _, path, _ in clustered or usable:
        for number in path:
            weight[number] = weight.get(number, 0) + len(text)
    whole = sum(len(line[0]) for line in clustered or usable)
    # Containers are numbered in the order they open, so the last large one is the innermost.
    holder = max((n for n, w in weight.items() if w >= MOST * whole), default=None)
    return "\n".join(line[0] for line in usable if holder is None or holder in line[3])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, ``text`` and ``n_chars``, its number of code points. Narrow: no shuffle."""

    def make():
        def run(keys, urls, sources):
            texts = [main_text(source.as_py()) for source in sources]
            yield {key: keys, url: urls, "text": texts, "n_chars": [len(text) for text in texts]}

        return run

    kind = pages.schema[key].dataType.simpleString()
    return map_slices(pages, [key, url, html], make, f"`{key}` {kind}, `{url}` string, text string, n_chars long", 256)
