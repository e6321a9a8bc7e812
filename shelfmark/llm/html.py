"""Main text of web pages by text-to-tag ratios.

Parser events of the standard library become lines, one for each block of text, with the tags seen
around it. Lines that a menu, header, footer, sidebar, notice, advert, form, script, style or reader
comments hold, by tag, role, class or id, go. The ratio of text outside links to tags of each line is
smoothed by a Gaussian, and two-means on its logarithm tells content from the rest. The region is the
element with the greatest share of the content less its share of the rest; the name of an article adds
a vote to that and decides nothing alone. It is widened to a heading beside it. In it content lines and
headings stay; a line with a low ratio goes if links make it up, and, in an element that isn't named
as the article, unless it is a paragraph, list item or cell in line with content. So short paragraphs
stay. The time grows with the number of tags, however deep they are, and with
the length of what isn't closed.

Edge cases: a null, empty or textless page gives an empty text; text outside any element is a block;
broken and unclosed markup, of any depth and length, is read as far as it goes; repeated rows and ties
are extracted each; a null page_id or url is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never content.
_NEVER = frozenset("script style noscript template head title svg canvas iframe object form nav footer aside menu dialog button select option textarea label fieldset math audio video map".split())
_BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset("article main".split())
#: Blocks that hold a line of text, not an article.
_LEAVES = frozenset("p li td th tr dt dd pre blockquote figcaption caption summary".split())
#: Words of class or id that name what isn't the article.
_OTHER = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar aside rail menu submenu nav navbar navigation navigational breadcrumb breadcrumbs footer foot cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond replies reply related recommended recommendations widget widgets search toolbar pagination pager masthead topbar copyright disclaimer skip hidden".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar note form".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_COMMENT_END, _SECTION, _SECTION_END, _OFFICE_END, _TAG_END = map(re.compile, (r"--\s*>", r"<!\[\s*([A-Za-z]*)", r"\]\s*\]\s*>", r"\]\s*>", ">"))
_CLOSES_P = _BLOCKS - frozenset(["html", "body"])


class _Lines(HTMLParser):
    """Lines as (text, tags, link characters, element); an element has its tag, its parent, the nearest
    block around it, and whether it may be something other than the article (OTHER, or a HEADER). Each
    tag costs the same however deep it stands."""

    OTHER, HEADER = 1, 2

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.block, self.soft = [""], [0], [0], [0]
        self.open = [0]
        self.opened: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, int]] = []
        self.never = self.tags = self.link_chars = 0
        self.buffer: list[str] = []
        self.endless: dict[re.Pattern, int] = {}

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def read(self, html: str) -> None:
        """Feed a whole page. After the last > no tag can end, so all that follows is text; the parser
        would search every < of it to the end."""
        cut = html.rfind(">") + 1
        self.feed(html[:cut])
        self.close()
        if not self.cdata_elem:
            self.handle_data(unescape(html[cut:]))
        self.flush()

    def _ends(self, mark: re.Pattern, i: int) -> int:
        """The end of the next mark from i on, or -1. Where none was found, none is sought again."""
        left = len(self.rawdata) - i
        if left <= self.endless.get(mark, -1):
            return -1
        found = mark.search(self.rawdata, i)
        if found:
            return found.end()
        self.endless[mark] = left
        return -1

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._ends(_COMMENT_END, i + 4)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        name = _SECTION.match(self.rawdata, i)[1].lower()
        if name in ("temp", "cdata", "ignore", "include", "rcdata"):
            return self._ends(_SECTION_END, i + 3)
        return self._ends(_OFFICE_END if name in ("if", "else", "endif") else _TAG_END, i + 3)

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.lines.append((text, self.tags, self.link_chars, self.open[-1]))
            self.tags = 0
        self.buffer, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self.flush()
        if tag in _VOID:
            if tag in ("br", "hr"):
                self.buffer.append(" ")
            return
        if tag in _CLOSES_P:
            self._close("p", upto=_CLOSES_P - {"p"})
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, upto=frozenset(["ul", "ol", "dl", "table", "select", "menu"]))
        own, above = len(self.tag), self.open[-1]
        self.tag.append(tag)
        self.parent.append(above)
        self.block.append(own if tag in _BLOCKS else self.block[above])
        self.soft.append(self._softness(tag, attrs))
        self.open.append(own)
        self.opened[tag] += 1
        self.never += tag in _NEVER

    def _softness(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if attrs and tag not in ("html", "body", "a"):
            a = dict(attrs)
            words = {w.lower() for c in ("class", "id") for w in _SPLIT.split(a.get(c) or "")}
            if words & _OTHER or (a.get("role") or "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style") or ""):
                return self.OTHER
        return self.HEADER if tag == "header" else 0

    def _pop(self) -> None:
        tag = self.tag[self.open.pop()]
        self.opened[tag] -= 1
        self.never -= tag in _NEVER

    def _close(self, tag: str, upto: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1) if self.opened[tag] else ():
            name = self.tag[self.open[k]]
            if name == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if name in upto or name in _NEVER:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self.flush()
        if tag in _VOID or not self.opened[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if tag not in _BLOCKS and name in _BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.buffer.append(data)
            if self.opened["a"]:
                self.link_chars += len(data.strip())


#: What an element's name adds to its share of the content, and what the share of other text takes off.
VOTES, REST = {"article": 0.25, "main": 0.1}, 0.5


def smoothed(ratio: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian smoothing; the ends are held."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, r, "edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """The middle between the two means that part the values best."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        a, b = values[values <= cut], values[values > cut]
        if not len(b) or not len(a):
            break
        old, low, high = (low, high), float(a.mean()), float(b.mean())
        if (low, high) == old:
            break
    return (low + high) / 2


def main_text(html: str | None) -> str:
    p = _Lines()
    p.read(html or "")
    if not p.lines:
        return ""
    n, tag, parent = len(p.tag), p.tag, p.parent
    own = [tag[p.block[e]] for _, _, _, e in p.lines]

    def summed(lines: Iterable[tuple[int, float]]) -> list[float]:
        """The sums of (element, value) over each element and those in it."""
        out = [0.0] * n
        for e, v in lines:
            out[e] += v
        for i in range(n - 1, 0, -1):
            out[parent[i]] += out[i]
        return out

    text = summed((x[3], len(x[0])) for x in p.lines)
    heads = summed((x[3], own[k] in _HEADS) for k, x in enumerate(p.lines))
    mains = summed((i, tag[i] in _MAIN) for i in range(1, n))
    # an element that holds an article, or most of the text and a heading, is a wrapper, whatever its name says
    other, header, in_main = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        soft = 0 if mains[i] else p.soft[i]
        other[i] = other[parent[i]] or (soft == p.OTHER and not (text[i] >= 0.7 * text[0] and heads[i]))
        header[i] = header[parent[i]] or soft == p.HEADER
        in_main[i] = in_main[parent[i]] or tag[i] in _MAIN
    usable = [(x, o) for x, o in zip(p.lines, own, strict=True) if not other[x[3]] and (not header[x[3]] or (o in _HEADS and in_main[x[3]]))]
    if not usable:
        return ""
    size = np.array([len(x[0]) for x, _ in usable], float)
    ratio = np.array([(len(x[0]) - min(x[2], len(x[0]))) / max(1, x[1]) for x, _ in usable])
    score = np.log1p(smoothed(ratio))
    linked = np.array([x[2] > 0 and 2 * x[2] >= len(x[0].replace(" ", "")) for x, _ in usable])
    # smoothing lifts a line of links that stands beside the article; no paragraph or item, it goes by its own ratio
    loose = linked & np.array([o not in _LEAVES and o not in _HEADS for _, o in usable]) & (np.log1p(ratio) < threshold(score))
    content = (score >= threshold(score)) & ~loose
    mass = summed((x[3], s) for (x, _), s, c in zip(usable, size, content, strict=True) if c)
    whole = summed((x[3], s) for (x, _), s in zip(usable, size, strict=True))
    # the region that the clusters choose: most of the content, little of the rest; a name only votes
    total, all_text = max(mass[0], 1.0), max(whole[0], 1.0)

    def worth(i: int) -> float:
        return mass[i] / total - REST * (whole[i] - mass[i]) / all_text + VOTES.get(tag[i], 0.0)

    chosen = max((i for i in range(1, n) if tag[i] in _BLOCKS and tag[i] not in _LEAVES and tag[i] not in _HEADS and mass[i]), key=lambda i: (worth(i), i), default=0)
    named = tag[chosen] in _MAIN
    # the heading beside the region belongs to it
    while not named and chosen and tag[parent[chosen]] not in ("", "html") and heads[parent[chosen]] > heads[chosen] == 0:
        chosen = parent[chosen]
    inside, beside = [False] * n, set()
    inside[chosen] = True
    for i in range(chosen + 1, n):
        inside[i] = inside[parent[i]]
    for (x, _), c in zip(usable, content, strict=True):
        if c:
            beside.add(parent[p.block[x[3]]])
    out = []
    for (x, o), c, links in zip(usable, content, linked, strict=True):
        text_of, _, _, e = x
        if not inside[e]:
            continue
        if not c and o not in _HEADS:
            # of the lines with a low ratio those go that links make up, and where no element is named as
            # the article also those that don't stand in line with content
            if links:
                continue
            if not named and (o not in _LEAVES or parent[p.block[e]] not in beside):
                continue
        out.append(text_of)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
