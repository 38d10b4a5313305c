"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events, in bounded parts. Events make lines, one per
block element, each with its text, the tags and the linked text on it, and the elements around it.
Scripts, styles, controls and hidden elements never make a line. Lines within menus, footers, sidebars,
forms, adverts, notices and comments are marked, by element or by a word of a class, id or role that
isn't about a state ("has-sidebar", "comments-open").

A line's text-to-tag ratio is the length of its text over its tags. The ratios are smoothed by a
Gaussian over the neighbouring lines, and lines above the threshold, the ratios' standard deviation
or the mean if that is less, are the content cluster. Where all of a page's cluster is marked by a name
or element that also wraps whole pages, that mark isn't believed.

The cluster chooses the region: the articles (or else the main elements) that hold some of it, whole, so
that an article's short paragraphs stay. Without either it is the innermost element around the cluster,
from which lines go that are outside the cluster and unlike it: links, what stands before and after and
isn't a heading or a paragraph beside the cluster's own, and copyright lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.plans.lineage import ship

_PART = 1 << 20
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without text of their own for a reader.
_NEVER = frozenset("script style noscript template head title dialog button select option textarea input iframe object svg canvas audio video map datalist".split())
#: Elements that mark their lines as something else; those of _WRAPS may wrap whole pages.
_MARKS = frozenset("nav footer aside form menu label fieldset search".split())
_WRAPS = frozenset("form fieldset aside label".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that end an open element of these kinds, up to the nearest of the bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}
#: Words of a class, id or role that mark an element: of what never wraps a page, and of what may.
_SURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors cookie cookies consent gdpr popup popups modal modals "
    "comment comments commentlist disqus replies respond responses breadcrumb breadcrumbs footer contentinfo navbar pagination pager".split()
)
_LIKELY = frozenset(
    "promo promos promotion promotions banner banners notice notices notification notifications alert alerts overlay overlays sidebar sidebars sidenav menu menus nav navs "
    "navigation toolbar toolbars header masthead share sharing social related recommend recommended recommendations newsletter subscribe subscription signup login "
    "widget widgets skip complementary search".split()
)
#: Words that make a name one of a state or layout, or of the article's own heading.
_STATES = frozenset("no not non without with has have having is are open opened closed close enabled disabled enable disable allowed on off layout hide hidden show shown active single two three".split())
_OWN = frozenset("post entry article story content blog section chapter".split())
_WORD = re.compile(r"[a-z]+|[0-9]+")
_COPYRIGHT = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
#: Elements of running text.
_RUNNING = frozenset("p li dd dt blockquote pre td th figcaption caption".split())


def name_mark(value: str) -> str:
    """What a class, id or role says of an element: "sure" or "likely" to be something else than the article, or ""."""
    found = ""
    for token in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower().split():
        words = set(_WORD.findall(token))
        joined = words | {token.replace("-", "").replace("_", "")}
        if words & _STATES or words & {"header"} and words & _OWN:
            continue
        if joined & _SURE:
            return "sure"
        if joined & _LIKELY:
            found = "likely"
    return found


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, str]] = []  # tag, number, mark: never, sure, likely or none
        self.made = 0
        self.lines: list[tuple[str, int, int, tuple[tuple[str, int], ...], tuple[str, ...]]] = []  # text, tags, linked characters, elements around, marks
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.hidden = self.links = 0  # open elements without lines, open links

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, tuple((tag, number) for tag, number, _ in self.open), tuple(mark for _, _, mark in self.open if mark)))
            self.tags = self.linked = 0
        self.text.clear()

    def _pop(self, to: int) -> None:
        self.hidden -= sum(mark == "never" for _, _, mark in self.open[to:])
        self.links -= sum(tag == "a" for tag, _, _ in self.open[to:])
        del self.open[to:]

    def _mark(self, tag: str, attributes: list[tuple[str, str | None]]) -> str:
        if tag in _NEVER or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attributes):
            return "never"
        if tag in ("html", "body") or tag in _HEADINGS:
            return ""
        if tag in _MARKS:
            return "likely" if tag in _WRAPS else "sure"
        if tag == "header":  # a page's header; an article's own holds its heading
            return "" if any(t in ("article", "main") for t, _, _ in self.open) else "likely"
        marks = {name_mark(v) for k, v in attributes if k in ("class", "id", "role") and v}
        if tag in ("article", "main"):
            marks.discard("likely")
        return "sure" if "sure" in marks else "likely" if "likely" in marks else ""

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self._end_line()
            kinds, bounds = _ENDS.get(tag, ({"p"}, set()))
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in kinds:
                    self._pop(k)
                    break
                if self.open[k][0] in bounds or not kinds - {"p"} and self.open[k][0] in _BLOCKS:
                    break
        self.tags += not self.hidden
        if tag == "br":
            self.text.append(" ")
        if tag not in _VOID:
            mark = self._mark(tag, attributes)
            if mark and tag not in _BLOCKS:
                mark = "never"  # a marked part of a line
            self.open.append((tag, self.made, mark))
            self.hidden += mark == "never"
            self.links += tag == "a"
            self.made += 1

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in _BLOCKS:
                    self._end_line()
                self._pop(k)
                break
            if tag not in _BLOCKS and self.open[k][0] in _BLOCKS:
                break  # an inline element's end doesn't reach beyond its block
        self.tags += not self.hidden

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, with the kernel renormalised at the ends."""
    reach = max(1, round(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    spread = lambda v: np.convolve(v, kernel, "full")[reach : reach + len(v)]
    return spread(ratios) / spread(np.ones(len(ratios)))


def page_lines(html: str | None) -> list[tuple[str, int, int, tuple[tuple[str, int], ...], tuple[str, ...]]]:
    """(text, tags, linked characters, elements around from the outside in, marks) of every line of a page."""
    page = _Page()
    for k in range(0, len(html or ""), _PART):
        page.feed(html[k : k + _PART])
    page.close()
    page._end_line()
    return page.lines


def content_lines(lines, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Which lines the smoothed text-to-tag ratios put into the content cluster, and which of these are above the threshold by themselves."""
    ratios = np.array([len(line[0]) / max(1, line[1]) for line in lines], float)
    if not len(ratios):
        return np.zeros(0, bool), np.zeros(0, bool)
    threshold = min(ratios.std(), ratios.mean())
    content = smoothed(ratios, sigma) >= threshold
    return content, content & (ratios >= threshold)


def believed(lines, sigma: float) -> list:
    """The lines that count as unmarked: those without a mark, or, if the whole cluster has marks, with marks that whole pages may have."""
    free = [line for line in lines if not line[4]]
    if any(tag in ("article", "main") for line in free for tag, _ in line[3]):
        return free
    content, alone = content_lines(lines, sigma)
    if any(is_content and not line[4] for line, is_content in zip(lines, alone)):
        return free
    wrapped = [line for line in lines if "sure" not in line[4]]
    return wrapped if sum(is_content and "sure" not in line[4] for line, is_content in zip(lines, alone)) > 1 else free


def select_region(lines, content: np.ndarray, alone: np.ndarray) -> list[str]:
    """The texts of the region that the content lines choose, in page order."""
    around = [line[3] for line in lines]
    for kind in ("article", "main"):
        outer = [next((number for tag, number in path if tag == kind), None) for path in around]
        chosen = {number for number, is_content in zip(outer, content) if is_content and number is not None}
        if chosen:
            return [line[0] for line, number in zip(lines, outer) if number in chosen]
    linked = [2 * line[2] > len(line[0]) for line in lines]
    core = [k for k in range(len(lines)) if alone[k] and not linked[k]] or [k for k in range(len(lines)) if content[k] and not linked[k]]
    if not core:
        return []
    first = around[core[0]]
    shared = 0
    while all(len(around[k]) > shared + 1 and around[k][shared] == first[shared] for k in core):
        shared += 1
    beside = {(around[k][:-1], around[k][-1][0] if around[k] else "") for k in core}
    parents = {parent for parent, _ in beside}

    def stays(k: int) -> bool:
        text, path = lines[k][0], around[k]
        tag = path[-1][0] if path else ""
        if linked[k] and (tag not in _HEADINGS or not core[0] < k < core[-1]):
            return False
        if core[0] <= k <= core[-1] or any(t in _HEADINGS for t, _ in path) and k < core[0]:
            return True
        if _COPYRIGHT.match(text):
            return False
        return (path[:-1], tag) in beside or tag in _RUNNING and (path[:-1] in parents or tag == "li" and path[:-2] in parents)

    return [lines[k][0] for k in range(len(lines)) if around[k][:shared] == first[:shared] and stays(k)]


def main_text(html: str | None, sigma: float = 1.0) -> tuple[str, int, int]:
    """(text, lines, lines of the content cluster) of a page; its blocks are joined by empty lines."""
    lines = believed(page_lines(html), sigma)
    content, alone = content_lines(lines, sigma)
    return "\n\n".join(select_region(lines, content, alone)), len(lines), int(content.sum())


def extract(df: DataFrame, keep: list[str], html: str = "html", sigma: float = 1.0) -> DataFrame:
    """Columns ``keep`` of df with text, n_lines and n_content_lines of every page, from its whole html.

    Null and empty html, and pages without text outside of what is marked as something else, give an
    empty text. Rows are independent: repeated pages get the same text, an empty table no rows.
    """
    ship(df.sparkSession)
    keep = [c for c in keep if c.lower() not in ("text", "n_lines", "n_content_lines")]  # the new columns replace these
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))
    schema = source.drop("__html").withColumns({"text": F.lit("").cast("string"), "n_lines": F.lit(0).cast("long"), "n_content_lines": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                made = [main_text(x.as_py(), sigma) for x in batch.column(len(keep))]
                columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "text", "n_lines", "n_content_lines"])

    return source.mapInArrow(run, schema)
