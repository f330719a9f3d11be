"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements that may hold others and must be closed; a missing end tag ends with the parent.
_CONTAINER = frozenset("article aside body details dialog div dl fieldset figure footer form head header main menu nav ol search section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILERPLATE = frozenset("aside dialog footer form head header menu nav search fieldset".split())
#: Words that name boilerplate wherever they stand in a class name or id.
_SURE = frozenset(
    "ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu "
    "modal nav navbar navigation newsletter pagination paywall popup sidebar signup sponsored subscribe subscription".split()
)
#: Words that name it alone or beside words of layout; beside others ("related-work", "share-price") the links in the element decide.
_MAYBE = frozenset(
    "banner header notice notices notification promo promoted promotion recommended related replies reply respond share sharing skip social sponsor toolbar widget".split()
)
_LAYOUT = frozenset("area bar block bottom box button buttons container content global items left link links list main page posts right section site top wrap wrapper".split())
#: A name that begins so says that something else exists, or does not.
_ELSEWHERE = frozenset("has hide is no not show with without".split())
#: Characters outside links up to which an element is never the page's layout.
_LITTLE = 400
_OF_ARTICLE = frozenset("article content entry page post story".split())
#: Comments, scripts and styles run to the end of the page if nothing closes them; other elements that show no text are
#: left out only up to their own end tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|iframe|select|textarea|canvas|audio|video)(?=[\s/>])[^>]*(?<!/)>[^<]*+(?:<(?!/?\2[\s/>])[^<]*+)*+</\2\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Line(NamedTuple):
    text: str
    own: int  #: characters outside links; none if they are few
    bad: bool  #: of a menu, header, footer, advert and the like
    inside: bool  #: of an article
    heading: bool


def named(attributes: str, inside: bool) -> int:
    """What the names of an element say: 0 nothing, 1 that it may be boilerplate, 2 that it is."""
    out = 0
    for kind, *values in _NAMES.findall(attributes):
        value = "".join(values)
        for token in [value] if kind.lower() == "aria-label" else value.split():
            parts = [w.lower() for w in _PARTS.findall(token)]
            if not parts or parts[0] in _ELSEWHERE or (inside and "header" in parts and not _OF_ARTICLE.isdisjoint(parts)):
                continue
            if not _SURE.isdisjoint(parts):
                return 2
            if not _MAYBE.isdisjoint(parts):
                out = max(out, 2 if all(w in _MAYBE or w in _LAYOUT for w in parts) else 1)
    return out


def lines(page: str) -> list[Line]:
    """The blocks of a page, in page order.

    An element is boilerplate by its tag or by its names. Names alone never
    condemn an element that holds more than half of the page's text outside links
    (and over 400 characters of it), and doubtful ones only an element half of whose
    characters are links.
    """
    found: list[tuple[str, int, int, tuple[int, ...], bool, bool]] = []  # text, linked, own, marks, inside, heading
    text: list[str] = []
    stack: list[tuple[str, tuple[int, ...], bool]] = []  # tag, marks (0: by its tag), inside
    doubts: list[int] = [0]  # of each mark, what named() says
    linked = link = at = 0
    heading = False

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                marks, inside = (stack[-1][1], stack[-1][2]) if stack else ((), False)
                own = len(line) - linked
                found.append((line, min(linked, len(line)), own if 4 * own >= len(line) else 0, marks, inside, heading))  # a little between links is none
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(part := page[at : m.start()])
            if link:
                linked += len(part)
        at = m.end()
        tag = m[4]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m[3] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in _BLOCK:
            flush()
            heading = not m[3] and tag in _HEADINGS
            if tag in _CONTAINER:
                if m[3]:
                    if any(s[0] == tag for s in stack):
                        while stack.pop()[0] != tag:
                            pass
                elif not m[5].rstrip().endswith("/"):
                    _, marks, inside = stack[-1] if stack else ("", (), False)
                    if tag in ("article", "main", "body"):
                        if tag != "body" and marks and not any(s[2] for s in stack):
                            marks = ()  # a menu or advert that was never closed
                        inside = inside or tag != "body"
                    elif tag in _BOILERPLATE and not (tag == "header" and inside):
                        marks = (*marks, 0)
                    elif m[5]:
                        says = 2 if _HIDDEN.search(m[5]) else named(m[5], inside)
                        if says:
                            marks = (*marks, len(doubts))
                            doubts.append(says)
                    stack.append((tag, marks, inside))
    if at < len(page):
        text.append(page[at:])
    flush()
    size, links, own_ = ([0] * len(doubts) for _ in range(3))
    whole = 0
    for line, in_links, own, marks, _, _ in found:
        whole += 0 if 0 in marks else own
        for k in marks:
            size[k] += len(line)
            links[k] += in_links
            own_[k] += own
    kept = {k for k, says in enumerate(doubts) if k and (own_[k] > max(whole / 2, _LITTLE) or (says == 1 and 2 * links[k] < size[k]))}
    return [Line(line, own, not kept.issuperset(marks), inside, head) for line, _, own, marks, inside, head in found]


def weights(rows: list[Line]) -> list[int]:
    """The weight of each line in the text distribution.

    Its characters outside links. Markup is a weight as well: where a page says
    which part is its article (``<article>``, ``<main>``), all characters of a line
    inside count, twice, and those of other lines do not.
    """
    if any(r.inside for r in rows):
        return [2 * len(r.text) if r.inside else 0 for r in rows]
    return [r.own for r in rows]


def text_runs(weight: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(start, end) of every stretch of text: from a surge point to the next dive point.

    A line surges if it weighs and the sum of the weights in the window that it
    begins reaches ``surge``; text dives at the first line whose window holds
    nothing. If no window of the page reaches ``surge``, half of its largest one
    has to do, so that short pages have text too.
    """
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    n = len(weight)
    sums = [total[min(i + window, n)] - total[i] for i in range(n)]
    most = max(sums, default=0)
    need = surge if most >= surge else max(1, most / 2)
    out: list[tuple[int, int]] = []
    start = None
    for i in range(n):
        if start is None:
            if weight[i] and sums[i] >= need:
                start = i
        elif not sums[i]:
            out.append((start, i))
            start = None
    return out if start is None else [*out, (start, n)]


def with_openings(rows: list[Line], weight: list[int], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``runs`` with the light lines that stand directly before them: inside an article all that weigh, elsewhere those from a heading on."""
    out: list[tuple[int, int]] = []
    for start, end in runs:
        least = out[-1][1] if out else 0
        k = first = start
        while k > least and weight[k - 1]:
            k -= 1
            if rows[k].inside or rows[k].heading:
                first = k
        out.append((first, end))
    return out


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The blocks between surge and dive points of a page's text distribution, joined by newlines.

    Menus, headers, footers, adverts and the like, which :func:`lines` tells by
    their elements, names and links, are taken out first. Between a surge and the
    next dive every other block stays, however short or full of links.
    """
    rows = [r for r in lines(page or "") if not r.bad]
    weight = weights(rows)
    runs = with_openings(rows, weight, text_runs(weight, window, surge))
    return "\n".join(r.text for i, j in runs for r in rows[i:j])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null or empty page, or one without main text, gives ''. Character
    references are decoded and white space inside a block is one space. Repeated
    rows and null page_ids each give a row; other columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        extract, "page_id long, url string, text string, n_chars long"
    )
