"""Main text of web pages by line-block distribution.

Markup is stripped in one pass that turns a page into lines: one per block of text (white space collapsed, character
references decoded), with empty lines where containers end and where boilerplate elements stood (scripts, styles,
menus, page headers, footers, sidebars, notices, adverts, forms, reader comments, hidden parts), unless the text goes on
in the same container behind these. Text lengths are summed over a sliding window of lines. The text is what lies between surge points (a window rises to `surge`
characters) and the next dive point (a window falls to nothing), short lines inside included. If no window
surges, the page's densest stretch is its text. Where a page marks its article, its lines, all of them, are the text.

One narrow pass over whole pages, in time proportional to their length. Classes and ids count by their words: the last word names a
thing (`entry-footer` is a footer, `search-result-article` is not a search form), and what calls itself a post, article or content
is one, comments and adverts apart. Defined results: null, empty or text-free pages give an empty text; broken or unclosed
markup ends with its container; line breaks are white space, two in a row end a block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 80

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_HOLDS = frozenset("article aside body div fieldset footer form header main nav section table td ul ol".split())
_OUT = frozenset("nav footer aside form button select datalist dialog menu head svg canvas audio video object".split())
_ENDS = {"body": {"head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner menu nav navbar navigation
    breadcrumb breadcrumbs sidebar aside widget widgets footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe subscription signup login comment comments commentlist reply replies respond disqus related recommended recommendations share
    sharing social toolbar pagination pager search copyright disclaimer hidden""".split()
)
_HEAD_WORDS = frozenset("header masthead topbar".split())
#: What is never content, whatever else it is called: adverts and reader comments.
_NEVER = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion comment comments commentlist reply replies respond disqus".split())
#: Words that name what is to be kept, as a class of its own or as the last word of one; and words that make a class say something about others.
_CONTENT, _ABOUT = frozenset("article post entry content story main text".split()), frozenset("has with no without is js".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SAFE = frozenset("html body article main".split())


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _OUT or (tag == "header" and not inside):
        return True
    if not attrs or attrs.isspace():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body"):
            names = [x for c in value.split() if (x := [w for w in _SPLIT.split(c) if w])]
            own = any(len(x) == 1 and x[0] in _CONTENT for x in names) or tag in _SAFE  # it is content, whatever else it is called
            for x in names:
                found = set(x) & (_NEVER if own else _WORDS if inside else _WORDS | _HEAD_WORDS)
                if found and not (own and len(x) > 1) and x[-1] not in _CONTENT - _NEVER and not _ABOUT.intersection(x):
                    return True
    return False


def lines(page: str | None) -> list[tuple[str, bool]]:
    """The page's lines: text ('' for a gap) and whether it lies in a marked article."""
    out: list[tuple[str, bool]] = []
    within: list[int | None] = []  # of each line of `out`, its container; None for a gap where boilerplate stood, -1 for others
    holders, made = [0], 0  # open containers
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are boilerplate
    places: dict[str, list[int]] = {}  # of each tag, where it is open in the stack
    skip = inside = breaks = 0
    text: list[str] = []

    barriers = [-1]  # of open containers, where they stand in the stack

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def flush() -> None:
        nonlocal breaks
        breaks = 0
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, inside > 0))
                within.append(holders[-1])

    def gap() -> None:
        out.extend([("", False)] * WINDOW)
        within.extend([None] * WINDOW)

    def pop() -> None:
        nonlocal skip, inside
        tag, bad = stack.pop()
        places[tag].pop()
        if tag in _BLOCK and not skip:
            flush()
        inside -= tag in ("article", "main") and not bad
        if tag in _HOLDS:
            holders.pop()
            barriers.pop()
        if bad:
            skip -= 1
            if not skip:
                text.clear()
                gap()
        elif tag in _HOLDS and not skip:
            out.append(("", False))
            within.append(-1)

    page, at, end = page or "", 0, len(page or "")
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            if not skip:
                text.append(page[at:])
            break
        if not skip and m.start() > at:
            text.append(page[at : m.start()])
            if breaks and not page[at : m.start()].isspace():
                breaks = 0
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # end tag
            if places.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in ("p", "br") and not skip:
                flush()
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            breaks += 1
            if not skip:
                text.append(" ")
                if breaks > 1:
                    flush()
            continue
        if tag in _BLOCK:
            if not skip:
                flush()
            at_p, stop = last(("p", *_ENDS.get(tag, ()))), max(barriers[-1], last(_STOP.get(tag, ())))
            if at_p >= stop and at_p >= 0:  # an open paragraph ends here, as does an open item of the same kind
                while len(stack) > at_p:
                    pop()
        if tag in _VOID:
            continue
        bad = _boilerplate(tag, m[3], inside > 0)
        if bad:
            if not skip:
                flush()
                gap()
            skip += 1
        inside += tag in ("article", "main") and not bad
        if tag in _HOLDS:
            made += 1
            holders.append(made)
            barriers.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, bad))
    while stack:
        pop()
    flush()
    kept: list[tuple[str, bool]] = []
    last, gaps = None, 0  # the container before a run of boilerplate gaps, and the run's length
    for line, where in zip(out, within, strict=True):
        if where is None:
            gaps += 1
        else:
            if gaps and where == last and where >= 0:
                del kept[-gaps:]
            last, gaps = where, 0
        kept.append(line)
    return kept


def spans(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches of lines between a surge point and its dive point."""
    n = len(lengths)
    total = [sum(lengths[i : i + window]) for i in range(n)]
    level = min(surge, max(total, default=0))
    found, i = [], 0
    while i < n:
        if lengths[i] and level and total[i] >= level:
            start = i
            while start and lengths[start - 1]:  # the block's first, short lines
                start -= 1
            while i < n and total[i]:
                i += 1
            found.append((start, i))
        else:
            i += 1
    return found


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    rows = lines(page)
    if any(inside for text, inside in rows if text):
        return "\n".join(text for text, inside in rows if inside and text)
    lengths = [len(text) for text, _ in rows]
    return "\n".join(rows[i][0] for a, b in spans(lengths, window, surge) for i in range(a, b) if lengths[i])


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """One row per input row: the `keep` columns, text, n_chars."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([extract(x, window, surge) for x in s], dtype=object)

    rows = df.select(*[F.col(c) for c in keep], main_text(F.col(html_col)).alias("__text"))
    return rows.select(*keep, F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
