"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import bounded_batches

#: Lines of a sliding window, and the characters that a window must hold at a surge point.
WINDOW_LINES = 3
SURGE_CHARS = 40

# Every part takes what it can and gives nothing back, and only values in quotes reach beyond a
# "<", so a page is read in one pass however malformed it is. A tag without ">" ends at the next "<".
_VALUES = r"""=\s*+"[^"]*+"|=\s*+'[^']*+'"""
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<!\[CDATA\[(?:.*?\]\]>|.*+)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|head|textarea|select|canvas|audio|video)\b(?:" + _VALUES + r"|[^<>/]|/(?!>))*+"
    r"(?:/>|(?=<)|>.*?(?:</\1\s*+>|(?=<body\b)|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:" + _VALUES + r"|[^<>])*+)(?:>|(?=<)|\Z)"
    r"|<[!?/][^<>]*+(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPTIONAL_END = frozenset("p li dt dd tr td th option".split())
_CONTAINERS = frozenset(("article", "main"))
_DROPPED = frozenset("nav header footer aside form button menu dialog label fieldset datalist output progress".split())
_BANDS = frozenset("nav header footer".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: First words of a class that tell about the page and not about the element: has-sidebar, no-comments.
_STATE = frozenset("has have with without no is not".split())
#: Words that only tell what kind of element a class is for: share-buttons, related-posts.
_PARTS = frozenset(
    "area articles aside bar block body bottom box button buttons card cards cell col column container content count feed group head heading "
    "icon icons info inline inner item items label left line link links list main message more outer panel popular post posts right row section "
    "slot spot stories strip text thread title top unit us widget wrap wrapper zone".split()
)
_NOT_MAIN = re.compile(
    r"(?:ads?|adsense|adslot|advert\w*|adverts?|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notifications?|alert|"
    r"popup|modal|overlay|newsletter|subscri\w+|signup|login|share|sharing|social|sidebar|side|rail|menus?|nav|navbar|"
    r"navigation|breadcrumbs?|topbar|footer|foot|header|masthead|comments?|disqus|respond|reply|replies|reactions?|related|"
    r"recommend\w*|widget\w*|pagination|pager|skip|toolbar|search|form|disclaimer|copyright|legal|tags|teaser|outbrain|taboola)"
)


def _is_hidden(attributes: str) -> bool:
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _is_dropped(name: str, attributes: str, in_container: bool) -> bool:
    if name in _DROPPED and not (name == "header" and in_container):
        return True
    if not attributes or name in ("body", "html"):
        return False
    if _is_hidden(attributes):
        return True
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and name != "main":
            tokens = [[w.lower() for w in _WORD.findall(token)] for token in value.split()]
            tokens = [token for token in tokens if token and token[0] not in _STATE]
            if in_container:  # a heading's words, as in search-algorithms or side-effects, drop nothing
                tokens = [token for token in tokens if all(w in _PARTS or _NOT_MAIN.fullmatch(w) for w in token)]
            if any(_NOT_MAIN.fullmatch(w) for token in tokens for w in token) and not (name in ("h1", "h2", "p") and key == "id"):
                return True
    return False


def _wrappers(page: str) -> frozenset[int]:
    """Places of the elements that would be dropped though each holds more than half of the page's
    text; text in links and in hidden elements does not count."""
    total = in_links = in_hidden = 0
    open_elements: list[tuple[str, int, int, bool]] = []  # name, place or -1, text before, hidden
    depth: dict[str, int] = {}
    held: list[tuple[int, int]] = []

    def close() -> str:
        nonlocal in_links, in_hidden
        name, place, before, hidden = open_elements.pop()
        depth[name] -= 1
        in_links -= name == "a"
        in_hidden -= hidden
        if place >= 0:
            held.append((place, total - before))
        return name

    def count(raw: str) -> None:
        nonlocal total
        if raw and not in_links and not in_hidden:
            total += len(" ".join((html.unescape(raw) if "&" in raw else raw).split()))

    at = 0
    for token in _TOKEN.finditer(page):
        count(page[at : token.start()])
        at = token.end()
        if token[3] is None:
            continue
        name, attributes = token[3].lower(), token[4]
        if token[2]:
            if depth.get(name):
                while close() != name:
                    pass
        elif name not in _VOID and not attributes.endswith("/"):
            if name in _OPTIONAL_END and open_elements and open_elements[-1][0] == name:
                close()
            hidden = name not in ("body", "html") and _is_hidden(attributes)
            in_hidden += hidden
            in_links += name == "a"
            place = token.start() if not in_hidden and _is_dropped(name, attributes, False) else -1
            open_elements.append((name, place, total, hidden))
            depth[name] = depth.get(name, 0) + 1
    count(page[at:])
    while open_elements:
        close()
    return frozenset(place for place, n in held if 2 * n > total)


def text_lines(page: str, wrappers: frozenset[int] = frozenset()) -> list[tuple[str, int, int]]:
    """(text, characters in links, container) of each text block of a page, markup stripped.

    Menus, headers and footers leave lines without text in their place, so that a window over
    them holds nothing; what lies within an article leaves none. The container is the number of the outermost article or main element, 0 outside.
    Elements that start at a place in ``wrappers`` are not dropped.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = container = n_containers = 0
    skipped: list[str] = []  # open elements below a dropped one, itself included
    open_containers: list[str] = []
    in_link = False

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, linked, container))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not skipped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        name = token[3]
        if name is None:
            continue
        name, closing, attributes = name.lower(), token[2], token[4]
        if skipped:
            if closing:
                if name in skipped:
                    while skipped.pop() != name:
                        pass
                    if not skipped and name in _BANDS and not open_containers:
                        lines.extend([("", 0, 0)] * WINDOW_LINES)
                elif name in _CONTAINERS and open_containers or name in ("body", "html"):
                    skipped.clear()  # the dropped element was never closed
            elif name not in _VOID and not attributes.endswith("/"):
                if name in _CONTAINERS and name not in skipped and not _is_dropped(name, attributes, False):
                    skipped.clear()  # an article does not lie in an element that was left open
                elif name in _OPTIONAL_END and skipped[-1] == name:
                    continue
                else:
                    skipped.append(name)
            if skipped:
                continue
        if name in _BLOCKS:
            end_line()
        elif name == "br" or name in ("img", "input"):
            add(" ")
        if closing:
            if name == "a":
                in_link = False
            if name in open_containers:
                while open_containers.pop() != name:
                    pass
                if not open_containers:
                    container = 0
            continue
        if name in _VOID:
            continue
        if token.start() not in wrappers and _is_dropped(name, attributes, bool(open_containers)):
            end_line()
            if not attributes.endswith("/"):
                skipped.append(name)
            continue
        if name == "a":
            in_link = True
        elif name in _CONTAINERS:
            if not open_containers:
                n_containers += 1
                container = n_containers
            open_containers.append(name)
    add(page[at:])
    end_line()
    return lines


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none.

    The text lengths of the lines (lines that are mostly links count nothing) are summed over
    sliding windows. A surge point is a line where the window's sum reaches ``SURGE_CHARS`` after
    it held less, a dive point the line where it falls to nothing. Stretches that meet in an
    article or main element are taken as one, and the one with most text is the main one. If most
    of its text lies in article or main elements, all lines of these elements are returned;
    otherwise, all stretches from the first surge to the last dive. On a page without text in such
    elements, what would be dropped by name, role, class or id stays if it holds most of the text.
    """
    lines = text_lines(page) if page else []
    if page and not any(container for _, _, container in lines):
        wrappers = _wrappers(page)
        if wrappers:
            lines = text_lines(page, wrappers)
    if not lines:
        return ""
    lengths = np.array([0 if 2 * linked > len(text) else len(text) for text, linked, _ in lines])
    sums = np.convolve(lengths, np.ones(WINDOW_LINES, np.int64), "full")[WINDOW_LINES - 1 :]  # window starts at the line
    stretches, start = [], None
    for i, (length, total) in enumerate(zip(lengths.tolist(), sums.tolist(), strict=True)):
        if start is None and length and total >= SURGE_CHARS:
            start = i
        elif start is not None and not total:
            stretches.append((start, i))
            start = None
    if start is not None:
        stretches.append((start, len(lines)))
    if not stretches:  # a short page: no window surges
        stretches = [(0, len(lines))] if lengths.any() else []
    if not stretches:
        return ""
    groups: list[dict[int, int]] = []  # text by container, of stretches that meet in an article or main element
    group_of: dict[int, dict[int, int]] = {}
    for a, b in stretches:
        own: dict[int, int] = {}
        for i in range(a, b):
            if lengths[i]:
                own[lines[i][2]] = own.get(lines[i][2], 0) + int(lengths[i])
        group = next((group_of[c] for c in own if c in group_of), None)
        if group is None:
            group = {}
            groups.append(group)
        for c, n in own.items():
            group[c] = group.get(c, 0) + n
            if c:
                group_of[c] = group
    best = max(groups, key=lambda g: sum(g.values()))
    if 2 * best.get(0, 0) < sum(best.values()):
        return "\n".join(text for text, _, c in lines if c and c in best and text)
    first, last = stretches[0][0], stretches[-1][1]
    return "\n".join(text for (text, _, _), n in zip(lines[first:last], lengths[first:last], strict=True) if text and n)


def extract_main_text(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``source`` and with ``out`` and its length in code points, ``n_chars``.

    A null or empty page gives an empty text. Rows do not depend on each other: repeated rows
    and other columns (the names ``out`` and ``n_chars`` excepted, which are replaced) stay.
    """
    bounded_batches(pages.sparkSession)
    chars = "n_chars"
    kept = [c for c in pages.columns if c not in (source, out, chars)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], found, pc.utf8_length(found).cast(pa.int64())], [*kept, out, chars]
            )

    schema = pages.select(*kept).schema.add(out, "string").add(chars, "long")
    return pages.select(*kept, source).mapInArrow(run, schema)
