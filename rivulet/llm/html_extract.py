"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared

#: Elements without content, elements whose content is no markup, and elements within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

#: A start tag of the key closes an open element of the set, up to the nearest element of the fence.
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul"
_FENCE = frozenset("html body article section div main aside header footer nav td th blockquote form fieldset figure table button object".split())
_CLOSES = {name: (frozenset(("p",)), _FENCE) for name in _BLOCKS.split()}
_CLOSES |= {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}

#: Elements whose text isn't shown as text, or is a control's.
NO_TEXT = frozenset("head script style noscript template button select option dialog iframe object embed canvas svg math audio video map title textarea input datalist legend".split())

#: What says that an element isn't the article: elements, roles, and words of a class or id. All are weights of paths.
ASIDE = frozenset("nav header footer aside menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist tooltip".split())
ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header
    login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related reply replies
    respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets""".split()
)
WRAPPERS = frozenset(("form", "fieldset"))
#: A name with one of these words (has-sidebar, no-comments) says what the page has, not what the element is.
MODIFIERS = frozenset("has have no not non with without is hide hides show shows enable enabled disable disabled".split())
CONTENT = frozenset(("article", "main"))

#: Weights of paths by the weakest aside kind of their elements, and under an article or main.
WEIGHTS = {"firm": 0.0, "whole": 0.1, "part": 0.3}
CONTENT_WEIGHT = 16.0

#: A path is selected from this share of the mean fused ratio on.
SHARE = 0.85

#: Elements are nested so deep at most; deeper ones count as text of the last. So a tag costs a bounded time.
DEPTH = 128

#: Elements that are pieces of the article they stand beside, and those of them and in them whose container is the next one up.
PIECES = frozenset("ul ol dl table pre blockquote figure".split())
NESTED = frozenset("ul ol li dl dd dt blockquote figure pre".split())

_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*)|!\[CDATA\[.*?\]\]>|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+|[^>]*+)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…।؟،]")


def _named(value: str) -> str:
    """"whole" if all words of one of the names are aside words, "part" if some are; else nothing."""
    found = ""
    for name in value.split():
        words = _WORDS.findall(name)
        if ASIDE_WORDS.isdisjoint(words) or not MODIFIERS.isdisjoint(words):
            continue
        if ASIDE_WORDS.issuperset(words):
            return "whole"
        found = "part"
    return found


def _aside(name: str, rest: str) -> str:
    """"none" for what has no shown text, else the kind of WEIGHTS or nothing."""
    if name in NO_TEXT:
        return "none"
    found = "firm" if name in ASIDE else "part" if name in WRAPPERS else ""
    if not rest or "=" not in rest and "hidden" not in rest:
        return found
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and name not in CONTENT and name not in ("html", "body"):
            found = min(found or "~", _named(value) or "~", key=lambda k: WEIGHTS.get(k, 1.0)).strip("~")
        elif key == "role" and value.strip() in ASIDE_ROLES:
            found = "firm"
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return "none"
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "none"
    return found


class Element(NamedTuple):
    name: str
    mark: str  # what stands for it in a path: its name, first class and aside kind; empty if it is inline
    number: int


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int  # characters in links
    elements: list[Element]


def _mark(name: str, rest: str, kind: str) -> str:
    m = re.search(r"""\bclass\s*=\s*["']?([^\s"'>]+)""", rest) if rest else None
    return f"{name}.{m[1] if m else ''}!{kind}"


def blocks(page: str) -> list[Block]:
    """Each block with text, in page order.

    A block is the text between two boundaries of elements that aren't inline; its path leads from the root over the
    elements that aren't inline. What has no shown text (scripts, controls, hidden elements) has no blocks.
    """
    out: list[Block] = []
    stack: list[Element] = []
    opened = beyond = 0  # elements so far; open ones that are too deep for the stack
    open_names: Counter = Counter()
    skip = 0  # depth of the stack at which what has no shown text began
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                elements = [e for e in stack if e.mark]
                out.append(Block(tuple(e.mark for e in elements), text, linked, elements))
            held.clear()
        linked = 0

    def close(depth: int) -> None:
        open_names.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    at, find = 0, page.find
    while at < len(page):
        lt = find("<", at)
        if lt < 0:
            lt = len(page)
        m = _TAG.match(page, lt) if lt < len(page) else None
        if m is None and lt < len(page):
            if not skip:
                held.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at and not skip:
            held.append(page[at:lt])
            if open_names["a"] > 0:
                linked += lt - at
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", lt) and not skip:
                held.append(html.escape(page[lt + 9 : at - 3]))
            continue
        name, rest = m[2].lower(), m[3]
        inline = name in INLINE
        if m[1]:
            if name == "br" and not skip:
                held.append(" ")
            if beyond and open_names[name] > 0:
                beyond -= 1
                if not inline and not skip:
                    flush()
                continue
            if open_names[name] <= 0:
                continue
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name)
            if inline and any(e.mark for e in stack[depth:]):
                continue
            if not inline and not skip:
                flush()
            close(depth)
            if skip and len(stack) < skip:
                skip = 0
            continue
        if name in _CLOSES:
            closed, fence = _CLOSES[name]
            low = skip if skip else 0
            if any(open_names[c] > 0 for c in closed):
                for i in range(len(stack) - 1, low - 1, -1):
                    if stack[i].name in closed:
                        if not skip:
                            flush()
                        close(i)
                        break
                    if stack[i].name in fence:
                        break
        if inline:
            if name in ("br", "wbr", "img"):
                if name != "wbr" and not skip:
                    held.append(" ")
                continue
        elif not skip:
            flush()
        if name in VOID:
            continue
        kind = "" if skip else _aside(name, rest)
        if name in RAW:
            end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if rest.endswith("/") and name in ("svg", "path", "rect", "use", "circle", "g"):
            continue
        if len(stack) >= DEPTH:
            beyond += 1
            continue
        if kind == "none" or kind and inline:
            skip = len(stack) + 1
        opened += 1
        open_names[name] += 1
        stack.append(Element(name, "" if inline else _mark(name, rest, kind), opened))
    if not skip:
        flush()
    return out


def path_weights(found: list[Block]) -> dict[tuple[str, ...], float]:
    """A weight for each path: CONTENT_WEIGHT under an article or main, and that of the weakest aside element of the path
    that doesn't wrap the article.

    Elements of a path's beginning wrap the article if they hold an article or main, and over half of the characters
    outside of links unless their kind is "part"; a "part" also if it holds over half, and a "whole" if over nine tenths.
    """
    size: Counter = Counter()
    total, holds, alone = 0, set(), False
    paths = Counter()
    for b in found:
        paths[b.path] += max(0, len(b.text) - b.linked)
    for path, n in paths.items():
        total += n
        asides = [i for i, mark in enumerate(path) if not mark.endswith("!")]
        content = [i for i, mark in enumerate(path) if mark.partition(".")[0] in CONTENT]
        for i in asides:
            size[path[: i + 1]] += n
            if content and content[-1] > i:
                holds.add(path[: i + 1])
        alone = alone or bool(content) and not (asides and asides[0] < content[0])
    out = {}
    for path in paths:
        weight = CONTENT_WEIGHT if any(mark.partition(".")[0] in CONTENT for mark in path) else 1.0
        kinds = []
        for i, mark in enumerate(path):
            kind = mark.rpartition("!")[2]
            if kind:
                prefix = path[: i + 1]
                article, n = prefix in holds and not alone, size[prefix]
                most = 2 * n > total
                wraps = article or most if kind == "part" else article and most or kind == "whole" and 10 * n > 9 * total
                if not wraps:
                    kinds.append(WEIGHTS[kind])
        out[path] = min(kinds) if kinds else weight
    return out


def _smooth(values: list[float]) -> list[float]:
    """Weighted over two blocks before and after."""
    weights = (0.06, 0.24, 0.4, 0.24, 0.06)
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(weights, -2):
            if 0 <= i + k < len(values):
                total, weight = total + w * values[i + k], weight + w
        out.append(total / weight)
    return out


def path_ratios(found: list[Block]) -> tuple[dict, dict, set]:
    """For each path its fused ratio and its characters outside of links; and the paths that are mostly links.

    Ratios of a path: characters outside of links, and punctuation marks, by the path's blocks. Each is smoothed
    over the blocks in page order; the mean of the path's own and the smoothed one counts, so that a path of short
    blocks amid prose keeps up. The two are fused by their geometric mean, marks plus one.
    """
    counts: dict[tuple[str, ...], list[int]] = {}
    for b in found:
        c = counts.setdefault(b.path, [0, 0, 0, 0])
        c[0] += 1
        c[1] += max(0, len(b.text) - b.linked)
        c[2] += len(_PUNCTUATION.findall(b.text))
        c[3] += b.linked
    length = {p: c[1] / c[0] for p, c in counts.items()}
    marks = {p: c[2] / c[0] for p, c in counts.items()}
    near_length = _smooth([length[b.path] for b in found])
    near_marks = _smooth([marks[b.path] for b in found])
    fused: dict[tuple[str, ...], list[float]] = {}
    for b, x, y in zip(found, near_length, near_marks):
        fused.setdefault(b.path, []).append(math.sqrt((length[b.path] + x) / 2 * (1 + (marks[b.path] + y) / 2)))
    return {p: sum(v) / len(v) for p, v in fused.items()}, {p: c[1] for p, c in counts.items()}, {p for p, c in counts.items() if c[3] > c[1]}


def select(found: list[Block], weights: dict, share: float = SHARE) -> tuple[set, set]:
    """Paths whose weighted ratio reaches `share` of the mean of weighted ratios over weighted characters; paths that
    are mostly links don't. Also the latter paths."""
    ratio, size, links = path_ratios(found)
    total = sum(size[p] * w for p, w in weights.items())
    mean = sum(ratio[p] * size[p] * w * w for p, w in weights.items()) / total if total else 0.0
    return {p for p, w in weights.items() if w > 0 and p not in links and size[p] and ratio[p] * w >= share * mean}, links


def _container(elements: list[Element]) -> int:
    """How many elements lead to the container of a block of these elements, itself included."""
    k = len(elements) - 1
    while k > 0 and elements[k - 1].name in NESTED:
        k -= 1
    return k


def _main(found: list[Block], chosen: list[bool]) -> int:
    """The number of the deepest element, html and body apart, with over nine tenths of the chosen characters; 0 if none."""
    size: Counter = Counter()
    order: dict[int, int] = {}
    for b, c in zip(found, chosen):
        if c:
            for depth, e in enumerate(b.elements):
                if e.name not in ("html", "body") and e.name not in NESTED and e.name != "p":
                    size[e.number] += len(b.text)
                    order[e.number] = depth
    total = sum(len(b.text) for b, c in zip(found, chosen) if c)
    return max((k for k, n in size.items() if 10 * n > 9 * total), key=order.__getitem__, default=0)


def _followers(found: list[Block], chosen: list[bool], barred: list[bool], main: int) -> list[bool]:
    """Blocks that follow chosen ones: those within the element `main`, which holds nearly all of these; those between two chosen
    blocks of one container (the same element, or one within the body that holds two elements of the same path); and
    pieces, paragraphs and loose text beside one in its container. Barred blocks don't follow."""
    at = [i for i, c in enumerate(chosen) if c]
    out = [False] * len(found)
    holders = set()
    for i in at:
        elements = found[i].elements
        holders.update(e.number for e in elements[-1:] + elements[max(0, _container(elements) - 1) : _container(elements)])
    for i, j in zip(at, at[1:]):
        a, b = found[i].elements, found[j].elements
        shared = sum(x == y for x, y in zip(a, b))
        if shared and (shared in (_container(a), _container(b)) or found[i].path == found[j].path and a[shared - 1].name not in ("html", "body")):
            for k in range(i + 1, j):
                out[k] = not barred[k]
    for i, b in enumerate(found):
        if barred[i] or chosen[i] or out[i]:
            continue
        for depth, e in enumerate(b.elements):
            rest = [x.name for x in b.elements[depth + 1 :]]
            if e.number == main or e.number in holders and (not rest or rest == ["p"] or not PIECES.isdisjoint(rest[:1] if e.name in ("html", "body") else rest)):
                out[i] = True
    return out


_HEADING = re.compile(r"h[1-6]")


def main_text(page: str | None, share: float = SHARE) -> str:
    """The article's blocks, one a line; empty for a null or empty page.

    Paths are selected by their ratios (`select`). What stands in the container of selected blocks follows them unless
    its path is mostly links or aside (a weight under one). A heading before or amid selected blocks stays if it is
    not aside, or aside only by an element within the container (the article's own header).
    """
    found = blocks(page or "")
    if not found:
        return ""
    weights = path_weights(found)
    chosen_paths, links = select(found, weights, share)
    chosen = [b.path in chosen_paths for b in found]
    barred = [b.path in links or weights[b.path] < 1 for b in found]
    main = _main(found, chosen)
    picked = [a or b for a, b in zip(chosen, _followers(found, chosen, barred, main))]
    last = max((i for i, x in enumerate(picked) if x), default=-1)
    for i, b in enumerate(found[: last + 1]):
        if not picked[i] and b.elements and _HEADING.fullmatch(b.elements[-1].name):
            inner = next((b.path[k + 1 :] for k, e in enumerate(b.elements) if e.number == main), None)
            own = inner is not None and not any(m.rpartition("!")[2] and m.partition(".")[0] != "header" and "header" not in m for m in inner)
            picked[i] = weights[b.path] >= 1 and b.path not in links or own
    return "\n".join(b.text for b, p in zip(found, picked) if p)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars (code points) of each row of df, from its whole page.

    A null or empty page, or one without text, gives an empty text. Markup that isn't closed runs to the end of the page;
    elements deeper than DEPTH count as text of the one at DEPTH; time is linear in the page.
    Repeated rows and null ids stay; other columns aren't read; an empty table gives an empty table. No shuffle.
    """

    def make(pages: list[str | None]) -> list[pa.Array]:
        texts = [main_text(p) for p in pages]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return shared.text_map(df, html_col, [id_col, url_col], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
