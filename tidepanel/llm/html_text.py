"""Main text of web pages by the distribution of text over lines.

Mark-up is stripped to lines, one for each block element. A line weighs as many characters as it has outside links beyond
those in links. Menus, side bars, footers, forms and hidden elements are no text. The weights summed over the tree of
elements show the block that holds the article: the heaviest article or main element if it has a quarter of the page's
weight, else the innermost block that keeps three fifths of the weight of the one around it. Class names only weigh: an
element named wholly after a part of the page (``related-posts``, not ``side-effects``) counts an eighth in that choice and is
left out beside the chosen block and below it, but not where it contains the block. Sums of weights over a sliding window of
lines rise steeply where text begins (surge) and fall to nothing where it ends (dive): they cut the lines of a block that is
not marked, and keep dense lines outside of the block (a quarter as dense as those in it), a second article among them. Headings right before kept lines stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
SURGE = 80
HELD = 0.6  # share of a block's weight that an inner block must hold to be chosen instead
MARKED = 0.25  # share of the page's weight that makes a marked article the chosen block

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title")}  # no tags in them, up to the end tag
_FOREIGN = frozenset("svg math".split())  # here a tag that ends in a slash is an empty element
_NESTED = _FOREIGN | {"template", "object"}
_DROPPED = _NESTED | frozenset("noscript iframe select button".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav aside footer form dialog menu fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_OUT_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner "
    "sidebar sidebars side aside rail menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "foot cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments commentlist "
    "respond reply replies discussion disqus pagination pager toolbar widget widgets tags copyright disclaimer skip "
    "hidden form search teaser teasers".split())
_WITH_THEM = frozenset(  # words that stand beside those above in the name of a part
    "a an and area article articles bar block body bottom box btn button buttons by center col column container content "
    "div entry field first global group head heading icon icons in inner item items js label last left link links list "
    "main message mobile nested of on outer page panel post posts primary right row secondary section site slot small "
    "stories sub text thread title to top ui unit us user view wrap wrapper".split())
_COMMENTS = frozenset("comment comments commentlist respond disqus".split())
_MAIN = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDERS = frozenset("article body center div main section table tbody td tr".split())  # elements that can be the chosen block
_SPLIT = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d*")
_WITH = re.compile(r"\b(?:no|has|with|without)[_-]\w+", re.I)  # says what stands beside an element, not what it is


def _tokens(page: str) -> tuple[list[tuple[int, int, str, str, str]], dict[int, int]]:
    """(begin, end, slash, name, attributes) of each tag, comment or raw element (name '' or the element's, slash '*'),
    and for dropped elements with an end tag the place in the list where they begin and that of their end tag."""
    out: list[tuple[int, int, str, str, str]] = []
    pairs: dict[int, int] = {}
    starts: dict[str, list[int]] = {n: [] for n in _DROPPED}
    at = 0
    while m := _TOKEN.search(page, at):
        at, slash, name, attributes = m.end(), m[1] or "", (m[2] or "").lower(), m[3] or ""
        empty = attributes.rstrip().endswith("/")
        if name in _RAW and not slash:
            if not (empty and (starts["svg"] or starts["math"])):
                end = _RAW[name].search(page, at)
                at = end.end() if end else len(page)
            slash = "*"
        elif name in _DROPPED:
            if slash and starts[name]:
                pairs[starts[name].pop()] = len(out)
                if name not in _NESTED:
                    starts[name].clear()
            elif not slash and not (empty and name in _FOREIGN):
                starts[name].append(len(out))
        out.append((m.start(), at, slash, name, attributes))
    return out, pairs


def _hidden(name: str, attributes: str) -> bool:
    """Whether an element is a part of the page beside its text, or not shown."""
    if name in _OUT:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c in _MARKS.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value.lower() in _OUT_ROLES:
            return True
    return False


def _named_part(name: str, attributes: str, inside: bool) -> str:
    """'part' if a class or id names an element wholly after a part of the page, 'header' if after a header only.

    Headings are never named so, as their ids repeat their words; inside an article the id of a section doesn't count
    unless it says comments, for the same reason.
    """
    if name in _HEADINGS or name in ("html", "body", "main", "p") or "=" not in attributes:
        return ""
    found = ""
    for key, a, b, c in _MARKS.findall(attributes):
        key = key.lower()
        if key not in ("class", "id"):
            continue
        for one in _WITH.sub(" ", a or b or c).split():
            words = {w.lower() for w in _SPLIT.split(one) if not _DIGITS.fullmatch(w)}
            out = words & _OUT_WORDS
            if not out or words - _OUT_WORDS - _WITH_THEM:
                continue
            if key == "id" and name == "section" and inside and not out & _COMMENTS:
                continue
            if out != {"header"}:
                return "part"
            found = "header"
    return found


class _Page:
    """Lines of a page, each with its innermost element, and the tree of elements by their order (0 is the page)."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.linked: list[int] = []
        self.heading: list[bool] = []
        self.element: list[int] = []
        self.parent, self.name, self.part, self.marked = [0], [""], [""], [False]


def lines(page: str) -> _Page:
    """The blocks of a page in its order, those not shown and those of menus, side bars, footers and forms left out."""
    out = _Page()
    stack: list[tuple[str, bool, int]] = []  # name, left out, its number
    text: list[str] = []
    linked, links, skip, here = 0, 0, False, 0
    opened: Counter[str] = Counter()

    def close() -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        if line:
            out.text.append(line)
            out.linked.append(linked)
            out.heading.append(any(opened[h] for h in _HEADINGS))
            out.element.append(here)
        text.clear()
        linked = 0

    def end_of(name: str) -> None:
        nonlocal skip, here, links
        last = ""
        while last != name:
            last = stack.pop()[0]
            opened[last] -= 1
        skip, here = stack[-1][1:] if stack else (False, 0)
        links = opened["a"]

    tokens, pairs = _tokens(page)
    at, k, n = 0, 0, len(page)
    while k <= len(tokens):
        begin, stop, slash, name, attributes = tokens[k] if k < len(tokens) else (n, n, "", "", "")
        if opened["head"] and at < begin and not page[at:begin].isspace():
            end_of("head")  # text ends a head without end tag
        if not skip and at < begin:
            piece = html.unescape(page[at:begin])
            text.append(piece)
            if links:
                linked += len("".join(piece.split()))
        at = stop
        if not slash and opened["head"] and name and name not in _IN_HEAD:
            end_of("head")  # so does an element of the body
        dropped = name in _DROPPED and not slash
        if (slash == "*" or dropped) and not skip:
            text.append(" ")
        closed = pairs.get(k) if dropped else None
        if closed is not None:
            at = tokens[closed][1]
        k = (k if closed is None else closed) + 1
        if not name or slash == "*" or closed is not None:
            continue
        if slash:
            if name in _BLOCKS:
                close()
            if opened[name]:
                end_of(name)
            continue
        if name in _BLOCKS:
            close()
            if name in ("p", "li") and stack and stack[-1][0] == name:  # the end tag may be left out
                end_of(name)
        elif name in ("br", "wbr", "img") and not skip:
            text.append(" " if name == "br" else "")
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        inside = out.marked[here]
        skip = skip or dropped or name == "head" or _hidden(name, attributes)
        if name in _BLOCKS and not skip:
            part = "header" if name == "header" else _named_part(name, attributes, inside)
            out.parent.append(here)
            out.name.append(name)
            out.part.append("" if part == "header" and inside else part)
            out.marked.append(inside or name in _MAIN)
            here = len(out.parent) - 1
        stack.append((name, skip, here))
        opened[name] += 1
        links = opened["a"]
    close()
    return out


def _chosen(found: _Page, weight: list[int]) -> int:
    """The element that holds the article."""
    n = len(found.parent)
    total = [0.0] * n
    for w, e in zip(weight, found.element):
        total[e] += w
    for e in range(n - 1, 0, -1):  # inner elements come after those around them
        if found.part[e]:
            total[e] /= 8
        total[found.parent[e]] += total[e]
    outer = [e for e in range(1, n) if found.marked[e] and not found.marked[found.parent[e]]]
    best = max(outer, key=lambda e: (total[e], -e), default=0)
    if best and total[best] > 0 and total[best] >= MARKED * total[0]:
        return best
    heaviest: dict[int, int] = {}
    for e in range(n - 1, 0, -1):
        p = found.parent[e]
        if found.name[e] in _HOLDERS | {"html"} and (p not in heaviest or total[e] >= total[heaviest[p]]):
            heaviest[p] = e
    at = 0
    while at in heaviest and total[heaviest[at]] > 0 and total[heaviest[at]] >= HELD * total[at]:
        at = heaviest[at]
    return at


def _runs(weight: np.ndarray, window: int, least: int) -> list[bool]:
    """For each line whether it lies between a surge and a dive."""
    sums = np.convolve(weight, np.ones(window, np.int64))[window - 1:]  # a line and those after it
    out, on = [], False
    for k in range(len(weight)):
        ahead = bool(weight[k:k + window].any())
        on = ahead if on else bool(weight[k]) and sums[k] >= least
        out.append(on)
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The blocks between surges and dives, joined by two newlines."""
    found = lines(page or "")
    if not found.text:
        return ""
    plain = [max(0, len(t) - 2 * k) for t, k in zip(found.text, found.linked)]
    full = [p or len(t) * found.marked[e] for p, t, e in zip(plain, found.text, found.element)]
    block = _chosen(found, full)
    around, at = {block}, block
    while at:
        at = found.parent[at]
        around.add(at)
    page_wide = found.name[block] in ("", "html", "body")
    under, part = [False] * len(found.parent), [False] * len(found.parent)
    for e in range(len(found.parent)):
        p = found.parent[e]
        under[e] = e == block or e > 0 and under[p]
        kind = found.part[e] if e not in around else ""
        part[e] = e > 0 and part[p] or kind == "part" or kind == "header" and (page_wide or not under[e])
    marked = found.marked[block]
    own = [under[e] and not part[e] for e in found.element]
    inner = np.array([(len(t) if marked else p) * o for t, p, o in zip(found.text, plain, own)], np.int64)
    rest = np.array([p * (not under[e] and not part[e] and (found.marked[e] or not marked))
                     for p, e in zip(plain, found.element)], np.int64)
    top = int(np.convolve(inner, np.ones(window, np.int64)).max())
    first = _runs(inner, window, min(surge, top) if page_wide else 1)
    kept = [f and o for f, o in zip(first, own)]
    if rest.any():
        second = _runs(rest, window, surge if marked else max(surge, top // 4))
        for k, e in enumerate(found.element):
            kept[k] = kept[k] or second[k] and not under[e] and not part[e] and (found.marked[e] or not marked)
    for k in range(len(kept) - 2, -1, -1):
        kept[k] = kept[k] or found.heading[k] and kept[k + 1] and not part[found.element[k]]
    return "\n\n".join(t for t, k in zip(found.text, kept) if k)


def _extract(window: int, surge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [main_text(x, window, surge) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page": part.column("page"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Per page: id, url, ``text`` (blocks of the article joined by two newlines), ``n_chars`` (code points).

    Character references are decoded, white space within a block becomes one space. Null and empty pages and pages
    without an article have the text ''. A page without mark-up is one block. Broken mark-up is read as far as it
    goes: an element without its end tag lasts as long as its parent, a head until the body begins, and only script,
    style, textarea and title to the end of the page. Every row is returned, also with null or
    repeated ids. Other columns are ignored; an empty table gives an empty result.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))
    out = source.mapInArrow(_extract(window, surge), "page long, url string, text string, n_chars long")
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
