"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read once, from left to right, as a sequence of words and tags. Words score positive, by the kind of block and link that they stand in and by the names (class, id, role) of the elements around them;
tags score negative, most of all those that main text rarely holds. The weights are log-odds counted over labelled pages. One linear scan finds the contiguous region of the highest score, and its words are the text, by whole blocks;
elements inside that can't be article text (navigation, adverts, forms to fill in, comments, scripts) are taken out before the scan and only cost what a tag does.

A name that is known whole ("sidebar") decides for its element. A name of which only parts are known ("has-sidebar", "no-ads") counts by its parts, but not against an element that holds over half of the page's words, which is a wrapper.

Null and empty html, and pages without words, give an empty text. Of regions with equal scores the first counts. Elements are nested up to 512 deep, as in browsers; deeper ones stand beside each other. Time grows in
proportion to the page's length, also for broken markup: from the first tag that never ends on, quotes aren't looked at. Rows that share an id are read each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import labelled_pages

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_INSIDE = re.compile(r"""(?:[^>"'=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?|["'])*+""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements without content, with raw content, that stand as blocks, and that never hold article text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object xmp".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = set("head nav aside footer button select dialog menu datalist".split())
CONTROLS = set("input select textarea button".split())
FORM_WORDS = 25  # a form with fewer words a control is one that is filled in; others are wrappers around a page
CLOSES_P = BLOCK - set("body html head br option td th tr tbody thead tfoot caption li dd dt summary figcaption".split())
HIDES_P = set("td th button table".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
SECTION = {"article", "main", "section"}
DEEPEST = 512


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    parent: "Element | None"
    names: tuple[str, ...] = ()
    hidden: bool = False
    depth: int = 0
    open_p: "Element | None" = None  # the paragraph that a block inside would end
    block: str = ""  # the block that its words stand in
    link: bool = False
    words: int = 0  # of the whole element
    controls: int = 0  # of the whole element
    score: float = 0.0  # of the names of this element and those around it
    out: bool = False  # no article text in it


@dataclass
class Page:
    """The page as a sequence of (element, text or None for a tag, "tag" or "/tag"), in page order; marks: main text by label."""
    items: list[tuple[Element, str | None, str]] = field(default_factory=list)
    marks: list[bool] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _names(rest: str) -> tuple[tuple[str, ...], bool]:
    """The names in an element's attributes, and whether it is hidden."""
    names, hidden = [], False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id", "role"):
            names += value.split()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return tuple(dict.fromkeys(names)), hidden


def parse(source: str) -> Page:
    page, inside, quotes = Page(), False, True
    here = root = Element("#", None)
    page.elements.append(root)
    opened: dict[str, int] = defaultdict(int)
    endless: set[str] = set()  # raw elements that no later tag ends
    at, said, end = 0, 0, len(source)

    def add(text: str | None, tag: str) -> None:
        page.items.append((here, text, tag))
        page.marks.append(inside)

    def leave(last: Element) -> None:
        nonlocal here
        while here is not last.parent:
            opened[here.tag] -= 1
            here = here.parent

    while at < end:
        start = source.find("<", at)
        if start < 0:
            break
        name = _NAME.match(source, start + 2 if (closing := source.startswith("/", start + 1)) else start + 1)
        if not name and not source.startswith(("!", "?", "/"), start + 1):
            at = start + 1
            continue
        stop = source.find("-->", start + 4) + 3 if source.startswith("<!--", start) else _INSIDE.match(source, start + 1).end() + 1 if quotes else source.find(">", start) + 1
        if stop == 2 or stop > end:  # a comment without end, or a tag whose quotes hold the rest of the page
            if source.startswith("<!--", start):
                stop = end
            else:
                quotes, stop = False, source.find(">", start) + 1
        if not stop:
            break
        if start > said:
            add(source[said:start], "")
        at = said = stop
        if source.startswith("<!--", start):
            inside = {"[": True, "]": False}.get(source[start + 4:stop - 3], inside)
            continue
        if not name:
            continue
        tag = name[0].lower()
        if closing:
            add(None, "/" + tag)
            if opened[tag] > 0:
                found = here
                while found.tag != tag:
                    found = found.parent
                leave(found)
            continue
        if tag in RAW:
            add(None, tag)
            ending = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if ending:
                at = said = ending.end()
            elif tag in ("script", "style"):
                at = said = end
            else:
                endless.add(tag)
            continue
        if tag in CLOSES_P and here.open_p is not None:
            leave(here.open_p)
        if tag in SAME and any(opened[t] > 0 for t in SAME[tag]):
            found = here
            while found.parent is not None and found.tag not in SAME[tag] and found.tag not in SCOPE[tag]:
                found = found.parent
            if found.tag in SAME[tag]:
                leave(found)
                if tag == "tr" and here.tag == "tr":
                    leave(here)
        rest = source[name.end():stop - 1]
        names, hidden = _names(rest) if rest else ((), False)
        element = Element(tag, here, names, hidden, here.depth + 1, block=tag if tag in BLOCK and tag != "br" else here.block, link=here.link or tag == "a")
        element.open_p = element if tag == "p" else None if tag in HIDES_P else here.open_p
        page.elements.append(element)
        page.items.append((element, None, tag))
        page.marks.append(inside)
        if tag not in VOID and here.depth < DEEPEST:
            here = element
            opened[tag] += 1
    if end > said:
        add(source[said:], "")
    return page


@dataclass(frozen=True)
class Weights:
    words: dict[tuple[str, bool], float]  # by block and link
    whole: dict[str, float]  # names
    parts: dict[str, float]  # of names
    tags: dict[str, float]
    unknown_word: float
    unknown_tag: float


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def learn(sources: list[str]) -> Weights:
    """Log-odds of main text: of a word by its block, of the names that it stands under, of tags."""
    words, whole, parts, tags = Counter(), Counter(), Counter(), Counter()
    for source in sources:
        page = parse(source)
        for (element, text, tag), main in zip(page.items, page.marks):
            if text is None:
                tags[tag, main] += 1
            elif n := len(text.split()):
                words[(element.block, element.link), main] += n
                held: set[str] = set()
                while element is not None:
                    held.update(element.names)
                    element = element.parent
                for name in held:
                    whole[name.lower(), main] += n
                for part in {p for name in held for p in _parts(name)}:
                    parts[part, main] += n

    def odds(counts: Counter, least: float, most: float, prior: float, shift: float = 0.0) -> dict:
        return {k: min(most, max(least, shift + math.log((counts[k, True] + prior) / (counts[k, False] + prior)))) for k in {k for k, _ in counts}}

    return Weights(odds(words, 0.1, 6.0, 2.0, 1.0), odds(whole, -4.0, 1.0, 2.0), odds(parts, -4.0, 1.0, 2.0), odds(tags, -4.0, -0.05, 1.0, -0.5), 0.5, -1.0)


@functools.lru_cache(maxsize=1)
def default_weights() -> Weights:
    return learn(labelled_pages.pages())


def _never(e: Element) -> bool:
    return e.tag in NEVER or e.tag == "form" and e.words < FORM_WORDS * max(1, e.controls)


def _judge(page: Page, weights: Weights) -> None:
    """Fill words, score and out of all elements; parents come before their children."""
    for element, text, tag in page.items:
        if text is not None:
            element.words += len(text.split())
        elif tag in CONTROLS:
            element.controls += 1
    for element in reversed(page.elements[1:]):
        element.parent.words += element.words
        element.parent.controls += element.controls
    most = page.elements[0].words / 2
    for e in page.elements[1:]:
        if not e.names and not e.hidden and e.tag != "header":
            e.score, e.out = e.parent.score, e.parent.out or _never(e)
            continue
        known = [weights.whole[n] for n in (n.lower() for n in e.names) if n in weights.whole]
        guessed = [sum(weights.parts.get(p, 0.0) for p in _parts(n)) for n in e.names if n.lower() not in weights.whole]
        own = sum(known) + sum(guessed)
        wrapper = e.words > most and sum(known) >= 0
        own = 0.0 if wrapper and own < 0 or e.tag in ("html", "body") else max(-4.0, min(1.0, own))
        within = e.parent
        while within is not None and within.tag not in SECTION and e.tag == "header":
            within = within.parent
        header = e.tag == "header" and within is None and own <= 0
        e.score = e.parent.score + own
        e.out = e.parent.out or e.hidden or _never(e) or header or own <= -1.5


def item_scores(page: Page, weights: Weights) -> list[float]:
    """Of each item. Of an element that is no article text only the first tag counts."""
    _judge(page, weights)
    out = []
    for element, text, tag in page.items:
        if element.out:
            out.append(0.0 if text is not None or tag.startswith("/") or element.parent.out else weights.unknown_tag)
        elif text is None:
            out.append(weights.tags.get(tag, weights.unknown_tag))
        else:
            out.append(len(text.split()) * max(0.1, weights.words.get((element.block, element.link), weights.unknown_word) + min(0.0, element.score)))
    return out


def _holders(element: Element) -> list[Element]:
    out = [element]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _stretches(scores: list[float]) -> list[tuple[float, int, int]]:
    """(score, first, last) of the best region of each stretch in which the running score stays over zero."""
    found: list[tuple[float, int, int]] = []
    running, first, high, last = 0.0, 0, 0.0, -1
    for i, score in enumerate(scores):
        if running <= 0:
            if high > 0:
                found.append((high, first, last))
            running, first, high = 0.0, i, 0.0
        running += score
        if running > high:
            high, last = running, i
    return [*found, (high, first, last)] if high > 0 else found


def region(page: Page, weights: Weights) -> tuple[int, int] | None:
    """First and last item of the contiguous region with the highest score; None if no score is over zero."""
    best = max(_stretches(item_scores(page, weights)), key=lambda f: f[0], default=None)
    return best and best[1:]


def article_region(page: Page, weights: Weights, share: float = 0.25) -> tuple[int, int] | None:
    """The best region, drawn out over what parts an article in two.

    What stands in the middle of an article may cost more than either half of it is worth, a long list of links for one. So the region goes on to those other stretches that have a share of its score or more and lie in the same element:
    the smallest around the words of the best one, where that is a section, article, division, form or cell.
    """
    found = _stretches(item_scores(page, weights))
    if not found:
        return None
    best = max(found, key=lambda f: f[0])
    words = lambda f: [e for e, text, _ in page.items[f[1]:f[2] + 1] if text is not None and not e.out and text.strip()]
    common: list[Element] | None = None
    for e in dict.fromkeys(words(best)):
        held = _holders(e)
        known = set(held)
        common = held if common is None else [h for h in common if h in known]
    around = next((h for h in common or [] if h.tag in BLOCK), None)
    if around is None or around.tag not in SECTION | {"div", "form", "td"}:
        return best[1:]
    inside = lambda f: all(around in _holders(e) for own in [words(f)] for e in (own[:1] + own[-1:] or page.elements[:1]))
    near = [f for f in found if f[0] >= share * best[0] and inside(f)]
    return min(f[1] for f in near), max(f[2] for f in near)


def main_text(source: str | None, weights: Weights | None = None) -> str:
    weights = weights or default_weights()
    page = parse(source or "")
    found = article_region(page, weights)
    if found is None:
        return ""
    blocks: list[str] = []
    current: list[str] = []
    inside = False  # whether the region holds part of the block
    for i, (element, text, tag) in enumerate(page.items):
        if text is None:
            if tag.lstrip("/") in BLOCK:
                if inside and current:
                    blocks.append("".join(current))
                current, inside = [], False
        elif not element.out:
            current.append(text)
            inside = inside or found[0] <= i <= found[1] and bool(text.strip())
    if inside and current:
        blocks.append("".join(current))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    few = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return few.mapInArrow(run, "page_id long, url string, text string, n_chars long")
