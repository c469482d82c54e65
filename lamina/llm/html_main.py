"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page, and each line gets a weight: the length of
its text. Tags only weigh: what stands in menus, headers, footers, sidebars, notices, adverts, forms and
comments weighs nothing, and so does text outside the article on pages that mark one, and links elsewhere.
The weights of sliding windows of lines are summed. Where that sum leaves zero the text surges, where it
returns to zero it dives. What stands between is main text if its highest window has some share of the
page's highest one, so a short article is measured by itself, and teasers beside a long one are not.

Pages are scanned once, from left to right, however broken their markup is.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, and the share of the page's highest window sum that a region's highest must have.
WINDOW, SHARE = 3, 0.1
#: A region with a window of so many characters is kept whatever its share.
PASSAGE = 60

# Element names and class words of HTML.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_SKIPPED = frozenset("nav header footer aside form dialog menu button select noscript template svg object canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math meter mfrac mi mn mo mrow msqrt msub msup mtext progress q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ITEMS = frozenset("li dt dd tr td th option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs
    header masthead footer sidebar aside related share sharing social cookie cookies consent notice notices gdpr popup modal overlay
    newsletter subscribe subscription signup login search comment comments commentlist reactions disqus respond replies pagination pager toolbar widget""".split()
)
#: Words that stand beside those without changing what they say.
_BESIDE = frozenset(
    """site page global top bottom main primary secondary left right box area list wrap wrapper bar block container section link links
    panel inner outer item items slot unit zone content text body group row col column form buttons posts stories icons media
    reader readers user users post thread""".split()
)

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_STEP = re.compile(r"=\s*+([\"'])|[<>]")
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]*+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}


def _says_aside(value: str) -> bool:
    """A class or id of which some word, taken whole, names what is no main text: 'cookie-notice' or 'site-header', but not 'related-work'."""
    for token in value.lower().split():
        words = [w for w in re.split(r"[^a-z]+", token) if len(w) > 1]
        if not _WORDS.isdisjoint(words) and all(w in _WORDS or w in _BESIDE for w in words):
            return True
    return False


def _set_aside(name: str, attrs: str) -> bool:
    """An element that holds no main text. Classes speak for containers only, not for headings or words in a line."""
    if name in _SKIPPED:
        return True
    if not attrs or name in ("html", "body"):
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).strip()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and name not in _INLINE and name not in _HEADINGS and name != "main" and _says_aside(value):
            return True
    return False


@dataclass(eq=False)
class _Element:
    name: str
    aside: bool
    article: int = 0
    above: _Element | None = None
    """The element set aside in which this one, set aside as well, stands."""
    closed: bool = False
    """By an end tag of its own."""
    _open: bool | None = None

    def left_open(self) -> bool:
        """Neither this element nor one above was closed."""
        chain, e = [], self
        while e is not None and e._open is None:
            chain.append(e)
            e = e.above
        for x in reversed(chain):
            x._open = not x.closed and (x.above is None or bool(x.above._open))
        return bool(self._open)


@dataclass
class Line:
    text: str
    linked: int
    """Characters of its links."""
    article: int
    """Which article it stands in, from 1; 0: none."""
    main: bool
    aside: _Element | None
    """The innermost open element that is set aside."""

    def set_aside(self) -> bool:
        # An article in an element that is never closed isn't part of it: that element was left open.
        return self.aside is not None and not (self.aside.article < self.article and self.aside.left_open())


def tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag ends whose name ends at at: behind its '>', or before the '<' of the next tag. unclosed: quotes of which the rest of the page has no more."""
    while m := _STEP.search(page, at):
        quote = m[1]
        if not quote:
            return m.end() if m[0] == ">" else m.start()
        close = -1 if quote in unclosed else page.find(quote, m.end())
        if close < 0:
            unclosed.add(quote)
        at = close + 1 or m.end()
    return len(page)


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, those that are set aside included."""
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[_Element] = []
    opened: Counter = Counter()
    asides: list[_Element] = []
    unclosed: set[str] = set()
    linked, articles, outer = 0, 0, 0

    def end_line() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            heading = any(opened[h] for h in _HEADINGS) and len(asides) == 1 and asides[0].name == "header" and asides[0].article
            lines.append(Line(text, linked, outer, opened["main"] > 0, asides[-1] if asides and not heading else None))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        text = htmllib.unescape(text) if "&" in text else text
        parts.append(text)
        linked += len(text) if opened["a"] else 0

    def pop() -> _Element:
        nonlocal outer
        e = stack.pop()
        opened[e.name] -= 1
        if e.aside:
            asides.pop()
        if e.name == "article" and not opened["article"]:
            outer = 0
        return e

    at = 0
    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            tag = len(page)
        if tag > at:
            say(page[at:tag])
        if tag == len(page):
            break
        m = _OPEN.match(page, tag)
        if not m:
            if page.startswith("<!--", tag):
                close = page.find("-->", tag + 2)
                at = close + 3 if close >= 0 else len(page)
            elif page.startswith(("<!", "<?", "</"), tag):
                close = page.find(">", tag)
                at = close + 1 if close >= 0 else len(page)
            else:
                say("<")
                at = tag + 1
            continue
        at, name = tag_end(page, m.end(), unclosed), m[2].lower()
        attrs = page[m.end() : at].rstrip(">")
        inline = name in _INLINE or "-" in name
        if not inline:
            end_line()
        if m[1]:
            if opened[name]:
                if inline and asides and asides[-1].name == name:
                    end_line()
                while True:
                    e = stack[-1]
                    e.closed = e.name == name
                    if pop().name == name:
                        break
            continue
        if name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if name in _RAW:
            if not attrs.endswith("/"):
                close = _RAW_END[name].search(page, at)
                at = tag_end(page, close.end(), unclosed) if close else len(page)
            continue
        if not inline and opened["p"]:  # a block ends the paragraph before it, if only inline elements are open in it
            k = len(stack) - 1
            while stack[k].name in _INLINE:
                k -= 1
            if stack[k].name == "p":
                while len(stack) > k:
                    pop()
        if name in _ITEMS and stack and stack[-1].name == name or name == "a" and opened["a"] and stack[-1].name == "a":
            pop()
        if attrs.endswith("/") and (name in ("svg", "math") or "-" in name):
            continue
        aside = _set_aside(name, attrs)
        if aside and inline:
            end_line()
        e = _Element(name, aside, outer, asides[-1] if asides else None)
        stack.append(e)
        opened[name] += 1
        if aside:
            asides.append(e)
        if name == "article" and not outer:
            articles += 1
            outer = articles
    end_line()
    return lines


def weights_of(lines: list[Line]) -> list[int]:
    """A line's text length, or zero where tags set it aside; outside a marked article zero, without one less its links."""
    held = [not x.set_aside() for x in lines]
    if not any(held) and any(x.article for x in lines):  # the article's surroundings have a misleading name
        held = [x.article > 0 for x in lines]
    for inside in ([x.article > 0 for x in lines], [x.main for x in lines]):
        if any(h and i for h, i in zip(held, inside, strict=True)):
            return [len(x.text) * (h and i) for x, h, i in zip(lines, held, inside, strict=True)]
    return [max(0, len(x.text) - x.linked) * h for x, h in zip(lines, held, strict=True)]


def window_sums(weights: list[int]) -> list[int]:
    """Of the line, and of those around it."""
    sums, total, half = [], sum(weights[: WINDOW // 2]), WINDOW // 2
    for i in range(len(weights)):
        total += weights[i + half] if i + half < len(weights) else 0
        total -= weights[i - half - 1] if i > half else 0
        sums.append(total)
    return sums


def regions(sums: list[int]) -> list[tuple[int, int]]:
    """[surge, dive) of each stretch of lines whose window sums are above zero."""
    out, i = [], 0
    while i < len(sums):
        surge = i
        while i < len(sums) and sums[i]:
            i += 1
        if i > surge:
            out.append((surge, i))
        i += 1
    return out


def main_lines(lines: list[Line]) -> list[str]:
    weights = weights_of(lines)
    sums = window_sums(weights)
    least = min(PASSAGE, SHARE * max(sums, default=0))
    chosen = [(a, b) for a, b in regions(sums) if max(sums[a:b]) >= least]
    # An article of which one region is chosen is main text as a whole: an advert inside it doesn't part it.
    whole = {lines[k].article for a, b in chosen for k in range(a, b) if weights[k]} - {0}
    inside = {k for a, b in chosen for k in range(a, b)}
    return [x.text for k, x in enumerate(lines) if weights[k] and (x.article in whole or k in inside)]


def main_text(page: str | None) -> str:
    """The main text, its blocks joined by newlines. A null or empty page, or one without main text, gives ''."""
    return "\n".join(main_lines(lines_of(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """pages, with column text in place of html. A column text of pages is replaced; repeated rows stay."""
    own = [c for c in pages.columns if c not in ("html", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), texts], names=[*own, "text"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*own).schema.fields)
    return pages.select(*own, "html").mapInArrow(run, f"{kept}text string")
