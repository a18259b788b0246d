"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped to one line a block, in page order. Menus, forms, notices and the like leave no
line; where a page marks its article, lines outside it have no length, and elsewhere text of links has none. Lengths are summed over a sliding window of lines: where the sum surges over a threshold
the main text begins, where it dives to nothing it ends, and the lines between are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column

from tidegauge.llm.common import per_batch

#: Lines of a window, and the characters in one from which main text begins.
WINDOW, SURGE = 3, 80

# HTML elements by what their text is.
ASIDE = frozenset("nav footer aside form button fieldset dialog menu label input".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
# Words in class, id or role by which pages name what is not main text.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " header masthead footer comment comments discussion replies reply disqus cookie cookies consent notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright"
    " complementary contentinfo search".split()
)
#: A name in front of which a class's last or first word says nothing of its element (no-sidebar).
NOT_NAMED = frozenset("has no not with without is".split())
#: Parts of an article whose own header holds its headline.
HEADED = frozenset("article content entry main page post story".split())
#: Words that name an aside at the start of a longer class only before a word for a piece of layout.
AMBIGUOUS = frozenset("header notice notices related search share social".split())
LAYOUT = frozenset(
    "area articles bar block box button buttons container content form group icons inner items links list media message nav panel posts section stories text top widget wrap wrapper".split()
)
#: Elements whose content is no markup of the page.
RAW = frozenset("script style title noscript template textarea iframe svg math select".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: A tag without angle brackets in its attributes: never reads beyond the next tag.
SIMPLE = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
QUOTE_OR_END = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
HIDDEN_STYLE = re.compile(r"display\s*+:\s*+none", re.I)
WORDS = re.compile("[a-z]+")


def names_aside(name: str) -> bool:
    """Whether one class, id or role names what is not main text: the whole of it, or its last or
    first word ("cookie-notice", "sidebar_left")."""
    words = WORDS.findall(name.lower())
    if not words or words[0] in NOT_NAMED:
        return False
    first, last = words[0], words[-1]
    if last in ASIDE_WORDS:
        return not (last == "header" and first in HEADED)
    return first in ASIDE_WORDS and (first not in AMBIGUOUS or last in LAYOUT)


def named_aside(tag: str, rest: str) -> bool:
    if not rest or tag in ("body", "html") or tag in CONTENT:
        return False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name == "style" and HIDDEN_STYLE.search(value):
            return True
        if name in ("class", "id", "role") and any(map(names_aside, value.split())):
            return True
    return False


def tokens_of(html: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """Runs of text, and tags (name in lower case, whether it ends an element, attributes), in page
    order. Comments and raw elements are passed over; those never closed reach to the end of the page.
    A "<" that begins no closed tag is text. One scan forward: what a search for the end of a tag found
    or missed is kept, so that the work grows with the page whatever it holds."""
    size, at, end, special = len(html), 0, -1, -1
    unclosed: set[int] = set()  # quotes from which no end of a tag was found

    def end_of_tag(start: int) -> int:
        nonlocal special
        if special < start:
            found = QUOTE_OR_END.search(html, start)
            special = found.start() if found else size
        i, quotes = special, []
        while i < size and html[i] != ">":
            if i in unclosed:
                i = size
                break
            quotes.append(i)
            closing = html.find(html[i], i + 1)
            found = QUOTE_OR_END.search(html, closing + 1) if closing >= 0 else None
            i = found.start() if found else size
        if i < size:
            return i
        unclosed.update(quotes)
        return end

    while at < size:
        start = html.find("<", at)
        if start != at:
            start = size if start < 0 else start
            yield html[at:start], "", False, ""
            at = start
            continue
        found = SIMPLE.match(html, at)
        if found:
            ends, tag, rest = found.groups()
            at = found.end()
        elif html.startswith("<!--", at):
            closing = html.find("-->", at + 2)
            at = size if closing < 0 else closing + 3
            continue
        else:
            if end < at:
                end = html.find(">", at)
                end = size if end < 0 else end
            found = NAME.match(html, at) if end < size else None
            if not found:
                if end < size and html[at + 1] in "!?":
                    at = end + 1
                else:
                    yield "<", "", False, ""
                    at += 1
                continue
            ends, tag = found.groups()
            closing = end_of_tag(found.end())
            rest, at = html[found.end() : closing], closing + 1
        tag = tag.lower()
        if tag not in RAW:
            yield None, tag, bool(ends), rest
        elif not ends and not (tag in ("svg", "math") and rest.endswith("/")):
            found = RAW_END[tag].search(html, at)
            closing = html.find(">", found.end()) if found else -1
            at = size if closing < 0 else closing + 1


class Open(NamedTuple):
    """An open element: whether its text is an aside, in the page's article, in a link, and whether it
    is an article within an element that only its name makes an aside."""

    tag: str
    aside: bool
    content: bool
    link: bool
    doubtful: bool
    named: bool  # an aside by name alone, up to the page


class Stack:
    """Open elements, with where each name, the last article and the last block lie, so that an end tag
    finds its element without a walk."""

    def __init__(self) -> None:
        self.items = [Open("", False, False, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.articles, self.blocks = [0], [0]

    def push(self, item: Open) -> None:
        place = len(self.items)
        self.items.append(item)
        self.places.setdefault(item.tag, []).append(place)
        if item.tag in CONTENT:
            self.articles.append(place)
        if item.tag not in INLINE and item.tag != "p":
            self.blocks.append(place)

    def close(self, place: int) -> None:
        while len(self.items) > place:
            tag = self.items.pop().tag
            self.places[tag].pop()
            for places in (self.articles, self.blocks):
                if places[-1] == len(self.items):
                    places.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def end(self, tag: str) -> None:
        """An end tag. A stray one leaves neither the article nor, if inline, an aside."""
        place, top = self.last(tag), len(self.items) - 1
        least = top if self.items[top].aside and tag in INLINE else self.articles[-1]
        if place > 0 and place >= least:
            self.close(place)

    def end_implied(self, tag: str) -> None:
        """What a new paragraph, entry or cell ends: its like, unless a block was opened since."""
        place = self.last(tag)
        if place > 0 and place >= self.blocks[-1]:
            self.close(place)


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    content: bool  # in the page's article
    doubtful: bool  # in an article that is in an aside by name


def lines_of(html: str) -> list[Line]:
    """The blocks of a page with text. Those of asides are left out, but for articles in an element
    that only its class, id or role makes an aside: these are marked as doubtful."""
    lines: list[Line] = []
    parts: list[str] = []
    plain = 0
    stack = Stack()

    def close() -> None:
        nonlocal plain
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, plain, stack.items[-1].content, stack.items[-1].doubtful))
            parts.clear()
        plain = 0

    for text, tag, ends, rest in tokens_of(html):
        top = stack.items[-1]
        if text is not None:
            if not top.aside:
                parts.append(text)
                if not top.link:
                    plain += len(text.strip())
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close()
        if ends:
            stack.end(tag)
            continue
        if tag in VOID or tag == "path":
            continue
        if tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd"):
            stack.end_implied(tag)
        _, aside, content, link, doubtful, named = stack.items[-1]
        if tag in ASIDE or (tag == "header" and not content):
            aside, named, doubtful = True, False, False
        elif not aside and named_aside(tag, rest):
            aside = named = True
            doubtful = False
        elif named and tag in CONTENT:
            aside, named, doubtful = False, False, True
        stack.push(Open(tag, aside, content or tag in CONTENT, link or tag == "a", doubtful, named))
    close()
    return lines


def spans_of(lengths: list[int]) -> list[tuple[int, int]]:
    """Lines between each surge and the dive after it: a surge is where the sum over a window goes over
    SURGE, a dive where a whole window holds nothing. Lines before a surge that are joined to it without
    such a gap belong to it."""
    n, out, i = len(lengths), [], 0
    sums = [sum(lengths[j : j + WINDOW]) for j in range(n)]
    while i < n:
        if sums[i] == 0 or lengths[i] == 0:
            i += 1
            continue
        dive = next((j for j in range(i + 1, n) if sums[j] == 0), n)
        if max(sums[i:dive]) > SURGE:
            out.append((i, dive))
        i = dive
    return out


def main_text(html: str | None) -> str:
    """The main text of one page; empty for a null or empty page or one without text. A page too short
    for any surge gives its longest run of lines. Articles inside an element that is an aside by its name
    alone count only where the page has no other text. The work grows with the page, unclosed markup
    or not."""
    every = lines_of(html or "")
    lines = [line for line in every if not line.doubtful] or every
    marked = any(line.content and line.plain for line in lines)
    lengths = [(len(line.text) if line.content else 0) if marked else line.plain for line in lines]
    spans = spans_of(lengths)
    if not spans and any(lengths):
        first = next(i for i, x in enumerate(lengths) if x)
        last = len(lengths) - next(i for i, x in enumerate(reversed(lengths)) if x)
        spans = [(first, last)]
    return " ".join(lines[i].text for a, b in spans for i in range(a, b) if not marked or lines[i].content)


def text_of_pages(html: str | Column) -> Column:
    """The main text of whole pages, as a column: an expression of one column, so repeated rows give equal
    texts, all rows and other columns stay, and an empty table stays empty. No shuffle; a task keeps one
    batch of pages."""

    def batch_of(batch: pa.Array) -> pa.Array:
        return pa.array(map(main_text, batch.to_pylist()), pa.string())

    return per_batch(lambda: batch_of, "string")(html)
