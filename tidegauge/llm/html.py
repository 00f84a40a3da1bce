"""The main text of a web page, by line-block distribution.

Markup is stripped into lines, one for each block of the page that has text; inline tags split no line. Menus, headers, footers, sidebars, notices, adverts, forms, comments and everything hidden
are lines of length 0, and so is what stands outside of the article where the page names one. Blocks without text are
lines beside these only: between two lines of text they are none, as they end no article. The text lengths of a
window of WINDOW lines from each line on are summed. Text surges where such a sum exceeds SURGE and dives where it
falls to 0; what lies between is kept. In a named article any text surges, however short, as its name says that it
belongs there. If nothing surges, the run of lines with the most text is kept.

A class or id names a part that is not the article only as a whole: each of its words must be such a name (NAMED) or
say nothing (PLAIN), so that `related-posts` is left out and `social-history` stays.

Cases: a null or empty page, or one of boilerplate only, has no text. Unclosed elements end with what holds them;
a page may break off anywhere, and a tag without its end takes the rest of the page, as in a browser. Whole pages are read, of any length. Repeated rows are extracted each by itself,
and further columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table

WINDOW = 3
SURGE = 86
#: A line is a menu's, on pages that name no article, if links hold more than this share of its text.
LINKS = 0.5

RAW = "script|style|noscript|template|textarea|select|datalist|svg|annotation|iframe|object|button|title|canvas|audio|video"
SKIPPED = {"nav", "footer", "aside", "form", "dialog", "menu", "head", "fieldset"}
MAIN = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr input picture source math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msup msub msubsup mover munder munderover mfenced mpadded mphantom".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another block ends.
OPEN_ENDED = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of a class or id that name a part that is not the article.
NAMED = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adunit adbox sponsor sponsors sponsored promo promos promotion promoted banner cookie cookies consent gdpr notice notification notifications alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars side rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer comment comments commentlist disqus respond reply replies discussion "
    "share sharing sharebar social related recommended recommendation recommendations widget widgets toolbar pagination pager copyright disclaimer form forms search skiplink hidden".split()
)
#: Words that say nothing beside these.
PLAIN = set(
    "site page main top bottom left right box list container wrapper wrap block section area bar link links button buttons btn icon icons item items inner outer unit slot zone google primary secondary global mobile desktop sticky fixed js "
    "content text label title head body author meta avatar thread group row col column panel card message media image img logo policy privacy contact user reader visually posts articles stories topics reading news facebook twitter x dialog up".split()
)
#: Names that are also what an article may have parts about, or its own header: they say nothing within it.
OF_ARTICLES = {"search", "header", "form", "forms", "notice", "side", "rail", "alert", "banner", "discussion", "copyright", "disclaimer"}
#: Names that an article element itself may have without being the page's.
OF_AN_ARTICLE = {"ad", "ads", "comment", "comments", "reply", "replies", "related"}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: What follows a tag's name: quotes hold a value only after `=`, anywhere else they are letters as any other.
REST = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<svg\b[^<>]*/>|<(?P<raw>{RAW})\b{REST}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>{REST})(?:>|\Z)|</?\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def names_other(value: str, allowed: set[str] = frozenset()) -> bool:
    """Whether a class or id has a token that names a part that is not the article; names that are allowed do not count."""
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        joined = "".join(words)
        if joined in NAMED and joined not in allowed:
            return True
        if any(w in NAMED and w not in allowed for w in words) and all(w in NAMED or w in PLAIN for w in words):
            return True
    return False


def unwanted(name: str, rest: str, in_main: bool) -> bool:
    """Whether an element is no part of the article, by its name or attributes."""
    if name in SKIPPED or (name == "header" and not in_main):
        return True
    if not rest or name in ("body", "html"):
        return False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"' ")
        if key in ("class", "id"):
            if name in MAIN:
                if name == "article" and names_other(value, NAMED - OF_AN_ARTICLE):
                    return True
            elif names_other(value, OF_ARTICLES if in_main else frozenset()):
                return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Lines:
    """The lines of a page: text, how much of it is in links, whether it is in an article, whether it is wanted."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.text: list[str] = []
        self.linked = self.mark = 0
        self.stack: list[tuple[str, bool, bool]] = []  # name, unwanted, in an article
        self.links = 0
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            if m["name"]:
                self.tag(m["name"].lower(), bool(m["end"]), m["rest"])
        if at < len(page):
            self.add(page[at:])
        self.flush()

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def add(self, raw: str) -> None:
        text = html.unescape(raw)
        self.text.append(text)
        if self.links:
            self.linked += len("".join(text.split()))

    def flush(self) -> None:
        skip, inside = self.state()
        if skip and self.stack[-1][0] in INLINE:  # an unwanted part that nothing ended; what stands before it stays
            self.stack.pop()
            self.text, (skip, inside) = self.text[: self.mark], self.state()
        self.lines.append((" ".join("".join(self.text).split()), self.linked, inside, not skip))
        self.text, self.linked, self.mark = [], 0, 0

    def tag(self, name: str, end: bool, rest: str) -> None:
        if name == "br" or name == "hr":
            self.text.append(" ")
            return
        if name in INLINE:
            if name == "a":
                self.links = 0 if end else 1
            skip, inside = self.state()
            if end:
                if self.stack and self.stack[-1][0] == name:
                    self.part()
                    self.stack.pop()
            elif name not in VOID and (skip and self.stack[-1][0] == name or unwanted(name, rest, inside)):
                self.part()
                self.stack.append((name, True, inside))
            return
        self.flush()
        if name in VOID:
            return
        if end:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    del self.stack[i:]
                    break
            return
        while self.stack and (self.stack[-1][0] in OPEN_ENDED and (self.stack[-1][0] == name or self.stack[-1][0][0] in "ph") or self.stack[-1][0] in INLINE):
            self.stack.pop()
        skip, inside = self.state()
        self.stack.append((name, skip or unwanted(name, rest, inside), inside or name in MAIN))

    def part(self) -> None:
        """Ends the text of an unwanted inline element without ending its line."""
        if self.state()[0]:
            self.text = self.text[: self.mark]
        self.mark = len(self.text)


def kept(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The runs of lines between a surge and a dive."""
    n, runs, i = len(lengths), [], 0
    total = sum(lengths[:window])
    sums = []
    for j in range(n):
        sums.append(total)
        total += (lengths[j + window] if j + window < n else 0) - lengths[j]
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        runs.append((i, j, max(sums[i:j]), sum(lengths[i:j])))
        i = j
    surging = [r for r in runs if r[2] > surge]
    return [r[:2] for r in surging or sorted(runs, key=lambda r: -r[3])[:1]]


def main_text(page: str | None) -> str:
    """The article's text: its blocks in page order, joined by one space."""
    lines = Lines(page or "").lines
    named = any(text and inside and wanted for text, _, inside, wanted in lines)

    def length(line: tuple[str, int, bool, bool]) -> int:
        text, linked, inside, wanted = line
        other = not inside if named else linked > LINKS * len(text.replace(" ", ""))
        return len(text) if wanted and not other else 0

    stretches = ((live, list(run)) for live, run in groupby(lines, lambda line: length(line) > 0))
    lines = [line for live, run in stretches if live or any(text for text, *_ in run) for line in run]
    lengths = [length(line) for line in lines]
    return " ".join(lines[i][0] for start, stop in kept(lengths, surge=0 if named else SURGE) for i in range(start, stop) if lengths[i])


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns of each page and `text`, its main text."""
    source = pages.select(*keep, F.col(html_column).alias("__html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(page.as_py()) for page in part.column("__html")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return source.mapInArrow(run, schema)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
