"""HTML to blocks: a table function over the standard library's parser.

The walk takes headings, paragraphs, list items and quotations in document order
and does not descend into them; scripts, navigation and the like are pruned.  An
unclosed paragraph ends where the next block begins.  A reference that was cut off
before its semicolon is text, save ``&amp``.  Of what is taken, the rules
below keep the article: its root, its title, the path of headings above each
block, quotations with their attribution, and no boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is taken, and what is pruned with all it holds.
TAKEN = ("h1", "h2", "h3", "h4", "p", "li", "blockquote")
PRUNED = ("script", "style", "nav", "aside", "footer", "form", "figure", "table")
#: Headings at which the article ends, and lines that are no prose.
STOP = (
    "related", "related content", "related posts", "related articles", "similar articles", "keep reading", "read more", "read this next", "read more next", "you might also like", "you may also like",
    "more from", "more stories", "author", "share", "subscribe", "newsletter", "up next", "recommended", "explore more", "continue reading",
)
LITERAL = ("share", "copied", "tags", "written by", "subscribe", "sign up", "listen")
#: Verbs that make a paragraph with a quoted span a quotation.
VERBS = ("said", "says", "say", "commented", "comments", "comment", "added", "adds", "noted", "notes", "stated", "states")

_SPACE = re.compile(r"\s+")
_PILLAR = re.compile(r"^(Principle|Pillar|Mission)\s+\d+", re.I)
_MINUTES = re.compile(r"\d+\s*minutes?( read)?")
_DATE = re.compile(r"[a-z]+\.?\s+\d{1,2},?\s+\d{4}")
_ATTRIBUTION = re.compile(r"^[-‐-―]\s*\S")
_QUOTED = re.compile(r"[“”\"][^“”\"]{20,}[“”\"]")
_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(;?)")


@dataclass
class Element:
    tag: str
    text: str
    bold: bool  # all of it is one bold child
    main: bool  # it is in the first <main>
    article: bool  # it is in the first <article>


@dataclass
class _Open:
    tag: str
    parts: list[str] = field(default_factory=list)
    bold: list[str] = field(default_factory=list)  # text of each bold child
    other: bool = False  # there is text outside of bold children


class Walker(HTMLParser):
    """The elements of one page, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.page_title = ""
        self._pruned = self._bold = 0
        self._depth = {"main": 0, "article": 0}
        self._seen = {"main": 0, "article": 0}
        self._open: _Open | None = None
        self._titling = False

    def _close(self) -> None:
        if (o := self._open) is not None and (text := _clean("".join(o.parts))):
            inside = {t: self._depth[t] > 0 and self._seen[t] == 1 for t in self._depth}
            self.elements.append(Element(o.tag, text, len(o.bold) == 1 and not o.other, inside["main"], inside["article"]))
        self._open, self._bold = None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self._titling = True
        if tag in PRUNED:
            self._pruned += 1
        elif tag in self._depth:
            self._close()
            if not self._depth[tag]:
                self._seen[tag] += 1
            self._depth[tag] += 1
        elif not self._pruned and tag in TAKEN and not (self._open and self._open.tag == "blockquote"):
            self._close()
            self._open = _Open(tag)
        elif self._open is not None:
            self._open.parts.append(" ")
            if tag in ("b", "strong"):
                self._bold += 1
                if self._bold == 1:
                    self._open.bold.append("")

    def handle_endtag(self, tag):
        if tag == "title":
            self._titling = False
        if tag in PRUNED:
            self._pruned = max(0, self._pruned - 1)
        elif tag in self._depth:
            self._close()
            self._depth[tag] = max(0, self._depth[tag] - 1)
        elif self._open is not None and tag == self._open.tag:
            self._close()
        elif self._open is not None:
            self._open.parts.append(" ")
            if tag in ("b", "strong"):
                self._bold = max(0, self._bold - 1)

    def handle_data(self, data):
        if self._titling:
            self.page_title += data
        elif not self._pruned and self._open is not None:
            self._open.parts.append(data)
            if not self._bold and data.strip():
                self._open.other = True


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).replace("(opens in a new window)", "").strip()


def _whole(m: re.Match) -> str:
    """The reference as it is, or the ampersand of one that was cut off written as text."""
    name, end = m.groups()
    if name.startswith("amp") or end and (name[0] == "#" or name + end in html5):
        return m[0]
    return f"&amp;{name}{end}"


def walked(html: str) -> Walker:
    w = Walker()
    w.feed(_REFERENCE.sub(_whole, html or ""))
    w.close()
    w._close()
    return w


def content_root(elements: list[Element]) -> str:
    """The first <main>, else the first <article>, that has three paragraphs or list items; else the body."""
    for root in ("main", "article"):
        if sum(e.tag in ("p", "li") for e in elements if getattr(e, root)) >= 3:
            return root
    return "body"


def still_open(text: str) -> bool:
    """Whether a quotation is open at the end: by the last curly mark, or the parity of plain ones."""
    first, last = text.rfind("“"), text.rfind("”")
    return text.count('"') % 2 == 1 if first == last == -1 else first > last


def merged_quotes(texts: list[str], most: int = 4, verbs: tuple[str, ...] = VERBS) -> list[str]:
    """Paragraphs with an attributed, open quotation absorb up to ``most`` following ones until it closes."""
    return [e.text for e in _merged([Element("p", t, False, False, False) for t in texts], most, verbs)]


def _merged(elements: list[Element], most: int, verbs: tuple[str, ...]) -> list[Element]:
    verb = _any_of(verbs)
    out, i = [], 0
    while i < len(elements):
        e, taken = elements[i], 0
        if e.tag == "p" and verb.search(e.text):
            while still_open(e.text) and taken < most and i + 1 < len(elements) and elements[i + 1].tag == "p":
                i, taken = i + 1, taken + 1
                e = Element("p", f"{e.text} {elements[i].text}", False, e.main, e.article)
        out.append(e)
        i += 1
    return out


def _any_of(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(" + "|".join(map(re.escape, words)) + r")\b", re.I)


def is_boilerplate(text: str) -> bool:
    low = text.strip().lower()
    if not low or low in LITERAL or low.startswith("listen") or _MINUTES.fullmatch(low) or _DATE.fullmatch(low):
        return True
    return len(text.strip()) < 100 and not re.search(r"[.!?]", text) and not _ATTRIBUTION.match(text)


def page_blocks(html: str, verbs: tuple[str, ...] = VERBS) -> list[tuple[str, list[str], str]]:
    """(position, heading path, text) of the article: its title first, then its blocks."""
    page = walked(html)
    root = content_root(page.elements)
    own = [e for e in page.elements if root == "body" or getattr(e, root)]
    first = next((i for i, e in enumerate(own) if e.tag == "h1"), None)
    title = own[first].text if first is not None else next((e.text for e in page.elements if e.tag == "h1"), _clean(page.page_title))
    headings = {e.text for e in own if e.tag[0] == "h"}
    often = Counter(e.text for e in own if e.tag in ("p", "li"))
    repeated = lambda t: often[t] >= 2 and len(t) < 150
    verb = _any_of(verbs)
    out: list[tuple[str, list[str], str]] = [("title", [], title)] if title else []
    stack: list[tuple[int, str]] = []

    def heading(level: int, text: str) -> None:
        nonlocal stack
        stack = [h for h in stack if h[0] < level]
        out.append(("pillar_name" if _PILLAR.match(text) else "section_heading", [h[1] for h in stack], text))
        stack.append((level, text))

    def block(position: str, text: str) -> None:
        out.append((position, [h[1] for h in stack], text))

    elements = _merged(own[first + 1 :] if first is not None else own, 4, verbs)
    i = 0
    while i < len(elements):
        e = elements[i]
        i += 1
        if e.tag[0] == "h":
            if e.tag == "h1" or e.text.lower() in STOP:
                break  # what follows belongs to other articles
            heading(int(e.tag[1]), e.text)
        elif e.tag == "blockquote":
            text = e.text
            if i < len(elements) and elements[i].tag == "p" and elements[i].text == text:
                i += 1
            if i < len(elements) and elements[i].tag == "p" and _ATTRIBUTION.match(elements[i].text):
                text = f"{text} {elements[i].text}"
                i += 1
            block("quotation", text)
        elif e.tag == "li":
            if len(e.text) >= 30 and e.text not in headings and not repeated(e.text):
                block("body", e.text)
        elif e.bold and len(e.text) < 100 and e.text[-1] not in ".!?":
            heading(3, e.text)
        elif _ATTRIBUTION.match(e.text):
            if out and out[-1][0] == "quotation":
                out[-1] = (*out[-1][:2], f"{out[-1][2]} {e.text}")
        elif not (is_boilerplate(e.text) or e.text in headings or repeated(e.text)):
            block("quotation" if _QUOTED.search(e.text) and verb.search(e.text) else "body", e.text)
    return out


BLOCKS_DDL = "page_id bigint, ord int, position string, heading_path array<string>, text string"


def parse_pages(pages: DataFrame, verbs: tuple[str, ...] = VERBS) -> DataFrame:
    """``BLOCKS_DDL`` of ``page_id, html``, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *block) for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, block in enumerate(page_blocks(html, verbs))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "ord", "position", "heading_path", "text"])

    return pages.select("page_id", "html").mapInArrow(run, BLOCKS_DDL)


def roots(pages: DataFrame) -> DataFrame:
    """``page_id, root, n``: the content root of each page, and the paragraphs and list items in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html in b.column(1).to_pylist():
                elements = walked(html).elements
                root = content_root(elements)
                out.append((root, sum(e.tag in ("p", "li") for e in elements if root == "body" or getattr(e, root))))
            yield pa.record_batch([b.column(0), pa.array([r for r, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["page_id", "root", "n"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, root string, n bigint")


def publication_date(html: Column) -> Column:
    """The first date (yyyy-MM-dd) of: four meta tags and the time element, in this order, or "Published <day month year>" in the text."""
    iso = lambda tag: F.nullif(F.regexp_extract(F.regexp_extract(html, tag, 0), r"(?:content|datetime)=[\"'][^\"']*?(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    named = lambda kind, name: iso(rf"(?is)<meta\b[^>]*\b{kind}=[\"']{name}[\"'][^>]*>")
    tags = [named("property", "article:published_time"), named("name", "date"), named("name", r"DC\.date\.issued"), named("property", "og:updated_time"), iso(r"(?is)<time\b[^>]*\bdatetime=[^>]*>")]
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    said = F.regexp_extract(text, r"Published\s*:?\s*(\d{1,2}\s+\w+\s+\d{4})", 1)
    return F.coalesce(*tags, F.date_format(F.try_to_timestamp(F.regexp_replace(said, r"\s+", " "), F.lit("d MMMM yyyy")), "yyyy-MM-dd"))
