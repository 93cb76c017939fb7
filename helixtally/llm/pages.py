"""Main text of web pages by line-block distribution.

Markup is stripped so that every block is a line; page furniture leaves blank lines,
and link text counts for nothing. The text lengths of a few neighbouring lines are
summed over a sliding window: the sum surges where running text begins and dives to
nothing where it ends, and the text between is kept if a block of it has more text of
its own than link text, whatever else the page holds. Where a page marks its article,
only surges inside it count. Headings and paragraphs that are links belong to the text
they stand in or beside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines per block sum

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose content is no text of the page.
_RAW = {"script", "style", "template", "noscript", "textarea", "title", "svg", "iframe", "object", "math"}
#: Elements of page furniture.
_FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
#: Words in class, id or role that mark page furniture.
_MARK = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|header|masthead|footer|sidebar|aside|breadcrumbs?|pagination|pager"
    r"|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended"
    r"|comments?|replies|reply|respond|discussion|disqus|widget|toolbar|form|complementary|contentinfo|dialog)\Z",
    re.I,
)
#: Words that may stand beside such a mark in one name and don't make it the name of something else.
_BESIDE = set(
    "area bar bottom box block button buttons bottom card cell col container count fixed global group holder icon icons inner item items left links list"
    " main mobile outer page panel posts primary right row secondary section site slot sticky stories strip thread top unit wrap wrapper".split()
)
#: How a line of ownership begins; such a line is a footer.
_OWNER = re.compile(r"(?:copyright\s*)?(?:©|\(c\))\s*\S", re.I)
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_WHOLE = {"html", "body", "article", "main"}
#: Elements whose block belongs to the text beside it, be it all link.
_JOINING = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}


@dataclass
class Line:
    """A block of text; its own characters without those of links; the same less those of links, blanks left out; whether it stands in the article; its element."""

    text: list[str] = field(default_factory=list)
    own: int = 0
    excess: int = 0
    article: bool = False
    name: str = ""


def marked_furniture(attributes: str) -> bool:
    """Whether a class, id or role names page furniture: a name is one whole, so `share-buttons` does and `share-price` doesn't."""
    for value in _ATTRIBUTE.finditer(attributes):
        for name in html.unescape(value[1].strip("\"'")).lower().split():
            parts = [p for p in re.split("[-_]+", name) if p and not p.isdigit()]
            marks = [bool(_MARK.match(p)) for p in parts]
            if any(marks) and all(m or p in _BESIDE for m, p in zip(marks, parts, strict=True)):
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """A page's blocks in order, with blank lines for furniture."""
    lines, line = [], Line()
    at, links, article = 0, 0, 0
    skip, deep = "", 0  # the furniture element being left out, and how many of its name are open
    seen = False

    def broken() -> None:
        nonlocal line
        if line.text:
            lines.append(line)
        line = Line(article=article > 0)

    while at < len(page):
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text and not skip:
            line.text.append(text)
            line.excess += (-1 if links else 1) * len("".join(text.split()))
            if not links:
                line.own += len(text)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in _RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name != "svg" and name != "math":
                broken()
            continue
        if skip:
            if name == skip:
                deep += -1 if closing else 1
            opens = not closing and name in ("article", "main") and not seen
            if deep <= 0 or opens or (skip in ("p", "li") and name not in _INLINE and name not in _VOID):
                ended = name == skip and closing
                skip, deep = "", 0
                if ended:
                    continue
            else:
                continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in _INLINE and not _ATTRIBUTE.search(attributes):
            continue
        if not closing and name not in _WHOLE and name not in _VOID:
            if name in _FURNITURE or marked_furniture(attributes):
                if not attributes.endswith("/"):
                    skip, deep = name, 1
                broken()
                lines += [Line(article=article > 0) for _ in range(WINDOW)]
                continue
        if name in _INLINE:
            continue
        links = 0
        if name in ("article", "main"):
            broken()
            article = max(0, article + (-1 if closing else 1))
            seen = True
            line = Line(article=article > 0)
            if article == 0:
                lines += [Line() for _ in range(WINDOW)]
        else:
            broken()
            line.name = "" if closing else name
    broken()
    return lines


def main_text(page: str | None) -> str:
    """Blocks between surge and dive, white space as one space, joined by one space."""
    lines = lines_of(page or "")
    if any(x.article and x.own for x in lines):
        for x in lines:
            x.own = x.own if x.article else 0
            x.text = x.text if x.article else []
    texts = [" ".join(html.unescape("".join(x.text)).split()) for x in lines]
    marked = any(x.article for x in lines)
    joins = [bool(t) and x.name in _JOINING and (marked or not _OWNER.match(t)) for t, x in zip(texts, lines, strict=True)]
    lengths = [len(t) if (x.own or marked and j) and (marked or not _OWNER.match(t)) else 0 for t, x, j in zip(texts, lines, joins, strict=True)]
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    kept, at, done = [], 0, 0
    while at < len(lengths):
        if not lengths[at]:
            at += 1
            continue
        dive = at  # the surge begins here; it ends where a whole window has no text
        while dive < len(lengths) and sums[dive]:
            dive += 1
        if marked or any(n and x.excess > 0 for n, x in zip(lengths[at:dive], lines[at:dive], strict=True)):
            while at > done and joins[at - 1]:
                at -= 1
            while dive < len(lengths) and joins[dive] and not lengths[dive]:
                dive += 1
            kept += [t for t in texts[at:dive] if t]
            done = dive
        at = dive
    return " ".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    A null page is empty, and an empty one has the empty text. Rows are read one by
    one, repeated ones alike; other columns are not read.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(page) for page in part.column(2).to_pylist()]
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(batches, "page_id bigint, url string, text string, n_chars bigint")
