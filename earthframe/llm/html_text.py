"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to a list of blocks: the runs of text between block-level tags, each with the share of it that stands in links.
The characters of each block outside links are summed over sliding windows of three blocks. A stretch of the page begins where this sum
surges above a threshold and ends where it dives to nothing; all of them are kept, and all blocks of a page without any.
Blocks inside navigation, forms, notices, comments, scripts and the like never count. Where the page marks an article, all text
in it counts and nothing beside it. An element that looks like no part of the text but encloses the only articles
of the page doesn't count as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthframe.llm.bytesets import texts
from earthframe.llm.rows import arrow_map

WINDOW = 3
#: Characters in a window from which it surges.
SURGE = 40

#: Element names of HTML.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "title",
       "annotation", "annotation-xml")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "wbr", "img",
          "math", "semantics", "maction", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded",
          "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable",
          "mtd", "mtext", "mtr", "munder", "munderover")
ASIDE = ("nav", "footer", "aside", "form", "button", "menu", "dialog")
MAIN = ("article", "main")

#: Words in a class, id or role that mark an element as no part of the main text, if a whole name is made of them
#: and of words for a part of a page.
NOISE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget complementary contentinfo search".split())
PART = frozenset(
    "area bar block bottom box button buttons column container desktop footer form group header holder icon icons inner item "
    "items left link links list main mobile outer page panel primary right secondary section site slot text title top unit "
    "wrap wrapper".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    noise: bool
    article: int  # number of the article element around it, 0 outside
    aside: bool  # the article stands inside noise


def _is_noise(name: str, attributes: str, in_article: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article):
        return True
    return name not in ("html", "body", *MAIN) and any(
        not NOISE.isdisjoint(words := _WORD.findall(mark)) and NOISE.union(PART).issuperset(words)
        for m in _MARK.findall(attributes) for mark in _CAMEL.sub("-", next(filter(None, m), "")).lower().split())


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; unclosed and misplaced tags are borne."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    open_: list[tuple[str, bool, int, int]] = []  # element, whether it begins noise, article and noise around that outside it
    noise = article = articles = links = beyond = 0

    def close_block() -> None:
        nonlocal parts, linked
        text = _WHITE.sub(" ", unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append(Block(text, min(linked, len(text)), noise > beyond, article, beyond > 0))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    at = 0
    while True:
        tag = _TAG.search(html, at)
        if tag is None:
            add(html[at:])
            break
        add(html[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if not tag[1] and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            close_block()
            continue
        if name == "a":
            links = 0 if tag[1] else 1
        if name in INLINE:
            continue
        close_block()
        if name in VOID:
            continue
        if not tag[1]:
            begins = _is_noise(name, tag[3], article > 0)
            if begins or noise or name in MAIN:  # other elements change nothing when they end
                open_.append((name, begins, article, beyond))
            noise += begins
            if name in MAIN and not article:
                articles += 1
                article, beyond = articles, noise
        elif any(x[0] == name for x in open_):
            while True:
                last, begun, article, beyond = open_.pop()
                noise -= begun
                if last == name:
                    break
            links = 0
    close_block()
    return out


def surges(lengths: list[int]) -> list[tuple[int, int]]:
    """Runs of blocks (start, stop) from a surge of the window sums to the next dive."""
    sums = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    runs, i = [], 0
    while i < len(sums):
        if sums[i] >= SURGE and lengths[i] > 0:
            stop = i
            while stop < len(sums) and sums[stop] > 0:
                stop += 1
            while stop > i and lengths[stop - 1] == 0:
                stop -= 1
            runs.append((i, stop))
            i = stop
        i += 1
    return runs


def main_text(html: str) -> str:
    """Main text of one page; empty if there is none."""
    page = blocks(html)
    marked = [b for b in page if b.article and not b.noise]
    inside = [b for b in marked if not b.aside] or marked
    considered = inside or page
    lengths = [0 if b.noise or 2 * b.linked > len(b.text) else len(b.text) for b in considered]
    kept = surges(lengths)
    if inside:
        # The page says where its article is: what stands between its surges counts too, but for blocks of links.
        held = {i for a, z in kept for i in range(a, z)} or set(range(len(considered)))
        return " ".join(b.text for i, b in enumerate(considered) if lengths[i] or i in held)
    kept = kept or [(0, len(considered))]
    return " ".join(b.text for a, z in kept for b, n in zip(considered[a:z], lengths[a:z], strict=True) if n)


def _extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found = [main_text(h.as_py()) for h in texts(batch.column("html"))]
    yield pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
         pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html and pages without main text give an empty text. Each row is read alone, so repeated
    rows, null ids and null urls stay as they are.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return arrow_map(rows, _extract, "page_id bigint, url string, text string, n_chars bigint")
