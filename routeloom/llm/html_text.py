"""Operator 3: main text of HTML pages by two-pass block rules.

A page falls into blocks at block-level tags; scripts, styles, comments and the
head give none.  The first pass decides by link density, length and the density
of stop words (of the page's language; without a known ``lang`` that of which
the page has most):

* bad: links make up more than LINKS of the characters, or a copyright sign, or
  a longer block with few stop words, or a block below SHORT characters with a link;
* good: longer than LONG characters and many stop words;
* near: many or some stop words at SHORT characters or more;
* short: below SHORT characters.

The second pass gives near and short blocks the label of the nearest good or bad
block.  At equal distance a heading takes the label of the one below; otherwise,
if they differ, near blocks become good and short ones bad, and so they do where
the page has no decided block.

Pages are read forward only, in time that grows with their length.

Defined cases: a null or empty page, or one without text, gives the empty text
and no blocks.  Stray ``<``, a tag without ``>`` and unknown entities are text; an
unclosed script or comment reaches to the end, and a head without end tag to the first
element that can't be in one.  A tag ends at the first ``>`` outside quotes; once a quote
within a tag is never closed, tags end at their first ``>`` from there on.  Ties of the
second pass are decided as told.  Each row is read by itself, so repeated rows give
repeated results; null ids and urls are kept, other ids have to be numbers; other columns,
whatever their names, are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

LINKS, SHORT, LONG, MANY, SOME = 0.2, 70, 200, 0.15, 0.08

STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its may more most no not of on one or other our out she so some such than that the their them then there these they this to two up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für haben hat ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder schon sein sich sie sind so über um und uns vom von vor war was wenn werden wie wir wird zu zum zur",
    "es": "a al como con de del desde donde el ella en entre era es esta este esto fue ha hay la las le lo los más me mi muy no nos o para pero por que qué se sin sobre son su sus también te tiene todo un una uno y ya",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais mes mon ne nos nous on ou par pas plus pour qu que qui sa se ses si son sont sur ta te tu un une vos votre vous y",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_HIDDEN = "script|style|noscript|template|svg|textarea|object"
# a head ends at its end tag, or before the first element that can't be in one
_IN_HEAD = "|".join(rf"<{x}\b[^>]*+>.*?(?:</{x}\s*+>|\Z)" for x in "script style noscript template title object".split())
_HEAD = rf"<head\b[^>]*+>(?:[^<]++|<!--.*?(?:-->|\Z)|{_IN_HEAD}|(?!</head\s*+>|<(?!(?:base|basefont|bgsound|link|meta|noframes|html|head)\b)[a-zA-Z])<)*+(?:</head\s*+>)?"
_HEAD_TAG = re.compile(_HEAD, re.S | re.I)
_MARK = re.compile(rf"<(?:(!--)|(head)\b|({_HIDDEN})\b|(/?)([a-zA-Z][a-zA-Z0-9]*+)|[!?])", re.I)
_TO_END = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_CLOSED = {x: re.compile(rf"</{x}\s*+>", re.I) for x in _HIDDEN.split("|")}
_HTML, _LANG = re.compile(r"<html\b([^>]*+)", re.I), re.compile(r"\blang\s*+=\s*+[\"']?([a-zA-Z]+)", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("heading", "links", "text")

    def __init__(self, text: str, links: int, heading: bool):
        self.text, self.links, self.heading = text, links, heading


def blocks(page: str) -> list[Block]:
    """Blocks with text, in order; blanks are single and links counts the characters within links."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    inside, heading = 0, False

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(html.unescape("".join(linked)).split())), heading))
        parts.clear()
        linked.clear()

    def put(text: str) -> None:
        if text:
            parts.append(text)
            if inside:
                linked.append(text)

    at, last, quoted = 0, page.rfind(">"), True
    while m := _MARK.search(page, at):
        if m[1]:
            put(page[at : m.start()])
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        if m.end() > last:
            break  # nothing ends behind it: text
        put(page[at : m.start()])
        if m[2]:
            at = _HEAD_TAG.match(page, m.start()).end()
            put(" ")
            continue
        if m[3]:
            end = _CLOSED[m[3].lower()].search(page, page.index(">", m.end()) + 1)
            at = end.end() if end else len(page)
            put(" ")
            continue
        whole = _TO_END.match(page, m.end()) if quoted and m[5] else None
        quoted = quoted and (whole is not None or not m[5])
        at = whole.end() if whole else page.index(">", m.end()) + 1
        if not m[5]:
            continue
        name, end = m[5].lower(), bool(m[4])
        if name == "a":
            inside = 0 if end else 1
        elif name in _BLOCK:
            close()
            if name[0] == "h" and name[1:].isdigit():
                heading = not end
            elif name != "br":
                heading = False
    put(page[at:])
    close()
    return out


def stop_words(page: str, found: list[Block]) -> frozenset[str]:
    tag = _HTML.search(page)
    m = tag and _LANG.search(tag[1])
    if m and m[1].lower() in _STOPS:
        return _STOPS[m[1].lower()]
    words = [w for b in found for w in _WORD.findall(b.text.lower())]
    return _STOPS[max(_STOPS, key=lambda k: (sum(w in _STOPS[k] for w in words), k))]


def first_pass(b: Block, stops: frozenset[str]) -> str:
    size = len(b.text)
    if b.links > LINKS * size or "©" in b.text:
        return "bad"
    if size < SHORT:
        return "bad" if b.links else "short"
    words = _WORD.findall(b.text.lower())
    density = sum(w in stops for w in words) / len(words) if words else 0.0
    if density >= MANY:
        return "good" if size > LONG else "near"
    return "near" if density >= SOME else "bad"


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """Whether each block is good."""
    n = len(labels)
    left, right = [-1] * n, [-1] * n
    last = -1
    for k in range(n):
        left[k] = last
        if labels[k] in ("good", "bad"):
            last = k
    last = -1
    for k in reversed(range(n)):
        right[k] = last
        if labels[k] in ("good", "bad"):
            last = k
    out = []
    for k, label in enumerate(labels):
        a, b = left[k], right[k]
        if label in ("good", "bad"):
            out.append(label == "good")
        elif a < 0 and b < 0:
            out.append(label == "near")
        elif b < 0 or (a >= 0 and k - a < b - k):
            out.append(labels[a] == "good")
        elif a < 0 or b - k < k - a or headings[k] or labels[a] == labels[b]:
            out.append(labels[b] == "good")
        else:
            out.append(label == "near")
    return out


def extract(page: str | None) -> tuple[str, int, int]:
    """Text of the good blocks, one a line, the number of blocks and of good ones."""
    if not page:
        return "", 0, 0
    found = blocks(page)
    stops = stop_words(page, found)
    good = second_pass([first_pass(b, stops) for b in found], [b.heading for b in found])
    return "\n".join(b.text for b, g in zip(found, good) if g), len(found), sum(good)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks, n_good) for every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch, "html", 4 << 20):
                got = [extract(x) for x in s.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column("page_id"), s.column("url"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], ["page_id", "url", "text", "n_blocks", "n_good"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(read, "page_id long, url string, text string, n_blocks int, n_good int")
