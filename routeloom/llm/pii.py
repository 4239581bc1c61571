"""Operator 6: personal identifiers behind disguises, with exact places in the source.

A text passes through transducers, each of which keeps for every character it
writes the source characters that it stands for:

1. homoglyphs: full-width, Greek and Cyrillic look-alikes and foreign digits
   become ASCII; invisible characters go;
2. spelled digits: four or more digit words (English, German, French, Spanish) or
   digits in a row become digits, at least two of them words;
3. at and dot: bracketed forms, "name at host dot com", "first.last at host.com" (a
   name with a dot, digit or underscore) and blanks around "@".  Without brackets the
   ending has to be a listed one (_TLD).

Identifiers are found in the normalised text, and each span is mapped back to
the source.  Kinds: email, ip, card (13 to 19 digits with Luhn's check digit), ssn,
iban (with its check digits), phone, secret (value of a named key, or at least 32
hexadecimal digits).  Where found spans overlap, the kind named first in KINDS stays, then
the longer and the first one.

Defined cases: null and empty texts, and empty tables, have none.  Each row is read by
itself and to its end, in time that grows with its length, so repeated rows give repeated
results; a null doc_id is kept, other ids have to be numbers.  Other columns, whatever
their names, are ignored.  Offsets count characters (code points) from 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

KINDS = ("email", "iban", "ip", "secret", "card", "ssn", "phone")

_LOOK = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXoav"))
_LOOK |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFF01, 0xFF5F), 0xFE52, 0xFE6B, 0xFF61)}
_LOOK |= {"․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " "}
_LOOK |= {chr(b + k): str(k) for b in (0x660, 0x6F0, 0x966, 0xFF10, *range(0x1D7CE, 0x1D800, 10)) for k in range(10)}
_HIDDEN = "­​‌‍⁠﻿"
_ODD = re.compile("[" + re.escape("".join(_LOOK)) + _HIDDEN + "]")
_UNSEEN = re.compile(f"[{_HIDDEN}]")
_TABLE = str.maketrans(_LOOK)

_DIGITS = {}
for _k, _w in enumerate(("zero oh null zéro cero", "one eins ein un une uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")):
    for _x in _w.split():
        _DIGITS[_x] = str(_k)
_ONE = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r"|\d)"
_GAP = r"(?:[ \t]++(?:[-,.·/][ \t]*+)?|[-,.·/][ \t]*+)"
_SPELLED = re.compile(rf"(?<!\w){_ONE}(?:{_GAP}{_ONE}){{3,}}(?!\w)", re.I)
_PIECE = re.compile(r"[^\W\d]+|\d|[ \t,·/]+|[-.]")

_OPEN, _SHUT = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*+)"
_DOT = rf"(?:{_OPEN}(?:dot|punto|point|punkt|\.){_SHUT}|\s++dot\s++)"
#: Top-level domains with which "name at host dot com" is read as an address without any brackets.
_TLD = "(?:com|org|net|edu|gov|mil|info|biz|io|ai|app|dev|me|tv|co|eu|uk|us|ca|au|nz|ie|de|at|ch|fr|be|nl|lu|es|pt|it|mx|ar|br|cl|pl|cz|se|no|fi|dk|ru|ua|tr|gr|jp|cn|kr|in|za|example|test)"
_ANY = rf"(?:{_DOT}|\.)"
#: What stands for "@": bracketed, with blanks, or the bare word, which asks for more on both sides.
_AT = re.compile(rf"{_OPEN}(?:at|@|arroba|chez){_SHUT}|(?<!\s)\s?@\s?|(?<!\s)(?P<bare>\s++at\s++)", re.I)
_HOST = re.compile(rf"{_LABEL}(?:{_ANY}{_LABEL})++", re.I)
_BARE_HOST = re.compile(rf"{_LABEL}(?:\.{_LABEL})*(?:{_DOT}(?:{_LABEL}{_ANY})*{_TLD})(?![\w-])", re.I)
_PLAIN_HOST = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.{_TLD}(?![\w-]|\.\w)", re.I)
#: Of a text read backwards: the words and dots of a name.
_EMAN = re.compile(r"[\w+%-]++(?:(?:\.|\s?[\])}>]\s?(?:tod|otnup|tniop|tknup|\.)\s?[\[({<]\s?|\s++tod\s++)[\w+%-]++)*+", re.I)
_DOT_PART = re.compile(_DOT, re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s?(?:at|arroba|chez)\s?[\])}}>]", re.I)
_BEHIND_AT = re.compile(rf"\s++(?:{_BARE_HOST.pattern}|{_PLAIN_HOST.pattern})", re.I)
_WORDS = re.compile(r"\w+")
_NAMED = ("token", "secret", "passw", "key")

_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]++(?:\.[\w+%-]++)*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+)\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![a-z0-9])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\s*+[:=]\s*+[\"']?([A-Za-z0-9_+/=.-]{8,})", re.I)
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")
_SSN = re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?![\w-])")


class View:
    """Text with the source span of each character; without arrays it is the source itself."""

    __slots__ = ("end", "start", "text")

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def replaced(self, edits: list[tuple[int, int, str]]) -> View:
        """With disjoint spans replaced, in order; each written character stands for its whole span."""
        if not edits:
            return self
        size = len(self.text)
        start = np.arange(size) if self.start is None else self.start
        end = np.arange(1, size + 1) if self.end is None else self.end
        text, at = [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            at = b
        a, b, long = (np.array(x, np.int64) for x in ([e[0] for e in edits], [e[1] for e in edits], [len(e[2]) for e in edits]))
        turn = np.zeros(size + 1, np.int64)
        np.add.at(turn, a, 1)
        np.add.at(turn, b, -1)
        stays = np.cumsum(turn[:-1]) == 0
        behind = np.repeat(np.cumsum(a - np.append(0, b[:-1])), long)
        put = lambda kept, new: np.insert(kept[stays], behind, np.repeat(new, long))
        some = b > a
        return View("".join([*text, self.text[at:]]), put(start, np.where(some, start[np.minimum(a, size - 1)], 0)), put(end, np.where(some, end[np.maximum(b - 1, 0)], 0)))


def homoglyphs(v: View) -> View:
    if v.text.isascii() or not _ODD.search(v.text):
        return v
    v = View(v.text.translate(_TABLE), v.start, v.end)  # one for one
    return v.replaced([(m.start(), m.end(), "") for m in _UNSEEN.finditer(v.text)])


def _spells(text: str) -> bool:
    """Whether four words in a row are digits: without, nothing is spelled."""
    return "1111" in "".join("1" if w in _DIGITS or (len(w) == 1 and w.isdecimal()) else "0" for w in _WORDS.findall(text.lower()))


def _addresses(text: str) -> bool:
    """Whether anything may stand for the sign of an address: a look at each "at" in place of a search for all forms."""
    if "@" in text or (any(c in text for c in "[({<") and _BRACKETED.search(text)):
        return True
    low = text.lower()
    if len(low) != len(text):
        return True
    k = low.find("at")
    while k >= 0:
        if low[k - 1 : k].isspace() and low[k + 2 : k + 3].isspace() and _BEHIND_AT.match(text, k + 2):
            return True
        k = low.find("at", k + 2)
    return False


def spelled_digits(v: View) -> View:
    if not _spells(v.text):
        return v
    edits = []
    for m in _SPELLED.finditer(v.text):
        pieces = [(p.start() + m.start(), p.end() + m.start(), p[0]) for p in _PIECE.finditer(m[0])]
        if sum(p[2].lower() in _DIGITS for p in pieces) < 2:
            continue
        for a, b, p in pieces:
            if p.lower() in _DIGITS:
                edits.append((a, b, _DIGITS[p.lower()]))
            elif not p.isdigit() and p not in "-.":
                edits.append((a, b, ""))
    return v.replaced(edits)


def _name_start(text: str, back: str, stop: int) -> int:
    """Where the name that ends at stop begins: as far to the left as its words and dots go; stop if there is none."""
    m = _EMAN.match(back, len(text) - stop)
    if not m:
        return stop
    a = len(text) - m.end()
    while a < stop and a and (text[a - 1] in ".+%-" or text[a - 1].isalnum() or text[a - 1] == "_"):  # begins within a word: goes on to the next one
        d = _DOT_PART.search(text, a, stop)
        a = d.end() if d else stop
    return a


def at_and_dot(v: View) -> View:
    if not _addresses(v.text):
        return v
    text, back, edits, done = v.text, None, [], 0
    for at in _AT.finditer(text):
        if at.start() < done:
            continue
        end = at.end()
        host = (_BARE_HOST if at["bare"] else _HOST).match(text, end)
        plain = None if host or not at["bare"] else _PLAIN_HOST.match(text, end)
        if not (host or plain):
            continue
        back = back if back is not None else text[::-1]
        begin = max(_name_start(text, back, at.start()), done)
        if begin >= at.start() or (plain and not re.search(r"[.\d_]", text[begin : at.start()])):
            continue
        done = (host or plain).end()
        own = [(d.start(), d.end(), ".") for a, b in ((begin, at.start()), (end, done)) for d in _DOT_PART.finditer(text, a, b)]
        edits += [x for x in sorted([*own, (at.start(), end, "@")]) if text[x[0] : x[1]] != x[2]]
    return v.replaced(edits)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def detect(text: str) -> list[tuple[int, int, str]]:
    """(from, to, kind) in a normalised text, disjoint and in order."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if re.search(r"\d[\d.]", text):
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if iban_ok(m[0])]
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)]
        found += [(m.start(), m.end(), "secret") for m in _HEX.finditer(text)]
        for m in _CARD.finditer(text):
            if luhn(re.sub(r"\D", "", m[0])):
                found.append((m.start(), m.end(), "card"))
        found += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
        for m in _PHONE.finditer(text):
            n, plain = sum(c.isdigit() for c in m[0]), m[0].isdigit()
            if (m[0][0] == "+" and 8 <= n <= 15) or (not plain and 9 <= n <= 15) or (plain and 10 <= n <= 11):
                found.append((m.start(), m.end(), "phone"))
    low = text.lower()
    if any(x in low for x in _NAMED):
        found += [(m.start(1), m.end(1), "secret") for m in _KEY.finditer(text)]
    found.sort(key=lambda x: (KINDS.index(x[2]), x[0] - x[1], x[0]))
    taken, kept = bytearray(len(text)), []
    for a, b, kind in found:
        if taken.find(1, a, b) < 0:
            taken[a:b] = bytes([1]) * (b - a)
            kept.append((a, b, kind))
    return sorted(kept)


def identifiers(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, normalised identifier); text[start:stop] is its source."""
    if not text:
        return []
    v = at_and_dot(spelled_digits(homoglyphs(View(text))))
    return [(kind, *v.source(a, b), v.text[a:b]) for a, b, kind in detect(v.text)]


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, stop, identifier) of each identifier."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch, "text", 4 << 20):
                out = [(d, *x) for d, text in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist()) for x in identifiers(text)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "kind", "start", "stop", "identifier"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, kind string, start int, stop int, identifier string")
