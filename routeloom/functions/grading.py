"""Graders by name: Python functions, a registry open to users, and an Arrow-batched column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isclose

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .batches import pieces

Graded = tuple[str | None, bool]
Grader = Callable[[str, str], Graded]
_GRADERS: dict[str, Grader] = {}


def grader(name: str) -> Callable[[Grader], Grader]:
    """Registers a grader (response, answer) -> (extracted, correct)."""

    def add(f: Grader) -> Grader:
        if name in _GRADERS:
            raise ValueError(f"there is a grader {name!r} already")
        _GRADERS[name] = f
        return f

    return add


def known_graders() -> list[str]:
    return sorted(_GRADERS)


def _close(a: float, b: float) -> bool:
    return isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)


@grader("mcq_letter")
def mcq_letter(response: str, answer: str) -> Graded:
    got = t.extract("choice", response)
    return got, bool(got) and got == answer.strip().upper()


@grader("exact_match_ci")
def exact_match_ci(response: str, answer: str) -> Graded:
    got = t.extract("short_text", response)
    return got, got is not None and t.normalize_text(got) == t.normalize_text(answer)


@grader("numeric_match")
def numeric_match(response: str, answer: str) -> Graded:
    got = t.extract("number", response)
    if got is None:
        return None, False
    a, b = map(t.normalize_number, (got, answer))
    if a is None or b is None:
        return got, t.normalize_text(got) == t.normalize_text(answer)
    return got, _close(a, b)


@grader("math_expression")
def math_expression(response: str, answer: str) -> Graded:
    got = t.extract("expression", response)
    if got is None:
        return None, False
    a, b = map(t.normalize_number, (got, answer))
    return got, t.normalize_latex(got) == t.normalize_latex(answer) or (a is not None and b is not None and _close(a, b))


@grader("verifier_judgment")
def verifier_judgment(response: str, answer: str) -> Graded:
    """Whatever doesn't begin with ACCEPT is REVISE."""
    got = "ACCEPT" if t.strip_markup(response).strip().upper().startswith("ACCEPT") else "REVISE"
    return got, got == answer.strip().upper()


def grade(name: str, response: str | None, answer: str) -> Graded:
    if name not in _GRADERS:
        raise KeyError(f"no grader {name!r}; there are {known_graders()}")
    if not (response or "").strip():
        return None, False
    return _GRADERS[name](response, answer)


#: In place of a grader's name: this row has been graded by Columns.
_DONE = "\0"


def grades(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Structs of (name, response, answer), by pieces of the batches."""
    for batch in batches:
        for piece in pieces(*batch):
            got, right = zip(*((None, False) if n == _DONE else grade(n, r, a) for n, r, a in zip(*piece)))
            yield pa.StructArray.from_arrays([pa.array(got, pa.string()), pa.array(right, pa.bool_())], ["extracted", "correct"])


def grade_col(name: Column, response: Column, answer: Column) -> Column:
    """STRUCT(extracted, correct).  Letters and numbers of plain replies are graded by Spark's own functions, the rest by Arrow batch.

    Register own graders in a module that executors import.
    """

    @F.arrow_udf("extracted string, correct boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return grades(batches)

    plain = F.coalesce(t.is_plain(response) & t.is_plain(answer) & name.isin(*PLAIN_GRADERS), F.lit(False))
    graded = run(F.when(plain, _DONE).otherwise(name), F.when(~plain, response), F.when(~plain, answer))
    own = lambda g: PLAIN_GRADERS[g](response, answer)
    return F.when(~plain, graded).when(name == "mcq_letter", own("mcq_letter")).otherwise(own("numeric_match"))


def _struct(response: Column, got: Column, correct: Column) -> Column:
    blank = F.trim(response) == ""
    return F.struct(F.when(~blank, got).alias("extracted"), F.coalesce(~blank & got.isNotNull() & correct, F.lit(False)).alias("correct"))


def _plain_letter(response: Column, answer: Column) -> Column:
    got = t.choice_col(response)
    return _struct(response, got, got == F.upper(t.stripped_col(answer)))


def _plain_number(response: Column, answer: Column) -> Column:
    got = t.figure_col(response)
    a, b = t.number_col(got), t.number_col(answer)
    same = t.normalize_text_col(got) == t.normalize_text_col(answer)
    return _struct(response, got, F.when(a.isNull() | b.isNull(), same).otherwise(t.close_col(a, b)))


#: Graders that Columns can express for plain replies.
PLAIN_GRADERS: dict[str, Callable[[Column, Column], Column]] = {"mcq_letter": _plain_letter, "numeric_match": _plain_number}


def texts(f: Callable[[str], str | None], batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """f of each text, by pieces of the batches; null stays null."""
    for batch in batches:
        for (piece,) in pieces(batch):
            yield pa.array([None if x is None else f(x) for x in piece], pa.string())


def text_col(f: Callable[[str], str | None], value: Column) -> Column:
    """One of the text functions as a column; null stays null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return texts(f, batches)

    return run(value)


def fingerprint(prompt: str) -> str:
    """SHA-1 of the normalised prompt."""
    return hashlib.sha1(t.normalize_text(prompt).encode()).hexdigest()


def fingerprint_col(prompt: Column) -> Column:
    """SHA-1 of the normalised prompt, with NFKC and casefold, by Arrow batch; no text comes back from Python."""
    return text_col(fingerprint, prompt)


def ascii_fingerprint_col(prompt: Column) -> Column:
    """SHA-1 of the normalised prompt by Spark's own functions: equal to fingerprint_col wherever NFKC and casefold do no more than lower."""
    return F.sha1(t.normalize_text_col(prompt))
