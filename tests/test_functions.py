"""Normalisation, extraction, grading and option letters, as functions and as columns."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeloom.functions import batches, grading
from routeloom.functions import text as t


@pytest.mark.parametrize(
    "name,response,answer,got,right",
    [
        ("mcq_letter", "Answer: b", "B", "B", True),
        ("mcq_letter", "I believe\nit is (C).", "c", "C", True),
        ("mcq_letter", "<answer>A</answer>", "A", "A", True),
        ("mcq_letter", "\\boxed{D}", "D", "D", True),
        ("mcq_letter", "I think the letter is E", "E", "E", True),
        ("mcq_letter", "nothing here", "A", None, False),
        ("numeric_match", "so #### 1,234", "1234", "1,234", True),
        ("numeric_match", "Answer: -5", "-5", "-5", True),
        ("numeric_match", "Answer -5", "5", "5", True),  # the hyphen counts as the label's separator
        ("numeric_match", "<delegate to=model-0731>x</delegate> it is 42", "42", "42", True),
        ("numeric_match", "<think>7</think> none", "7", None, False),
        ("numeric_match", "3.0000001", "3", "3.0000001", True),
        ("numeric_match", "3.1", "3", "3.1", False),
        ("numeric_match", "Answer: half", "HALF.", None, False),
        ("math_expression", "\\boxed{\\frac{1}{\\sqrt{2}}}", "$\\dfrac{1}{\\sqrt{2}}$", "\\frac{1}{\\sqrt{2}}", True),
        ("math_expression", "\\boxed{\\text{odd}}", "odd", "\\text{odd}", True),
        ("math_expression", "\\boxed{90^{\\circ}}", "90", "90^{\\circ}", True),
        ("math_expression", "\\boxed{unclosed", "x", "\\boxed{unclosed", False),
        ("exact_match_ci", "Sonuç: Ankara.", "ankara", "Ankara.", True),
        ("exact_match_ci", "first\n\n last line ", "LAST LINE", "last line", True),
        ("exact_match_ci", "Answer: Straße", "STRASSE", "Straße", True),
        ("exact_match_ci", "Answer:", "x", "Answer:", False),
        ("verifier_judgment", "accepted", "ACCEPT", "ACCEPT", True),
        ("verifier_judgment", "garbled", "ACCEPT", "REVISE", False),
        ("verifier_judgment", "", "REVISE", None, False),
    ],
)
def test_graders(name, response, answer, got, right):
    assert grading.grade(name, response, answer) == (got, right)


def test_unknown_and_blank():
    with pytest.raises(KeyError):
        grading.grade("nobody", "x", "y")
    assert grading.grade("mcq_letter", None, "A") == (None, False)
    assert "numeric_match" in grading.known_graders()
    with pytest.raises(ValueError):
        grading.grader("mcq_letter")(lambda a, b: (a, True))


@pytest.mark.parametrize("text,value", [("$1,234.50", 1234.5), ("(12)", -12.0), ("50%", 50.0), ("−7", -7.0), ("5.", 5.0), ("1_000", 1000.0), ("5d", None), ("", None), ("x", None)])
def test_numbers(text, value):
    assert t.normalize_number(text) == value


def test_first_line_of_a_label_ends_at_any_line_break():
    assert t.SIGNALS["label"]("Answer: x y") == "x"
    assert t.SIGNALS["label"]("answer the following") is None
    assert t.SIGNALS["label"]("Answer: 1\nfinal answer is 2") == "2"


def test_columns_agree_with_functions(spark):
    texts = ["Answer: b", "no", "SONUÇ: x y", "final answer is  7", "Answer:\nnext", "cevap - k", "<think>a\nb</think>x<answer>1</answer>", "  A.b..  "]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    c = F.col("x")
    for r in df.select("x", t.labelled_col(c).alias("l"), t.strip_markup_col(c).alias("m"), t.normalize_text_col(c).alias("n"), grading.text_col(t.normalize_text, c).alias("u")).collect():
        assert r.l == t.SIGNALS["label"](r.x), r.x
        assert r.m == t.strip_markup(r.x)
        assert r.u == t.normalize_text(r.x)
    numbers = ["$1,234.50", "(12)", "50%", "−7", "5d", "", "1e3", ".5"]
    for r in spark.createDataFrame([(x,) for x in numbers], "x string").select("x", t.number_col(c).alias("n")).collect():
        assert r.n == t.normalize_number(r.x)


def test_plain_replies_are_graded_alike(spark):
    """Spark's own graders against the Python ones, on replies put together from all that they look at, and on others that aren't plain."""
    rng = random.Random(7)
    pool = ["Answer: ", "answer is ", "FINAL  answer:", "cevap - ", "<answer>", "</answer>", "<think>", "</think>", "#### ", "1,234.5", "-7", "(12)", "B", "c ", "I", "\n", "\r\n", "\r", " ", "\t", "$", "%", ".", "half", "3", "1e3", "x", "_", "k.", "Answer -5", "é", "\\boxed{", "inf", "J,", "(E)"]
    rows = [(k, g, "".join(rng.choices(pool, k=rng.randint(0, 8))), "".join(rng.choices([*pool[9:15], "C", " j ", "half", "HALF.", "12", "1000"], k=rng.randint(0, 2)))) for k in range(1500) for g in ("mcq_letter", "numeric_match")]
    df = spark.createDataFrame(rows, "k int, g string, r string, a string")
    c = F.col
    got = df.select("k", "g", "r", "a", grading.grade_col(c("g"), c("r"), c("a")).alias("x"), (t.is_plain(c("r")) & t.is_plain(c("a"))).alias("plain")).collect()
    for r in got:
        assert tuple(r.x) == grading.grade(r.g, r.r, r.a), (r.g, r.r, r.a, r.plain)
    assert 0.3 < sum(r.plain for r in got) / len(got) < 0.9


OPTIONS = ["red", "green", "blue", " grey "]


@pytest.mark.parametrize("key", ["2", "4", "0", "5", "b", "E", "green", "grey", "pink", " d ", ""])
def test_letters(spark, key):
    want = {"2": "C", "4": "D", "0": "A", "5": None, "b": "B", "E": None, "green": "B", "grey": "D", "pink": None, " d ": "D", "": None}[key]
    assert t.letter_for(key, OPTIONS) == want
    df = spark.createDataFrame([(key, OPTIONS)], "k string, o array<string>")
    assert df.select(t.letter_col(F.col("k"), F.col("o"))).first()[0] == want


def test_letters_of_numbers():
    assert t.letter_for(1, OPTIONS) == "B" and t.letter_for(4, OPTIONS) is None and t.letter_for(True, OPTIONS) is None


def test_options_must_be_one_to_ten(spark):
    df = spark.createDataFrame([(["x"] * n,) for n in (0, 1, 10, 11)], "o array<string>")
    got = [r[0] for r in df.select(t.mcq_prompt_col(F.lit(" q "), F.col("o"))).collect()]
    assert [g is None for g in got] == [True, False, False, True] and got[1].startswith("Question: q\n\nA. x\n\n")


def peak(run):
    """What run() gives, and the most bytes of Python objects meanwhile; Arrow's own aren't among them."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pieces_keep_every_row_in_order():
    x, y = pa.array(["a" * k if k % 3 else None for k in range(50)]), pa.array(["\u00e9"] * 50)
    for limit in (1, 10, 100, 10**6):
        got = list(batches.pieces(x, y, limit=limit))
        assert [a for p in got for a in p[0]] == x.to_pylist() and [a for p in got for a in p[1]] == y.to_pylist()
        assert all(len(p[0]) == 1 or sum(len((a or "").encode()) + 2 for a in p[0]) <= limit for p in got)
    assert list(batches.pieces(pa.array([], pa.string()))) == [] and list(batches.pieces(pa.nulls(2))) == [[[None, None]]]


def test_fingerprints_hold_a_piece_of_a_batch():
    """400 texts of 60 kB in one Arrow batch."""
    rows = [f"{k} \u00c4\u00df.. " * 7_500 for k in range(1000, 1020)] * 20 + [None]
    batch = pa.array(rows)
    got, most = peak(lambda: [x for a in grading.texts(grading.fingerprint, iter([batch, batch])) for x in a.to_pylist()])
    one = {x: hashlib.sha1(t.normalize_text(x).encode()).hexdigest() for x in set(rows[:-1])}
    assert got == [one.get(x) for x in rows] * 2
    assert most < 15e6


def test_grades_hold_a_piece_of_a_batch():
    """400 replies of 60 kB in one Arrow batch."""
    replies = [("accept" if k % 2 else "hm") + " \u00c4" * 20_000 for k in range(20)] * 20 + [None, "Accepted"]
    batch = (pa.array(["verifier_judgment"] * 401 + [grading._DONE]), pa.array(replies), pa.array(["ACCEPT"] * 402))
    got, most = peak(lambda: [(x["extracted"], x["correct"]) for a in grading.grades(iter([batch])) for x in a.to_pylist()])
    assert got == [("REVISE", False), ("ACCEPT", True)] * 200 + [(None, False)] * 2
    assert most < 15e6
