"""Benchmark rows to tasks: one declarative mapper a source, all within Spark's own expressions.

``map_source`` gives each input row its task (or null) and the reason why there
is none; ``rows`` needs an ordinal column ``index`` that counts from 0.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.functions import text as t


@dataclass(frozen=True)
class Spec:
    """What is the same for all tasks of a source."""

    name: str
    dataset: str
    split: str
    domain: str
    difficulty: str  # unless a row has its own
    license: str
    answer_type: str
    grader: str
    redistributable: bool = True
    task_group: str = "in_distribution"
    config: str | None = None


@dataclass(frozen=True)
class Fields:
    """What a mapper finds in a row; a null prompt or answer means no task."""

    prompt: Column
    answer: Column
    subject: Column | None = None
    difficulty: Column | None = None
    answer_type: Column | None = None
    grader: Column | None = None
    error: Column | None = None


Mapper = Callable[[DataFrame], Fields]
REGISTRY: dict[str, tuple[Spec, Mapper]] = {}


def source(spec: Spec) -> Callable[[Mapper], Mapper]:
    def add(f: Mapper) -> Mapper:
        if spec.name in REGISTRY:
            raise ValueError(f"there is a source {spec.name!r} already")
        REGISTRY[spec.name] = (spec, f)
        return f

    return add


def first_field(rows: DataFrame, *names: str) -> Column:
    """The first of the fields that is there and neither null nor empty, as text; 0 and false count."""
    there = {f.name: f.dataType for f in rows.schema}
    found = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in there]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def truthy(rows: DataFrame, *names: str) -> Column:
    """As first_field, but numbers that are 0 and false count as absent."""
    there = {f.name: f.dataType for f in rows.schema}
    found = []
    for n in names:
        if n in there:
            c = F.col(f"`{n}`")
            if isinstance(there[n], T.NumericType):
                c = F.when(c != 0, c)
            elif isinstance(there[n], T.BooleanType):
                c = F.when(c, c)
            found.append(F.nullif(c.cast("string"), F.lit("")))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _full(c: Column) -> Column:
    """Trimmed text, null if that leaves nothing."""
    return F.nullif(F.trim(c), F.lit(""))


def _list(rows: DataFrame, *names: str) -> Column:
    there = {f.name for f in rows.schema}
    found = [F.when(F.size(F.col(n)) > 0, F.transform(F.col(n), lambda x: x.cast("string"))) for n in names if n in there]
    return F.coalesce(*found, F.array().cast("array<string>"))


def _key(rows: DataFrame, name: str, options: Column) -> Column:
    """Letter of a key column by its type: numbers are 0-based, booleans no key, texts as letter_col has it."""
    kind = {f.name: f.dataType for f in rows.schema}.get(name)
    if kind is None or isinstance(kind, T.BooleanType):
        return F.lit(None).cast("string")
    c = F.col(name)
    if isinstance(kind, T.IntegralType):
        return F.when((c >= 0) & (c < F.size(options)), F.substring(F.lit(t.LETTERS), (c + 1).cast("int"), F.lit(1)))
    return t.letter_col(c.cast("string"), options)


def _choice(question: Column, options: Column, letter: Column, **more: Column) -> Fields:
    ok = (F.size(options) >= 2) & question.isNotNull() & letter.isNotNull()
    return Fields(F.when(ok, t.mcq_prompt_col(question, options)), F.when(ok, letter), error=F.when(ok & (F.size(options) > len(t.LETTERS)), "mapper_error:ValueError"), **more)


def _optional(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


_AIME = Spec("aime2025_i", "opencompass/AIME2025", "test", "math", "hard", "MIT", "numeric", "numeric_match", config="AIME2025-I", task_group="held_out")


@source(_AIME)
@source(replace(_AIME, name="aime2025_ii", config="AIME2025-II"))
def aime(rows: DataFrame) -> Fields:
    cased = lambda *names: [x for n in names for x in (n, n.capitalize())]
    question = first_field(rows, *sorted(cased("question", "problem"), key=str.istitle))
    answer = truthy(rows, *cased("answer"), "solution", "final_answer")
    return Fields(t.prompt_col(_full(question), "numeric"), _full(answer))


@source(Spec("gsm8k", "openai/gsm8k", "test", "math", "easy", "MIT", "numeric", "numeric_match", config="main"))
def gsm8k(rows: DataFrame) -> Fields:
    raw = F.col("answer")
    last = F.replace(F.trim(F.substring_index(raw, "####", -1)), F.lit(","), F.lit(""))
    return Fields(t.prompt_col(_full(F.col("question")), "numeric"), F.when(raw.contains("####"), F.nullif(last, F.lit(""))))


@source(Spec("math500", "HuggingFaceH4/MATH-500", "test", "math", "hard", "MIT", "expression", "math_expression"))
def math500(rows: DataFrame) -> Fields:
    level = F.col("level").cast("int") if "level" in rows.columns and isinstance(rows.schema["level"].dataType, T.NumericType) else F.lit(None).cast("int")
    hard = F.when(level.isin(1, 2), "easy").when(level == 3, "medium").when(level.isin(4, 5), "hard")
    return Fields(t.prompt_col(_full(F.col("problem")), "expression"), _full(truthy(rows, "answer")), _optional(rows, "subject"), hard)


@source(Spec("mmlu", "cais/mmlu", "test", "knowledge", "medium", "MIT", "multiple_choice", "mcq_letter", config="all"))
def mmlu(rows: DataFrame) -> Fields:
    options = _list(rows, "choices")
    return _choice(_full(F.col("question")), options, _key(rows, "answer", options), subject=_optional(rows, "subject"))


@source(Spec("mmlu_pro", "TIGER-Lab/MMLU-Pro", "test", "knowledge", "hard", "CHECK-AT-COLLECTION", "multiple_choice", "mcq_letter"))
def mmlu_pro(rows: DataFrame) -> Fields:
    options = F.filter(_list(rows, "options"), lambda o: F.upper(F.trim(o)) != "N/A")
    own = F.when(truthy(rows, "answer").isNotNull(), _key(rows, "answer", options)).otherwise(_key(rows, "answer_index", options))
    return _choice(_full(F.col("question")), options, own, subject=_optional(rows, "category"))


@source(Spec("arc_challenge", "allenai/ai2_arc", "test", "reasoning", "medium", "CC-BY-SA-4.0", "multiple_choice", "mcq_letter", config="ARC-Challenge"))
def arc(rows: DataFrame) -> Fields:
    texts, labels = F.coalesce("choices.text", F.array().cast("array<string>")), F.coalesce("choices.label", F.array().cast("array<string>"))
    key = F.trim(F.coalesce("answerKey", F.lit("")))
    at = F.array_position(labels, key).cast("int")
    letter = F.when(at > 0, F.when(at <= len(t.LETTERS), F.substring(F.lit(t.LETTERS), at, F.lit(1)))).otherwise(t.letter_col(key, texts))
    return _choice(_full(F.col("question")), texts, F.when(F.size(texts) == F.size(labels), letter))


SCHOOL = {"easy": ("primary school", "junior high school"), "medium": ("senior high school",), "hard": ("university", "graduate", "phd")}


@source(Spec("rlpr", "openbmb/RLPR-Train-Dataset", "train", "reasoning", "hard", "Apache-2.0", "short_text", "exact_match_ci"))
def rlpr(rows: DataFrame) -> Fields:
    """The last user turn of a chat (or the plain prompt)."""
    prompt = F.col("prompt")
    if isinstance(rows.schema["prompt"].dataType, T.ArrayType):
        prompt = F.try_element_at(F.filter(prompt, lambda x: x["role"] == "user"), F.lit(-1))["content"]
    level = F.lower(F.trim(F.col("extra_info.difficulty").cast("string")))
    difficulty = F.coalesce(*(F.when(level.isin(*names), k) for k, names in SCHOOL.items()))
    answer = F.coalesce(*(F.nullif(F.col(f"reward_model.{n}").cast("string"), F.lit("")) for n in rows.schema["reward_model"].dataType.names if n in ("ground_truth", "answer")))
    subject = F.coalesce(F.nullif(_optional(rows, "ability"), F.lit("")), F.col("extra_info.category") if "category" in rows.schema["extra_info"].dataType.names else F.lit(None))
    return Fields(t.prompt_col(_full(prompt), "short"), _full(answer), subject, difficulty)


def _shuffled(index: Column) -> Column:
    """0 to 3 in the order that Python's generator gives them for a row."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for k in s:
                four = list(range(4))
                random.Random(f"gpqa/{k}").shuffle(four)
                out.append(four)
            yield pd.Series(out)

    return order(index)


@source(Spec("gpqa_diamond", "Idavidrein/gpqa", "train", "science", "hard", "CC-BY-4.0 (gated)", "multiple_choice", "mcq_letter", config="gpqa_diamond", task_group="held_out", redistributable=False))
def gpqa(rows: DataFrame, native: bool = False) -> Fields:
    """Options in a seeded order by row: Python's generator, or with ``native`` by digest."""
    given = F.array(*(_full(F.col(f"`{c}`").cast("string")) for c in ("Correct Answer", *(f"Incorrect Answer {k}" for k in (1, 2, 3)))))
    if native:
        keyed = F.transform(given, lambda o, i: F.struct(F.md5(F.concat_ws("/", F.col("index").cast("string"), i.cast("string"))).alias("k"), o.alias("o")))
        options = F.transform(F.array_sort(keyed), lambda x: x["o"])
    else:
        options = F.transform(_shuffled(F.col("index")), lambda i: F.get(given, i))
    whole = F.forall(given, lambda o: o.isNotNull())
    letter = F.substring(F.lit(t.LETTERS), F.array_position(options, F.get(given, F.lit(0))).cast("int"), F.lit(1))
    subject = F.coalesce(*(F.nullif(_optional(rows, c), F.lit("")) for c in ("Subdomain", "High-level domain")))
    return _choice(_full(F.col("Question")), options, F.when(whole, letter), subject=subject)


@source(Spec("turkish", "local:data/raw/turkish.jsonl", "test", "turkish", "medium", "INTERNAL-PENDING-APPROVAL", "multiple_choice", "mcq_letter", task_group="held_out", redistributable=False))
def turkish(rows: DataFrame) -> Fields:
    """Bilingual field names; without options a short text."""
    question, answer = _full(truthy(rows, "question", "soru")), _full(truthy(rows, "answer", "cevap"))
    options = _list(rows, "options", "secenekler")
    some = F.size(options) > 0
    letter = F.when(some, t.letter_col(answer, options))
    both = question.isNotNull() & answer.isNotNull()
    return Fields(
        F.when(both, F.when(some, F.when(letter.isNotNull(), t.mcq_prompt_col(question, options))).otherwise(t.prompt_col(question, "numeric"))),
        F.when(both, F.when(some, letter).otherwise(answer)),
        _optional(rows, "subject"), F.nullif(_optional(rows, "difficulty"), F.lit("")),
        F.when(some, "multiple_choice").otherwise("short_text"), F.when(some, "mcq_letter").otherwise("exact_match_ci"),
        F.when(both & letter.isNotNull() & (F.size(options) > len(t.LETTERS)), "mapper_error:ValueError"),
    )


def map_source(name: str, rows: DataFrame) -> DataFrame:
    """(index, task, reason) of each row; reason is null where there is a task."""
    spec, mapper = REGISTRY[name]
    f = mapper(rows)
    lit = lambda v: F.lit(v).cast("string")
    ref = F.struct(lit(spec.dataset).alias("dataset"), lit(spec.config).alias("config"), lit(spec.split).alias("split"), F.col("index").cast("long").alias("index"), lit(spec.license).alias("license"), lit(None).alias("license_checked_on"), (f.subject if f.subject is not None else lit(None)).cast("string").alias("subject"), F.lit(spec.redistributable).alias("redistributable"))
    either = lambda c, default: F.coalesce(c, F.lit(default)) if c is not None else F.lit(default)
    task = F.struct(
        F.format_string(f"{spec.name}/{spec.split}/%06d", F.col("index").cast("long")).alias("task_id"), f.prompt.alias("prompt"), f.answer.alias("answer"), either(f.answer_type, spec.answer_type).alias("answer_type"), either(f.grader, spec.grader).alias("grader"),
        F.lit(spec.domain).alias("domain"), either(f.difficulty, spec.difficulty).alias("difficulty"), F.lit("train").alias("split"), F.lit(spec.task_group).alias("task_group"), ref.alias("source"),
    )
    ok = f.prompt.isNotNull() & f.answer.isNotNull()
    reason = F.when(~ok, F.coalesce(f.error if f.error is not None else lit(None), F.lit("mapper_returned_none")))
    return rows.select(F.col("index"), F.when(ok, task).alias("task"), reason.alias("reason"))


