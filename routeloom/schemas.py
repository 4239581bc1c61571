"""Schemas of the relations, closed vocabularies and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFFICULTIES = ("easy", "medium", "hard")
SPLITS = ("train", "validation", "test")
GROUPS = ("in_distribution", "held_out")
ANSWER_TYPES = ("multiple_choice", "numeric", "expression", "short_text", "verifier")

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


SOURCE = _struct(("dataset", _S, False), ("config", _S), ("split", _S, False), ("index", _L, False), ("license", _S, False), ("license_checked_on", _S), ("subject", _S), ("redistributable", _B, False))
TASK = _struct(*((n, _S, False) for n in ("task_id", "prompt", "answer", "answer_type", "grader", "domain", "difficulty", "split", "task_group")), ("source", SOURCE, False))
CALL = _struct(("agent", _S, False), ("repetition", _L, False), ("role", _S), ("raw_response", _S), ("extracted", _S), ("correct", _B, False), ("empty", _B, False), ("prompt_tokens", _L), ("completion_tokens", _L), ("cost_usd", _D), ("latency_ms", _L), ("generation_id", _S), ("error", _S))
REWARD = _struct(("task_id", _S, False), ("pool_version", _S, False), ("repetitions", _L, False), ("agent_order", T.ArrayType(_S), False), ("mean_reward", T.ArrayType(_D), False), ("best_agents", T.ArrayType(_S)), ("is_tie", _B), ("calls", T.ArrayType(CALL)))
ROLE_REWARD = _struct(("task_id", _S, False), ("agent", _S, False), ("role", _S, False), ("mean_reward", _D), ("verifier_judgment", _S), ("verifier_correct", _B), ("calls", T.ArrayType(CALL)))
AGENT = _struct(("index", _L, False), ("id", _S, False), ("slug", _S, False), ("is_reasoning_model", _B), ("context_window", _L), ("price_per_1m_prompt_usd", _D), ("price_per_1m_output_usd", _D), ("verified_at", _S), ("retired", _B))
GATE = _struct(("metric", _S, False), ("label", _S), ("direction", _S, False), ("continue_at", _D, False), ("stop_at", _D, False))
PUBLIC_ROW = _struct(*((n, _S) for n in ("task_id", "dataset", "domain", "difficulty", "split", "task_group", "pool_version")), ("agent_order", T.ArrayType(_S)), ("mean_reward", T.ArrayType(_D)), ("best_agents", T.ArrayType(_S)), ("is_tie", _B), ("repetitions", _L), *((n, T.ArrayType(_L)) for n in ("n_correct", "n_empty", "n_error")))


class IntegrityError(ValueError):
    """A relation breaks one of its constraints."""


def must_be_empty(violations: DataFrame, what: str) -> None:
    """Raises on the first violating row; costs one limited scan."""
    bad = violations.take(1)
    if bad:
        raise IntegrityError(f"{what}: {bad[0].asDict()}")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def task_violations(tasks: DataFrame) -> DataFrame:
    """(task_id, problem) of tasks with blank texts, malformed ids or values outside the vocabularies."""
    checks = [(_blank(c), f"blank {c}") for c in ("task_id", "prompt", "answer")]
    checks.append((F.length("task_id") - F.length(F.replace("task_id", F.lit("/"), F.lit(""))) != 2, "task_id needs two slashes"))
    checks += [(~F.coalesce(F.col(c).isin(*values), F.lit(False)), f"unknown {c}") for c, values in (("difficulty", DIFFICULTIES), ("split", SPLITS), ("task_group", GROUPS))]
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for test, name in checks)), lambda x: x.isNotNull())
    return tasks.select("task_id", F.explode(found).alias("problem"))


def reward_violations(rewards: DataFrame) -> DataFrame:
    """(task_id, problem) of rewards whose vectors don't fit their agent order."""
    n = F.size("agent_order")
    found = F.array(F.when(n != F.size("mean_reward"), F.lit("one reward per agent")), F.when(n != F.size(F.array_distinct("agent_order")), F.lit("agent named twice")))
    return rewards.select("task_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def one_agent_order(rewards: DataFrame) -> None:
    """All rewards must have the same agents in the same order."""
    if rewards.select("agent_order").distinct().limit(2).count() > 1:
        raise IntegrityError("rewards differ in their agent order")


def pool_problems(agents: list[dict]) -> list[str]:
    """Contract of an agent pool: unique ascending indices, unique ids, distinct resolved slugs among the active, sibling modes."""
    out = []
    index = [a["index"] for a in agents]
    if index != sorted(set(index)):
        out.append("indices must be unique and ascending")
    if len({a["id"] for a in agents}) < len(agents):
        out.append("ids must be unique")
    active = [a for a in agents if not a.get("retired")]
    slugs = [a["slug"] for a in active if not a["slug"].startswith("TBD")]
    if len(set(slugs)) < len(slugs):
        out.append("active agents must differ in their slugs")
    by = {a["id"]: a["slug"] for a in active if not a["slug"].startswith("TBD")}
    if {"open_direct", "open_reasoning"} <= set(by) and not sibling_modes(by["open_direct"], by["open_reasoning"]):
        out.append("open_direct and open_reasoning must be modes of one model")
    return out


def agent_by_id(agents: list[dict], agent_id: str) -> dict:
    """The agent of an id; one that isn't in the pool is an error."""
    for a in agents:
        if a["id"] == agent_id:
            return a
    raise KeyError(f"no agent {agent_id!r}")


def unknown_agents(wanted: DataFrame, agents: DataFrame) -> DataFrame:
    """Rows (id, ...) that name no agent of the pool."""
    return wanted.join(agents.select("id"), "id", "left_anti")


def sibling_modes(direct: str, reasoning: str) -> bool:
    return "-instruct" in direct and "-thinking" in reasoning and direct.replace("-instruct", "") == reasoning.replace("-thinking", "")
