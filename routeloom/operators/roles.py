"""Roles of agents: prompt templates, output grammars, and rewards by role."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.operators.collection import messages, verifier_truth

VERIFIER_GRAMMAR = r"^(ACCEPT|REVISE)\b"


@dataclass(frozen=True)
class Role:
    id: str
    template: str | None = None
    output_grammar: str | None = None

    def messages(self, query: str, transcript: str = ""):
        return messages(query, self.template, transcript=transcript)

    def fits(self, text: str) -> bool:
        return self.output_grammar is None or re.match(self.output_grammar, text) is not None

    def fits_col(self, text: Column) -> Column:
        return F.lit(True) if self.output_grammar is None else F.coalesce(text.rlike(self.output_grammar), F.lit(False))


def by_id(roles: list[Role], role_id: str) -> Role:
    for r in roles:
        if r.id == role_id:
            return r
    raise KeyError(f"no role {role_id!r}")


def role_rewards(calls: DataFrame, repetitions: int) -> DataFrame:
    """(task_id, agent, role, n_correct, mean_reward) of calls that name their role."""
    g = calls.where("role is not null").groupBy("task_id", "agent", "role").agg(F.sum(F.col("correct").cast("long")).alias("n_correct"))
    return g.withColumn("mean_reward", F.col("n_correct") / repetitions)


def verifier_rewards(judgments: DataFrame) -> DataFrame:
    """With ``verifier_correct`` for judgments (judgment, worker_correct): ACCEPT is right exactly for a correct worker."""
    return judgments.withColumn("verifier_correct", F.col("judgment") == verifier_truth(F.col("worker_correct")))
