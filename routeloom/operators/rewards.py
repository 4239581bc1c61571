"""Calls to rewards: the reward matrix in long form, its winners, and its per-task records.

All scores are integer counts of correct calls until one final division by the
fixed number of repetitions, so ties are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def reward_matrix(calls: DataFrame, agents: Sequence[str]) -> DataFrame:
    """(doc_id, agent, pos, n_correct, n_empty, n_error, n_calls), zero-filled for agents that a task has no call of; cost_usd, too, if calls have it.

    One pass: counts of all agents are conditional sums of one aggregation by task, laid out as rows afterwards.
    """
    def counts(agent: str) -> Column:
        own = F.col("agent") == agent
        total = lambda c: F.sum(F.when(own & c, 1).otherwise(0)).cast("long")
        cost = [F.sum(F.when(own, F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0)).alias("cost_usd")] if "cost_usd" in calls.columns else []
        return F.struct(total(F.col("correct")).alias("n_correct"), total(F.col("is_empty")).alias("n_empty"), total(F.col("is_error")).alias("n_error"), total(F.lit(True)).alias("n_calls"), *cost)

    wide = calls.groupBy("doc_id").agg(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(k).alias("pos"), counts(a).alias("n")) for k, a in enumerate(agents))).alias("cells"))
    return wide.select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.agent", "c.pos", "c.n.*")


def winners(rm: DataFrame) -> DataFrame:
    """(doc_id, max_correct, min_correct, n_winners, best_agents, first_agent): winners of each task, exact on counts."""
    cells = F.sort_array(F.collect_list(F.struct("pos", "agent", "n_correct")))
    t = rm.groupBy("doc_id").agg(F.max("n_correct").alias("max_correct"), F.min("n_correct").alias("min_correct"), cells.alias("cells"))
    best = F.transform(F.filter("cells", lambda c: c["n_correct"] == F.col("max_correct")), lambda c: c["agent"])
    return t.select("doc_id", "max_correct", "min_correct", best.alias("best")).select("doc_id", "max_correct", "min_correct", F.size("best").cast("long").alias("n_winners"), F.array_join("best", ",").alias("best_agents"), F.element_at("best", 1).alias("first_agent"))


def best_positions(rewards: Column, tolerance: float = TOLERANCE) -> Column:
    """0-based positions of an array's maxima, by relative or absolute closeness."""
    top = F.array_max(rewards)
    near = lambda x: F.abs(x - top) <= F.greatest(tolerance * F.greatest(F.abs(x), F.abs(top)), F.lit(tolerance))
    return F.filter(F.transform(rewards, lambda x, i: F.when(near(x), i)), lambda i: i.isNotNull())


def rederived(rewards: DataFrame) -> DataFrame:
    """Reward records with best_agents and is_tie computed afresh; stored values are never trusted."""
    at = best_positions(F.col("mean_reward"))
    return rewards.withColumn("best_agents", F.transform(at, lambda i: F.col("agent_order")[i])).withColumn("is_tie", F.size("best_agents") > 1)


def records(calls: DataFrame, agents: Sequence[str], repetitions: int, pool_version: str) -> DataFrame:
    """Reward records (task_id, ...) of calls (task_id, agent, correct, ...)."""
    flat = calls.select(F.col("task_id").alias("doc_id"), "agent", "correct", F.col("empty").alias("is_empty"), F.col("error").isNotNull().alias("is_error"))
    cells = F.sort_array(F.collect_list(F.struct("pos", (F.col("n_correct") / repetitions).alias("r"))))
    mean = reward_matrix(flat, agents).groupBy("doc_id").agg(F.transform(cells, lambda c: c["r"]).alias("mean_reward"))
    own = calls.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in calls.columns if c != "task_id")))).alias("calls"))
    out = mean.join(own, mean["doc_id"] == own["task_id"]).select("task_id", F.lit(pool_version).alias("pool_version"), F.lit(repetitions).cast("long").alias("repetitions"), F.array(*map(F.lit, agents)).alias("agent_order"), "mean_reward", "calls")
    return rederived(out)


def calls_of(rewards: DataFrame) -> DataFrame:
    """Long-form calls of reward records."""
    return rewards.select("task_id", "pool_version", F.inline("calls"))


def matrix_of(rewards: DataFrame) -> DataFrame:
    """(task_id, agent, pos, reward) of reward records."""
    return rewards.select("task_id", F.posexplode(F.arrays_zip("agent_order", "mean_reward")).alias("pos", "c")).select("task_id", F.col("c.agent_order").alias("agent"), "pos", F.col("c.mean_reward").alias("reward"))
