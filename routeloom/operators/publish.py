"""Publication: redacted rows without any text, the scan for leaks, and the manifest of agents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKERS = tuple(f'"{name}"' for name in ("answer", "prompt", "raw_response"))
MANIFEST = ("index", "id", "slug", "is_reasoning_model", "context_window", "price_per_1m_prompt_usd", "price_per_1m_output_usd", "verified_at")


def public_rows(rm: DataFrame, tasks: DataFrame, agents: Sequence[str], repetitions: int, pool_version: str, excluded_prefixes: Sequence[str] = ("rlpr",)) -> DataFrame:
    """One redacted row for each scored task: counts, rewards, winners and the task's labels, no text.

    A reward without its task fails the query that reads the rows.  Tasks whose id begins with an excluded prefix are left out.
    """
    cells = F.sort_array(F.collect_list(F.struct("pos", "agent", "n_correct", "n_empty", "n_error")))
    rows = rm.groupBy("doc_id").agg(cells.alias("c"))
    labels = tasks.select("doc_id", F.col("task_id").alias("_task"), "dataset", "domain", "difficulty", "task_group", *(["split"] if "split" in tasks.columns else []))
    column = lambda f: F.transform("c", lambda x: x[f].cast("long"))
    top = F.array_max(column("n_correct"))
    best = F.transform(F.filter("c", lambda x: x["n_correct"] == top), lambda x: x["agent"])
    missing = F.raise_error(F.concat(F.lit("a reward without its task: "), F.col("doc_id").cast("string")))
    j = rows.join(labels, "doc_id", "left").withColumn("task_id", F.when(F.col("_task").isNull(), missing.cast("string")).otherwise(F.col("_task")))
    for prefix in excluded_prefixes:
        j = j.where(~F.col("task_id").startswith(prefix))
    return j.select(
        "task_id", "dataset", "domain", "difficulty", *(["split"] if "split" in tasks.columns else []), "task_group", F.lit(pool_version).alias("pool_version"), F.array(*map(F.lit, agents)).alias("agent_order"),
        F.transform(column("n_correct"), lambda n: n / repetitions).alias("mean_reward"), best.alias("best_agents"), (F.size(best) > 1).alias("is_tie"), F.lit(repetitions).cast("long").alias("repetitions"),
        column("n_correct").alias("n_correct"), column("n_empty").alias("n_empty"), column("n_error").alias("n_error"),
    )


def leaking(lines: DataFrame) -> DataFrame:
    """Lines (value) that hold the name of a text field."""
    found = F.lit(False)
    for m in MARKERS:
        found = found | F.col("value").contains(m)
    return lines.where(found)


def agent_manifest(agents: DataFrame) -> DataFrame:
    active = agents.where(~F.coalesce("retired", F.lit(False)))
    return active.select(*(F.col(c).alias("agent_id" if c == "id" else c) for c in MANIFEST))
