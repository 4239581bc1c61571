"""The five stages and the training of a head, end to end over files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions.grading import fingerprint_col
from routeloom.operators import analysis, collection, publish, rewards, routing, taskpool
from routeloom.schemas import IntegrityError, must_be_empty
from routeloom.sources import mappers, readers


def verify_pool(probes: DataFrame) -> tuple[bool, DataFrame]:
    """Gate 1 over probe calls: whether every agent passes, and the verdicts."""
    verdicts = collection.preflight(probes)
    return verdicts.where("verdict = 'FAIL'").limit(1).count() == 0, verdicts


@dataclass
class Built:
    tasks: DataFrame
    unavailable: dict[str, str] = field(default_factory=dict)
    stats: dict[str, DataFrame] = field(default_factory=dict)


def build_tasks(spark: SparkSession, limits: Mapping[str, int], rows: Mapping[str, DataFrame] | None = None, mirror: str = "", max_share: float = taskpool.MAX_SHARE, seed: int = taskpool.SEED, compat: bool = False) -> Built:
    """Load, map, limit, deduplicate, balance and split.  ``rows`` (with an ``index`` column) take the place of a source's files.

    Sources are read in the order of their names; one that can't be read is noted and left out.  ``compat`` draws with Python's
    generator as the original process did, on the driver, instead of by seeded digests.
    """
    built = Built(None)
    parts = []
    for name, limit in sorted(limits.items()):
        if limit <= 0:
            continue
        if name not in mappers.REGISTRY:
            built.unavailable[name] = "unknown source"
            continue
        spec = mappers.REGISTRY[name][0]
        try:
            raw = rows[name] if rows and name in rows else readers.read_source(spark, spec.dataset, spec.split, mirror)
        except readers.SourceUnavailable as e:
            built.unavailable[name] = str(e)
            continue
        mapped = readers.limited(mappers.map_source(name, raw), "index", F.col("reason").isNull(), limit)
        built.stats[name] = readers.map_stats(mapped, F.col("reason"))
        parts.append(mapped.where("reason is null").select("task.*"))
    if not parts:
        raise IntegrityError(f"no source could be read: {built.unavailable}")
    pool = taskpool.deduplicated(reduce(DataFrame.unionByName, parts), fingerprint_col(F.col("prompt")))
    pool = (taskpool.balanced_compat if compat else taskpool.balanced)(pool, max_share, seed)
    built.tasks = (taskpool.split_compat if compat else taskpool.split)(pool, seed=seed)
    must_be_empty(taskpool.leaks(built.tasks), "split leakage")
    return built


def collect_rewards(tasks: DataFrame, agents: Sequence[str], chat: collection.Chat, path: str, pool_version: str, repetitions: int = 3, resume: bool = True, store_raw: bool = True) -> DataFrame:
    """Calls of tasks that have no record yet, appended as reward records; all records so far are returned.

    Without ``resume`` an existing table is refused.  A task is appended as a whole or not at all.
    """
    spark = tasks.sparkSession
    if readers._exists(spark, path):
        if not resume:
            raise FileExistsError(path)
        done = spark.read.parquet(path)
        collection.must_fit(done, pool_version, agents, repetitions)
        tasks = collection.pending(tasks, done)
    calls = collection.collect(tasks, agents, chat, repetitions, store_raw=store_raw)
    readers.append_once(rewards.records(calls, agents, repetitions, pool_version), path, "task_id")
    return spark.read.parquet(path)


@dataclass
class Gate:
    decision: str
    verdicts: DataFrame
    per_agent: DataFrame
    accuracy: DataFrame
    baselines: DataFrame

    @property
    def stopped(self) -> bool:
        return self.decision in ("stop", "missing")


def gate_and_baselines(records: DataFrame, tasks: DataFrame, gates: DataFrame, split: str = "test") -> Gate:
    """Gate 3 over all records; baselines over those of one split.  The dataset of a task is its id up to the first slash."""
    first = records.select("agent_order", "repetitions").first()
    if first is None:
        raise IntegrityError("no reward records")
    agents, repetitions = first.agent_order, first.repetitions
    long = rewards.calls_of(records)
    calls = long.select(F.col("task_id").alias("doc_id"), "agent", "correct", F.col("empty").alias("is_empty"), F.col("error").isNotNull().alias("is_error"), "latency_ms", "cost_usd")
    rm = rewards.reward_matrix(calls, agents)
    datasets = records.select(F.col("task_id").alias("doc_id"), taskpool.dataset_of(F.col("task_id")).alias("dataset"))
    verdicts = analysis.gate_verdicts(analysis.long_metrics(analysis.health(rm, datasets, repetitions)), gates)
    held = rm.join(tasks.where(F.col("split") == split).select(F.col("task_id").alias("doc_id")), "doc_id", "left_semi")
    return Gate(analysis.gate_decision(verdicts).first().decision, verdicts, analysis.per_agent(rm, calls, repetitions), analysis.dataset_accuracy(rm, datasets, repetitions), analysis.baselines(held, repetitions))


def publish_rewards(records: DataFrame, tasks: DataFrame, folder: str | Path, excluded_prefixes: Sequence[str] = ("rlpr",)) -> int:
    """Redacted rows as one file of JSON lines, scanned for leaks after it is written; returns the number of rows."""
    first = records.select("agent_order", "repetitions", "pool_version").first()
    calls = rewards.calls_of(records).select(F.col("task_id").alias("doc_id"), "agent", "correct", F.col("empty").alias("is_empty"), (F.coalesce("error", F.lit("")) != "").alias("is_error"))
    labels = tasks.select(F.col("task_id").alias("doc_id"), "task_id", F.col("source.dataset").alias("dataset"), "domain", "difficulty", "split", "task_group")
    rows = publish.public_rows(rewards.reward_matrix(calls, first.agent_order), labels, first.agent_order, first.repetitions, first.pool_version, excluded_prefixes)
    n = readers.write_jsonl_file(rows, Path(folder) / "rewards.jsonl", "task_id")
    must_be_empty(publish.leaking(records.sparkSession.read.text(str(Path(folder) / "rewards.jsonl"))), "published text")
    return n


#: Records that a head is fitted on, at most: the search runs on the driver.
FIT_ROWS = 5000


def train_head(records: DataFrame, embeddings: DataFrame, tasks: DataFrame, folder: str | Path, generations: int = 60, seed: int = 42, fit_rows: int = FIT_ROWS) -> dict:
    """Trains a linear head on tasks outside the test split (a fallback split if either side is empty) and reports on all of the test split.

    At most ``fit_rows`` records, those of the least digests, are collected to fit the head; the report is computed where the records are.
    """
    matrix = records.join(embeddings.select("task_id", "embedding"), "task_id").join(tasks.select("task_id", F.coalesce("split", F.lit("")).alias("split")), "task_id")
    matrix = matrix.select("task_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), "mean_reward", "agent_order", (F.col("split") == "test").alias("test"))
    sides = {r.test: r.n for r in matrix.groupBy("test").agg(F.count("*").alias("n")).collect()}
    if sum(sides.values()) < 10:
        raise ValueError("fewer than 10 rewards have an embedding")
    if len(sides) < 2:
        ids = sorted(r.task_id for r in matrix.select("task_id").collect())  # ids only, of a pilot without splits
        _, at = routing.fallback_split(len(ids), seed)
        chosen = records.sparkSession.createDataFrame([(ids[k],) for k in at], "task_id string").withColumn("_t", F.lit(True))
        matrix = matrix.drop("test").join(chosen, "task_id", "left").withColumn("test", F.coalesce("_t", F.lit(False))).drop("_t")
    rows = sorted(matrix.where("not test").orderBy(F.md5("task_id")).limit(fit_rows).collect(), key=lambda r: r.task_id)
    agents = rows[0].agent_order
    theta = routing.train_head(np.array([a.embedding for a in rows], float), np.array([a.mean_reward for a in rows]), generations=generations, seed=seed)
    scored = matrix.where("test").select(routing.pick_col(theta, F.col("embedding"), len(agents)).alias("pick"), F.col("mean_reward").alias("rewards"))
    report = routing.head_summary(scored, len(agents)).first().asDict()
    routing.save_head(folder, theta, agents, len(rows[0].embedding), report=report)
    return report
