"""Routing policies: choices scored against rewards, and linear or tanh heads over embeddings."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def route_accuracy(rm: DataFrame, choices: DataFrame) -> DataFrame:
    """(n_scored, n_hits, accuracy): share of known choices (doc_id, agent) that are among a task's best; others are skipped."""
    top = rm.groupBy("doc_id").agg(F.max("n_correct").alias("top"))
    own = rm.join(choices, ["doc_id", "agent"]).join(top, "doc_id")
    g = own.agg(F.count("*").alias("n_scored"), F.coalesce(F.sum((F.col("n_correct") == F.col("top")).cast("long")), F.lit(0)).alias("n_hits"))
    return g.select("n_scored", "n_hits", F.when(F.col("n_scored") == 0, 0.0).otherwise(F.col("n_hits") / F.col("n_scored")).alias("accuracy"))


def routed_reward(rm: DataFrame, choices: DataFrame, repetitions: int) -> DataFrame:
    """(n_scored, reward): mean reward of the chosen agents."""
    g = rm.join(choices, ["doc_id", "agent"]).agg(F.count("*").alias("n_scored"), F.coalesce(F.sum("n_correct"), F.lit(0)).alias("c"))
    return g.select("n_scored", F.when(F.col("n_scored") == 0, 0.0).otherwise(F.col("c") / (F.col("n_scored") * repetitions)).alias("reward"))


def linear_logits(embedding: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Array of one logit for each agent, as one expression."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    dot = lambda w: F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return F.array(*(dot(w) + F.lit(float(b)) for w, b in zip(weights, bias)))


def first_best(logits: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is 1; zeros if none is."""
    on = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    total = F.aggregate(on, F.transform(tokens[0], lambda _: F.lit(0.0)), lambda s, t: F.zip_with(s, t["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(on).cast("double"), F.lit(1e-6)))


def parameter_count(dim: int, agents: int, hidden: int = 0) -> int:
    return dim * agents + agents if hidden == 0 else dim * hidden + hidden + hidden * agents + agents


def unflatten(theta: np.ndarray, dim: int, agents: int, hidden: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers (weights, biases) of a flat parameter vector; one for a linear head, two with a tanh layer."""
    if len(theta) != parameter_count(dim, agents, hidden):
        raise ValueError("parameter vector has the wrong length")
    shapes = [(dim, agents)] if hidden == 0 else [(dim, hidden), (hidden, agents)]
    layers, at = [], 0
    for n, m in shapes:
        layers.append((theta[at : at + n * m].reshape(m, n), theta[at + n * m : at + n * m + m]))
        at += n * m + m
    return layers


def logits(theta: np.ndarray, x: np.ndarray, agents: int, hidden: int = 0) -> np.ndarray:
    layers = unflatten(theta, x.shape[1], agents, hidden)
    for k, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if k < len(layers) - 1:
            x = np.tanh(x)
    return x


def evolve(loss: Callable[[np.ndarray], float], dim: int, sigma: float = 0.5, generations: int = 60, seed: int = 42) -> tuple[np.ndarray, float]:
    """CMA-ES with full covariance; keeps the strictly best vector seen.

    The covariance is decomposed as often as its learning rates call for, every 1 / (10 dim (c1 + cmu)) generations; in between
    its updates are kept as vectors, so that a large head needs no matrix at all before that.
    """
    rng = np.random.default_rng(seed)
    lam = 4 + int(3 * np.log(dim))
    mu = lam // 2
    w = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
    w /= w.sum()
    mueff = 1 / (w**2).sum()
    cc, cs = (4 + mueff / dim) / (dim + 4 + 2 * mueff / dim), (mueff + 2) / (dim + mueff + 5)
    c1 = 2 / ((dim + 1.3) ** 2 + mueff)
    cmu = min(1 - c1, 2 * (mueff - 2 + 1 / mueff) / ((dim + 2) ** 2 + mueff))
    gap = max(1, int(1 / (10 * dim * (c1 + cmu))))
    damp = 1 + 2 * max(0, np.sqrt((mueff - 1) / (dim + 1)) - 1) + cs
    chi = np.sqrt(dim) * (1 - 1 / (4 * dim) + 1 / (21 * dim**2))
    mean, pc, ps = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    cov, vec, root = None, None, np.ones(dim)  # None: the identity
    kept, updates = 1.0, []
    best, least = mean.copy(), loss(mean)
    for g in range(generations):
        if g and g % gap == 0:
            cov = kept * (np.eye(dim) if cov is None else cov)
            for share, v in updates:
                cov += share * np.outer(v, v)
            kept, updates = 1.0, []
            val, vec = np.linalg.eigh(cov)
            root = np.sqrt(np.maximum(val, 1e-20))
        step = rng.normal(size=(lam, dim)) * root
        step = step if vec is None else step @ vec.T
        xs = mean + sigma * step
        losses = np.array([loss(x) for x in xs])
        order = np.argsort(losses, kind="stable")
        if losses[order[0]] < least:
            best, least = xs[order[0]].copy(), float(losses[order[0]])
        y = step[order[:mu]]
        move = w @ y
        mean = mean + sigma * move
        white = move / root if vec is None else vec @ ((vec.T @ move) / root)
        ps = (1 - cs) * ps + np.sqrt(cs * (2 - cs) * mueff) * white
        turn = float(np.linalg.norm(ps) / np.sqrt(1 - (1 - cs) ** (2 * (g + 1))) < (1.4 + 2 / (dim + 1)) * chi)
        pc = (1 - cc) * pc + turn * np.sqrt(cc * (2 - cc) * mueff) * move
        kept *= 1 - c1 - cmu
        updates = [(share * (1 - c1 - cmu), v) for share, v in updates] + [(c1, pc.copy())] + [(cmu * own, v) for own, v in zip(w, y)]
        sigma *= float(np.exp((cs / damp) * (np.linalg.norm(ps) / chi - 1)))
    return best, least


def train_head(x: np.ndarray, rewards: np.ndarray, hidden: int = 0, sigma: float = 0.5, generations: int = 60, seed: int = 42) -> np.ndarray:
    """Parameters of a head that maximises the mean reward of its first-best choices."""
    k = rewards.shape[1]
    rows = np.arange(len(x))
    return evolve(lambda t: -float(rewards[rows, logits(t, x, k, hidden).argmax(axis=1)].mean()), parameter_count(x.shape[1], k, hidden), sigma, generations, seed)[0]


def pick_col(theta: np.ndarray, embedding: Column, agents: int, hidden: int = 0) -> Column:
    """0-based first-best agent of a head for each embedding, by Arrow batch."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(logits(theta, np.stack(x), agents, hidden).argmax(axis=1) if len(x) else [], dtype="int32")

    return run(embedding)


def head_report(theta: np.ndarray, x: np.ndarray, rewards: np.ndarray, hidden: int = 0) -> dict[str, float | bool]:
    """Reward of the head against uniform, best fixed and oracle; it beats the best fixed agent only if strictly better."""
    got = float(rewards[np.arange(len(x)), logits(theta, x, rewards.shape[1], hidden).argmax(axis=1)].mean())
    fixed = float(rewards.mean(axis=0).max())
    return {"router": got, "uniform": float(rewards.mean()), "best_fixed": fixed, "oracle": float(rewards.max(axis=1).mean()), "beats_best_fixed": got > fixed}


def head_summary(scored: DataFrame, agents: int) -> DataFrame:
    """head_report() of a table (pick, rewards: one for each agent) in one row; all null without rows."""
    own = F.avg(F.element_at("rewards", F.col("pick") + 1)).alias("router")
    each = [F.avg(F.col("rewards")[k]).alias(f"m{k}") for k in range(agents)]
    g = scored.agg(own, F.avg(F.array_max("rewards")).alias("oracle"), *each)
    means = [F.col(f"m{k}") for k in range(agents)]
    g = g.select("router", (sum(means[1:], means[0]) / agents).alias("uniform"), F.array_max(F.array(*means)).alias("best_fixed"), "oracle")
    return g.withColumn("beats_best_fixed", F.col("router") > F.col("best_fixed"))


def training_rows(rewards: DataFrame, tasks: DataFrame, least: int = 10) -> DataFrame:
    """Rewards (task_id, ...) with their prompts; those without a task or with a blank prompt are dropped.  Fewer than ``least`` are an error."""
    prompts = tasks.where(F.trim(F.coalesce("prompt", F.lit(""))) != "").select("task_id", "prompt")
    out = rewards.join(prompts, "task_id")
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rewards have a prompt")
    return out


def fallback_split(n: int, seed: int = 42, share: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Positions (train, test) of a permutation; at least one is test."""
    order = np.random.default_rng(seed).permutation(n)
    test = max(1, round(share * n))
    return order[test:], order[:test]


def save_head(folder: str | Path, theta: np.ndarray, agents: Sequence[str], dim: int, hidden: int = 0, report: dict | None = None) -> Path:
    """Parameters as .npy, a manifest, and both in a zip file; returns the zip file's path."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    np.save(folder / "head.npy", theta.astype(np.float32))
    manifest = {"agents": list(agents), "dim": dim, "hidden": hidden, "parameters": len(theta), "report": report or {}}
    (folder / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=1))
    with zipfile.ZipFile(folder / "head.zip", "w") as z:
        for name in ("head.npy", "manifest.json"):
            z.write(folder / name, name)
    return folder / "head.zip"
