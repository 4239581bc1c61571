"""Task pool: deduplicate, balance domains, split, and check the result.

Every step has a native form, which orders by a seeded MD5 digest and runs
anywhere, and a compatible one, which draws with Python's generator as the
original process did (per stratum, or on the driver where one generator runs
through all domains).
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RATIOS = dict(train=0.6, validation=0.2, test=0.2)
MAX_SHARE, SEED, SLACK = 0.30, 42, 1e-9


def seeded(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}/"), key))


def ranked(keys: DataFrame, groups: list[str], key: Column) -> DataFrame:
    """With ``rn``, the position in its group by (key, task_id) from 1 on, and ``n``, the group's size; key is a hexadecimal digest.

    No group is sorted as a whole: its rows fall into 4096 buckets by the first digits of the digest, ranks start behind
    the buckets before, and only buckets are sorted.
    """
    rows = keys.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_own"))
    w = Window.partitionBy(*groups)
    sizes = sizes.withColumn("_before", F.sum("_own").over(w.orderBy("_bucket")) - F.col("_own")).withColumn("n", F.sum("_own").over(w))
    sizes = sizes.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(groups)), F.col("_bucket").alias("_b"), "_before", "n")
    same = F.col("_bucket") == F.col("_b")
    for k, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    own = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_key", "task_id"))
    return rows.join(sizes, same).withColumn("rn", F.col("_before") + own).select(*keys.columns, "rn", "n")


def kept_fingerprints(tasks: DataFrame, fingerprint: Column) -> DataFrame:
    """(task_id, fingerprint): the least task id of each fingerprint."""
    return tasks.select("task_id", fingerprint.alias("fingerprint")).groupBy("fingerprint").agg(F.min("task_id").alias("task_id")).select("task_id", "fingerprint")


def deduplicated(tasks: DataFrame, fingerprint: Column) -> DataFrame:
    """The task of the least id of each fingerprint; task ids are unique.

    Ids are aggregated by fingerprint and joined back, so each prompt is normalised once and copies of one prompt don't meet in one task.
    """
    return tasks.join(kept_fingerprints(tasks, fingerprint).select("task_id"), "task_id", "left_semi")


def domain_shares(tasks: DataFrame) -> DataFrame:
    """(domain, n, share)."""
    n = tasks.groupBy("domain").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a domain


def effective_share(n_domains: int, max_share: float = MAX_SHARE) -> float:
    """No allocation can put all of n domains below 1/n."""
    return max(max_share, 1 / n_domains) if n_domains > 0 else max_share


def largest_cap(counts: Iterable[int], max_share: float = MAX_SHARE) -> int:
    """The largest cap per domain that keeps the largest share within the effective one; 1 if none does."""
    counts = list(counts)
    if not counts:
        return 0
    share = effective_share(len(counts), max_share) + SLACK
    low, high = 0, max(counts)
    while low < high:  # the largest share grows with the cap
        cap = (low + high + 1) // 2
        kept = [min(n, cap) for n in counts]
        low, high = (cap, high) if max(kept) <= share * sum(kept) else (low, cap - 1)
    return max(low, 1)


def domain_counts(tasks: DataFrame) -> dict[str, int]:
    """Collected: one number for each domain of the closed vocabulary."""
    return {r.domain: r.n for r in tasks.groupBy("domain").agg(F.count("*").alias("n")).collect()}


def balanced(tasks: DataFrame, max_share: float = MAX_SHARE, seed: int = SEED) -> DataFrame:
    """Native: the first tasks of each domain by seeded digest, as many as the cap allows."""
    return tasks.join(balanced_keys(tasks.select("domain", "task_id"), max_share, seed).select("task_id"), "task_id", "left_semi")


def balanced_keys(keys: DataFrame, max_share: float = MAX_SHARE, seed: int = SEED) -> DataFrame:
    """(domain, task_id) that balancing keeps.  Keys are spilled to executors' disks once, so that what they come from isn't computed for the counts, the ranks and the cut again."""
    keys = keys.persist(StorageLevel.DISK_ONLY)
    cap = largest_cap(domain_counts(keys).values(), max_share)
    return ranked(keys, ["domain"], seeded(seed, F.col("task_id"))).where(F.col("rn") <= cap).select("domain", "task_id")


def balanced_compat(tasks: DataFrame, max_share: float = MAX_SHARE, seed: int = SEED) -> DataFrame:
    """Compatible: one generator samples the trimmed domains in the order of their names, on the driver, from their sorted ids."""
    counts = domain_counts(tasks)
    cap = largest_cap(counts.values(), max_share)
    over = sorted(d for d, n in counts.items() if n > cap)
    if not over:
        return tasks
    rng, chosen = random.Random(seed), []
    for d in over:
        ids = sorted(r.task_id for r in tasks.where(F.col("domain") == d).select("task_id").toLocalIterator())
        chosen += [(i,) for i in rng.sample(ids, cap)]
    keep = tasks.sparkSession.createDataFrame(chosen, "task_id string").unionByName(tasks.where(~F.col("domain").isin(over)).select("task_id"))
    return tasks.join(keep, "task_id", "left_semi")


def _check(ratios: Mapping[str, float]) -> None:
    if abs(sum(ratios.values()) - 1) > SLACK:
        raise ValueError("split ratios must add up to 1")


def split(tasks: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = SEED) -> DataFrame:
    """Native: position by seeded digest within (domain, difficulty) against half-even cut points; held-out tasks are test."""
    _check(ratios)
    keys = tasks.select("task_id", "domain", "difficulty", (F.col("task_group") == "held_out").alias("held_out"))
    keys = ranked(keys, ["domain", "difficulty", "held_out"], seeded(seed, F.col("task_id")))
    train = F.bround(F.col("n") * F.lit(float(ratios["train"])), 0)
    valid = train + F.bround(F.col("n") * F.lit(float(ratios["validation"])), 0)
    at = F.when(F.col("held_out"), "test").when(F.col("rn") <= train, "train").when(F.col("rn") <= valid, "validation").otherwise("test")
    return tasks.drop("split").join(keys.select("task_id", at.alias("split")), "task_id")


def split_compat(tasks: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = SEED) -> DataFrame:
    """Compatible: each stratum is shuffled by a generator of its own."""
    _check(ratios)

    def assign(key: tuple, ids: pd.DataFrame) -> pd.DataFrame:
        domain, difficulty, held_out = key
        ids = sorted(ids["task_id"])
        n = len(ids)
        if held_out:
            names = ["test"] * n
        else:
            random.Random(f"{seed}/{(domain, difficulty)}").shuffle(ids)
            a, b = round(n * ratios["train"]), round(n * ratios["validation"])
            names = ["train"] * a + ["validation"] * b + ["test"] * (n - a - b)
            if len(names) != n:
                raise ValueError("split ratios exceed a stratum")
        return pd.DataFrame({"task_id": ids, "split": names})

    keys = tasks.select("task_id", "domain", "difficulty", (F.col("task_group") == "held_out").alias("held_out"))
    return tasks.drop("split").join(keys.groupBy("domain", "difficulty", "held_out").applyInPandas(assign, "task_id string, split string"), "task_id")


def sample_per_domain(tasks: DataFrame, wanted: Mapping[str, int], seed: int = SEED) -> DataFrame:
    """Compatible pilot sample: each domain has a generator of its own; a short domain gives what it has, which short_domains() tells."""

    def draw(key: tuple, ids: pd.DataFrame) -> pd.DataFrame:
        own = sorted(ids["task_id"])
        return pd.DataFrame({"task_id": random.Random(f"{seed}/{key[0]}").sample(own, min(wanted[key[0]], len(own)))}, dtype=object)

    ids = tasks.where(F.col("domain").isin(*wanted)).select("domain", "task_id").groupBy("domain").applyInPandas(draw, "task_id string")
    return tasks.join(ids, "task_id", "left_semi")


def short_domains(tasks: DataFrame, wanted: Mapping[str, int]) -> DataFrame:
    """(domain, wanted, n) of the domains that have fewer tasks than are wanted of them, none at all included."""
    asked = tasks.sparkSession.createDataFrame(sorted(wanted.items()), "domain string, wanted long")
    n = tasks.groupBy("domain").agg(F.count("*").alias("n"))
    return asked.join(n, "domain", "left").select("domain", "wanted", F.coalesce("n", F.lit(0)).alias("n")).where("n < wanted")


def dataset_of(task_id: Column) -> Column:
    """A task's dataset: its id up to the first slash."""
    return F.substring_index(task_id, "/", 1)


def split_counts(tasks: DataFrame) -> DataFrame:
    """(split, n) for train, validation and test, zeros included."""
    return tasks.groupBy().agg(*(F.count(F.when(F.col("split") == s, 1)).alias(s) for s in RATIOS)).unpivot([], list(RATIOS), "split", "n")


def leaks(tasks: DataFrame) -> DataFrame:
    """(task_id, problem): ids in several splits, and held-out tasks outside the test split."""
    several = tasks.groupBy("task_id").agg(F.count_distinct("split").alias("k")).where("k > 1").select("task_id", F.lit("several splits").alias("problem"))
    held = tasks.where("task_group = 'held_out' and split <> 'test'").select("task_id", F.lit("held out").alias("problem"))
    return several.unionByName(held)


def gate_2(tasks: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """(problem, subject): overweight domains, blank answers, missing graders, empty splits, or an empty pool."""
    shares = domain_shares(tasks).withColumn("cap", F.greatest(F.lit(max_share), 1 / F.count("*").over(Window.partitionBy(F.lit(0)))))
    over = shares.where(F.col("share") > F.col("cap") + SLACK).select(F.lit("domain share").alias("problem"), F.col("domain").alias("subject"))
    blank = tasks.where(F.coalesce(F.trim("answer"), F.lit("")) == "").select(F.lit("blank answer").alias("problem"), F.col("task_id").alias("subject"))
    grader = tasks.where(F.coalesce("grader", F.lit("")) == "").select(F.lit("no grader").alias("problem"), F.col("task_id").alias("subject"))
    counts = split_counts(tasks)
    none = counts.agg(F.sum("n").alias("n"))
    empty = counts.crossJoin(none.withColumnRenamed("n", "all")).where("n = 0 and `all` > 0").select(F.lit("empty split").alias("problem"), F.col("split").alias("subject"))
    return over.unionByName(blank).unionByName(grader).unionByName(empty).unionByName(none.where("coalesce(n, 0) = 0").select(F.lit("empty pool").alias("problem"), F.lit("").alias("subject")))


def facets(tasks: DataFrame, columns: tuple[str, ...] = ("dataset", "domain", "difficulty", "grader", "split")) -> DataFrame:
    """(facet, value, n) of each column, in one pass."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return tasks.select(cells.alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def source_table(tasks: DataFrame) -> DataFrame:
    """(dataset, n, first_domain, last_license, redistributable) by source: the domain of its least task id, the license of its greatest, and whether that one's prompt may be published."""
    free = F.coalesce(F.max_by("redistributable", "task_id"), F.lit(False)) if "redistributable" in tasks.columns else F.lit(False)
    return tasks.groupBy("dataset").agg(F.count("*").alias("n"), F.min_by("domain", "task_id").alias("first_domain"), F.max_by("license", "task_id").alias("last_license"), free.alias("redistributable"))
