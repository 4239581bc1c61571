"""Scans and sinks of JSON lines, configurations, local and mirrored sources."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from routeloom import schemas

LOCAL = "local:"


class SourceUnavailable(RuntimeError):
    """A source can't be read; a build records it and goes on."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; a missing file has none, blank lines are skipped, a malformed one fails."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    tasks = read_jsonl(spark, path, schemas.TASK)
    schemas.must_be_empty(schemas.task_violations(tasks), "tasks")
    return tasks


def read_rewards(spark: SparkSession, path: str) -> DataFrame:
    """Reward records; winners are derived afresh."""
    from routeloom.operators.rewards import rederived

    rewards = read_jsonl(spark, path, schemas.REWARD)
    schemas.must_be_empty(schemas.reward_violations(rewards), "rewards")
    schemas.one_agent_order(rewards)
    return rederived(rewards)


def last_of_each(rows: DataFrame, key: str, ordinal: Column) -> DataFrame:
    """The row of the greatest ordinal of each key: later duplicates win."""
    best = rows.withColumn("_at", ordinal).groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_at").alias("r"))
    return best.select("r.*")


def first_split(available: Iterable[str]) -> str:
    """The split to train from: train, test, validation or dev, whichever is there first."""
    there = list(available)
    return next((s for s in "train test validation dev".split() if s in there), there[0])


def read_source(spark: SparkSession, dataset: str, split: str, mirror: str = "", schema: T.StructType | None = None) -> DataFrame:
    """Rows of a source: 'local:path' is a file of JSON lines, any other name a Parquet folder name/split below the mirror."""
    try:
        if dataset.startswith(LOCAL):
            path = dataset.removeprefix(LOCAL)
            if not _exists(spark, path):
                raise SourceUnavailable(f"{path} isn't there")
            return (spark.read.schema(schema) if schema else spark.read).json(path)
        if not mirror:
            raise SourceUnavailable(f"no mirror has {dataset}")
        return spark.read.parquet(f"{mirror}/{dataset}/{split}")
    except SourceUnavailable:
        raise
    except Exception as e:
        raise SourceUnavailable(f"{dataset}: {e}") from e


def limited(mapped: DataFrame, ordinal: str, ok: Column, limit: int | None) -> DataFrame:
    """Rows of a mapping that are looked at until ``limit`` of them are ok, in the order of the ordinal.

    The running count is taken within ranges of the ordinal first, so no single task sorts all rows.
    """
    rows = mapped.withColumn("_ok", ok.cast("long"))
    if limit is None:
        return rows.drop("_ok")
    size = rows.agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi")).first()
    if size.lo is None:
        return rows.drop("_ok")
    width = max(1, (size.hi - size.lo) // 1000 + 1)
    rows = rows.withColumn("_part", F.floor((F.col(ordinal) - size.lo) / width))
    sums = rows.groupBy("_part").agg(F.sum("_ok").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # at most 1000 rows
    rows = rows.join(F.broadcast(sums.drop("_n")), "_part")
    run = F.col("_before") + F.sum("_ok").over(Window.partitionBy("_part").orderBy(ordinal)) - F.col("_ok")
    return rows.withColumn("_run", run).where(F.col("_run") < limit).drop("_ok", "_part", "_before", "_run")


def map_stats(looked_at: DataFrame, reason: Column) -> DataFrame:
    """(reason, n): 'yielded' where the reason is null."""
    return looked_at.groupBy(F.coalesce(reason, F.lit("yielded")).alias("reason")).agg(F.count("*").alias("n"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def write_jsonl_file(df: DataFrame, path: str | os.PathLike, order: str) -> int:
    """One file of JSON lines with sorted keys, put in its place when complete; for small tables on the driver."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    new, n = path.with_suffix(path.suffix + ".tmp"), 0
    with new.open("w", encoding="utf-8") as f:
        for n, row in enumerate(df.orderBy(order).toLocalIterator(), 1):
            f.write(json.dumps(row.asDict(recursive=True), sort_keys=True, ensure_ascii=False) + "\n")
    new.replace(path)
    return n


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key isn't there yet.

    The table's keys are scanned for those of the rows, which are the smaller side; what is found, not the table, meets the rows.
    A run that failed halfway is completed by the next one.
    """
    spark = df.sparkSession
    if _exists(spark, path):
        there = spark.read.parquet(path).select(key).join(df.select(key), key, "left_semi").distinct()
        df = df.join(there, key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir), deleted when the application ends; a temporary one only if Spark runs within this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="routeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/routeloom-work-{spark.sparkContext.applicationId}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)  # only what is there can be marked for deletion
    fs.deleteOnExit(p)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def digest_col(text: Column) -> Column:
    """digest() of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def load_config(path: str | os.PathLike, **expected: str) -> dict:
    """A JSON object; named fields must have the expected values."""
    config: Mapping = json.loads(Path(path).read_text("utf-8"))
    for name, value in expected.items():
        if config.get(name) != value:
            raise ValueError(f"{path}: {name} is {config.get(name)!r}, not {value!r}")
    return dict(config)


def digest(path: str | os.PathLike) -> str:
    """First 16 hexadecimal digits of the SHA-256 of a file."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()[:16]
