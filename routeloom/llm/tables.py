"""Tables of the corpus, the shared folder, and bounded samples of labelled rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a labelled sample may have, and characters that each of them may give.  The sample is collected to train on the driver.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder below the one that all executors share (spark.checkpoint.dir).

    Only where that is unset and Spark runs within this process, a temporary folder takes its place.  The application's
    folder is deleted when it ends, or by ``clear``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="routeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/routeloom-{spark.sparkContext.applicationId}"
    path, fs = _path(spark, own)
    fs.mkdirs(path)  # only what is there can be marked for deletion
    fs.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes whatever this application has stored; results that are still to be read from there must have been used."""
    delete(spark, shared(spark, "x").rsplit("/", 1)[0])


_scratch: list[list[str]] = []


def written(df: DataFrame, path: str) -> None:
    """Writes a table and lets the shuffle files of its plan go as soon as it is there."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_UP, None)
    conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEAN_UP) if before is None else conf.set(_CLEAN_UP, before)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there and survives lost executors.

    Within ``scratch`` the table goes when that block ends, with ``keep`` when the block around it does, or the application.
    """
    spark = df.sparkSession
    path = shared(spark, name)
    written(df, path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were stored within the block; what is returned from it must not read them any more."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def labelled_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(_id, y): up to rows/2 doc_ids of each class, those of the smallest hashes; one labelled twice counts once, by its larger label."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string")))
    parts = [ids.where(F.col("y") == y).orderBy("_h", "doc_id").limit(rows // 2) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), "y")


def windows(text: Column, chars: int = SAMPLE_CHARS, many: int = 8) -> Column:
    """A text of more than ``chars`` characters as ``many`` windows that are spread evenly from its start to its end; others as they are."""
    own = chars // many
    starts = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.floor((F.length(text) - own) * k / (many - 1)).cast("int") + 1)
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(F.transform(starts, lambda at: F.substring(text, at, F.lit(own))), " "))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Up to rows/2 labelled documents of each class: (doc_id, text, lang, y), once each; long texts by their windows.

    Rows without doc_id, text or label are left out; of a doc_id with several texts the least counts.  The sample's ids, at
    most ``rows``, are broadcast, so that the corpus is scanned once and not shuffled.
    """
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.where("text is not null").select("doc_id", windows(F.col("text")).alias("text"), lang.alias("lang"))
    own = docs.join(F.broadcast(labelled_ids(labels, label, rows)), F.col("doc_id") == F.col("_id"))
    return own.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "y")).alias("r")).select("doc_id", "r.*")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
