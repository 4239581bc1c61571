"""Operator 10: exact deduplication against a minimal perfect hash of historical digests.

Each text has its SHA-256 digest.  The distinct digests of the historical
documents are spread over shards; a shard's minimal perfect hash (displaced
buckets, exactly one slot for a digest) is built by one task and stored in the
shared folder, its slots holding the full digest and the winner's doc_id.  The
distinct digests of newer documents are looked up there; only where all 32 bytes
of the slot agree is the text a repeat.  Nonmembers are grouped among
themselves.  Only digests and ids are shuffled for that, never texts, and a shard's size
is fixed, so that more input, historical or new, means more shards.

The winner of a text is the historical document of the least doc_id, else the
newer one of the least doc_id.

Defined cases: a null text is no copy of anything; the empty text is a text as
any other, and texts of any length are digested to their end.  Other ids than null
have to be numbers.  Rows with a null doc_id are left out of the decisions and stay in
the filtered table.  A row that repeats doc_id and text is decided once and
kept once.  If a doc_id has several texts, each has its own decision, and the
document goes only if all of them are copies.  Other columns are ignored and
kept, whatever their names.  Empty tables, historical ones too, are allowed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import scratch, stored

#: Aimed at digests in a shard.
SHARD = 50_000
#: Digests in a bucket of the hash function, on average.
BUCKET = 4
U64 = np.uint64


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = digests.view(U64).reshape(-1, 4)
    return tk.mix(w[:, 1]), w[:, 2]


def _slot(h: np.ndarray, seed, n: int) -> np.ndarray:
    return (tk.mix(h ^ (np.asarray(seed, U64) * U64(0x9E3779B97F4A7C15))) % U64(n)).astype(np.int64)


class PerfectHash:
    """Maps n distinct 32-byte digests to 0..n-1 without collisions.

    seeds: for each bucket, a seed s >= 0 that places its digests, or -1 - slot for a bucket of one.
    """

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """digests: uint8 of shape (n, 32), distinct."""
        n = len(digests)
        buckets = max(1, -(-n // BUCKET))
        seeds = np.zeros(buckets, np.int64)
        if not n:
            return cls(seeds, 0)
        b, h = _words(np.ascontiguousarray(digests))
        bucket = (b % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets + 1))
        size = np.diff(first)
        taken = np.zeros(n, bool)
        trial = np.arange(64, dtype=np.int64)[:, None]
        for k in np.argsort(-size, kind="stable"):
            m = size[k]
            if m < 2:
                break
            own = h[order[first[k] : first[k + 1]]][None, :]
            base = 0
            while True:
                s = _slot(own, trial + base, n)
                free = ~taken[s].any(axis=1)
                if free.any():
                    t = np.sort(s[free], axis=1)
                    good = np.flatnonzero(free)[(t[:, 1:] != t[:, :-1]).all(axis=1)]
                    if len(good):
                        seeds[k] = base + good[0]
                        taken[s[good[0]]] = True
                        break
                base += 64
        seeds[np.flatnonzero(size == 1)] = -1 - np.flatnonzero(~taken)
        return cls(seeds, n)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        b, h = _words(np.ascontiguousarray(digests))
        s = self.seeds[(b % U64(len(self.seeds))).astype(np.int64)]
        return np.where(s < 0, -1 - s, _slot(h, np.maximum(s, 0), max(1, self.n)))


def _digests(t: pa.Table, name: str = "digest") -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), np.uint8).reshape(-1, 32)


def build_tables(winners: DataFrame, shards: int) -> DataFrame:
    """(shard, seeds, digests, ids) of the rows (digest, winner_id)."""

    def build(t: pa.Table) -> pa.Table:
        d = _digests(t)
        f = PerfectHash.build(d)
        at = f.slots(d)
        slots, ids = np.empty_like(d), np.empty(len(d), np.int64)
        slots[at] = d
        ids[at] = t.column("winner_id").to_numpy()
        return pa.table({"shard": t.column("shard").slice(0, 1), "seeds": pa.array([f.seeds.tobytes()], pa.binary()), "digests": pa.array([slots.tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary())})

    return winners.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, seeds binary, digests binary, ids binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def lookup(distinct: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """(digest, least, winner_id) of the rows (digest, least); winner_id is null for nonmembers."""

    def look(new: pa.Table, old: pa.Table) -> pa.Table:
        d = _digests(new)
        winner, member = np.zeros(len(d), np.int64), np.zeros(len(d), bool)
        if old.num_rows and len(d):
            slots = np.frombuffer(old.column("digests")[0].as_py(), np.uint8).reshape(-1, 32)
            f = PerfectHash(np.frombuffer(old.column("seeds")[0].as_py(), np.int64), len(slots))
            at = f.slots(d)
            member = (slots[at] == d).all(axis=1)
            winner = np.frombuffer(old.column("ids")[0].as_py(), np.int64)[at]
        return pa.table({"digest": new.column("digest"), "least": new.column("least"), "winner_id": pa.array(winner, mask=~member)})

    left = distinct.withColumn("shard", _shard(shards)).groupBy("shard")
    return left.cogroup(tables.groupBy("shard")).applyInArrow(look, "digest binary, least long, winner_id long")


def digested(docs: DataFrame, old: Column) -> DataFrame:
    """(doc_id, digest, old) of the documents that have an id and a text."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest"), old.alias("old"))


def decided(rows: DataFrame) -> DataFrame:
    """(doc_id, winner_id, copies) for each distinct (doc_id, digest) of (doc_id, digest, old), stored; copies counts its rows.

    The number of shards follows whichever is more, history or new rows, so that neither side of a shard grows with the input.
    """
    with scratch(rows.sparkSession):
        rows = stored(rows, "digests")
        old = stored(rows.where("old").groupBy("digest").agg(F.min("doc_id").alias("winner_id")), "history")
        shards = max(1, math.ceil(max(old.count(), rows.where("not old").count()) / SHARD))
        tables = stored(build_tables(old, shards), "perfect-hash")
        new = lookup(rows.where("not old").groupBy("digest").agg(F.min("doc_id").alias("least")), tables, shards)
        winners = new.select("digest", F.coalesce("winner_id", "least").alias("winner_id"))
        both = rows.where("not old").groupBy("digest", "doc_id").agg(F.count("*").alias("copies")).join(winners, "digest")
        known = rows.where("old").groupBy("digest", "doc_id").agg(F.count("*").alias("copies")).join(old, "digest")
        return stored(known.unionByName(both).select("doc_id", "winner_id", "copies"), "decisions", keep=True)


def decisions(docs: DataFrame, history: DataFrame) -> DataFrame:
    """decided() of the documents of both tables."""
    return decided(digested(history, F.lit(True)).unionByName(digested(docs, F.lit(False))))


def by_halves(docs: DataFrame) -> DataFrame:
    """decided() of one table; documents below the middle of the range of ids are the history."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (int(low) + int(high) + 1) // 2
    return decided(digested(docs, F.col("doc_id") < middle))


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, winner_id, is_copy) for each document with a text; the lower half of the range of ids is the history."""
    return by_halves(docs).select("doc_id", "winner_id", (F.col("doc_id") != F.col("winner_id")).alias("is_copy"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that are no copies, each once."""
    with scratch(docs.sparkSession):
        state = by_halves(docs).groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("winner_id")).alias("gone"), F.max("copies").alias("most"))
        gone = stored(state.where("gone or most > 1").select(F.col("doc_id").alias("_id"), "gone"), "gone", keep=True)
    out = docs.join(gone.where("gone"), docs["doc_id"] == gone["_id"], "left_anti")
    again = gone.where("not gone").select("_id")
    if not again.take(1):
        return out
    once = out.join(again, out["doc_id"] == again["_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, out["doc_id"] == again["_id"], "left_anti").unionByName(once)


ORACLE = """
select distinct doc_id, min(doc_id) over (partition by text) as winner_id, doc_id <> min(doc_id) over (partition by text) as is_copy
from documents where doc_id is not null and text is not null
"""
