"""Helpers shared by the operators: reading a table, cutting lineage, key-safe names, components."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: rows of a table that may be broadcast after they have been counted
BROADCAST_ROWS = 100_000


#: what this Python worker keeps between tasks, one operator's at a time
_KEPT: dict = {}


def kept(key, make: Callable):
    """``make()``, held by this worker for later tasks that ask for the same key; what another key held is let go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Let go what earlier operators' tasks have left in this worker: reused workers carry it along otherwise.

    Memory that the allocators hold free goes back to the system too.
    """
    if not _KEPT:
        return
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc alone has it
    if trim is not None:
        trim(0)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only after a count has shown at most BROADCAST_ROWS rows; else leave the join to Spark."""
    small = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if small else df


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text is 0 modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (names are case-insensitive)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def unite(label, a, b):
    """Join the sets of the index pairs (a, b) in a numpy array of smallest-member labels; returns the labels."""
    import numpy as np
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable over undirected ``edges`` (a, b), for ids that have an edge.

    Alternating large-star and small-star rounds (each an aggregate with map-side
    combine and a join that adaptive execution can split when a node is hot), a written
    table after each round. Ends when a round changes nothing; raises if it doesn't end.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = large.distinct()
        low2 = star.groupBy("a").agg(F.min("b").alias("m"))
        small = (star.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low2.select("a", F.col("m").alias("b"))))
        cur = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        n, h = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, h) == before:
            roots = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        before = (n, h)
    raise RuntimeError("components did not settle")
