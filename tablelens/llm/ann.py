"""Approximate nearest neighbours by shifted space-filling curves (5).

Each curve projects the vectors to ``DIMS`` random directions, shifts the grid and ranks
the cells along a Hilbert curve. Spark range-partitions all vectors by (curve, key); a
vector's rank on a curve is its place in that order. Each query's window of keys on
every curve is read block by block (``BLOCK`` ranks), reranked by exact Euclidean distance in
double precision, and the blocks' best are merged.

Equal vectors are one point on the curves; it carries its ``k + 1`` smallest ids, which is
all a query can use of them, so thousands of copies neither fill a window nor a task.

The window is widened (doubled) until an audit against brute force over ``AUDIT`` queries
finds ``TARGET`` of the true neighbours. Windows that reach over a whole curve are exact.
A wider window reads only the ranks that the last one did not, and a block returns only what is
no farther than the query's last place so far, so a doubling adds about as many rows a query as
it has places, whatever the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import register, table, written

CURVES, DIMS, BITS = 6, 6, 10
BLOCK, WINDOW, AUDIT, TARGET = 1024, 1024, 64, 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer cells (n, dims) on the Hilbert curve of that many bits a side (Skilling's transpose form)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _valid(col: str):
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _points(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(point, ids, v): one row per distinct usable vector with its k + 1 smallest ids."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & _valid("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))            # -0.0 is 0.0
    keyed = rows.withColumn("h", F.xxhash64("v"))
    few = keyed.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= k + 1)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.element_at("ids", 1).alias("point"), "ids", "v")


def _keys(points: DataFrame, curves: int, seed: int) -> DataFrame:
    """(curve, key, point, ids, v) for every curve."""
    stats = points.select(F.size("v").alias("d")).distinct().limit(2).collect()
    if len(stats) > 1:
        raise ValueError("vectors of different lengths")
    d = stats[0]["d"] if stats else 1
    rng = np.random.default_rng(seed)
    ways = [np.linalg.qr(rng.standard_normal((d, d)))[0][:, :min(DIMS, d)] if d > 1 else np.ones((1, 1)) for _ in range(curves)]
    shifts = rng.random((curves, DIMS))
    # the middle and the spread of each projection, from exact moments of all points
    flat = points.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, spread = np.zeros(d), 1e-12
    for r in flat:
        mean[r["i"]] = r["m"]
        spread += r["s"] ** 2
    unit = 6 * np.sqrt(spread / d)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            v = np.stack(x["v"].to_numpy()).astype(np.float64)
            for c in range(curves):
                p = (v - mean) @ ways[c]
                # the grid covers twice the spread, so a shift by up to half of it moves every border
                g = np.clip((p / unit + 0.5 + shifts[c][:p.shape[1]]) / 2, 0, 1 - 1e-9)
                key = hilbert_keys((g * (1 << BITS)).astype(np.int64), BITS)
                yield pd.DataFrame({"curve": np.int32(c), "key": key, "point": x["point"], "ids": x["ids"], "v": x["v"]})

    return points.mapInPandas(rank, "curve int, key long, point long, ids array<long>, v array<double>")


def _ranked(keyed: DataFrame) -> DataFrame:
    """keyed with ``rank``: place on its curve. Written once range-partitioned; counts per (part, curve) give the offsets."""
    part = written(keyed.repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point")
                   .withColumn("part", F.spark_partition_id()))
    counts = part.groupBy("part", "curve").agg(F.count("*").alias("n"))        # a row per task and curve it touches
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.broadcast(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("part", "curve").orderBy("key", "point")       # a range part: bounded by Spark's own split
    return written(part.withColumn("i", F.row_number().over(inside) - 1).join(offset, ["part", "curve"])
                   .select("curve", (F.col("before") + F.col("i")).alias("rank"), "point", "ids", "v"))


def _best(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest ids in block ``x`` of each query in ``q`` whose window [lo, hi] without [from, to] reaches into it, none beyond ``most``."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(q) or not len(x):
        return empty
    v = np.stack(x["v"].to_numpy()).astype(np.float64)
    ranks, ids = x["rank"].to_numpy(), [np.asarray(i) for i in x["ids"]]
    sizes = np.array([len(i) for i in ids])
    flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes)
    out = []
    for qid, lo, hi, known_lo, known_hi, most, qv in zip(*(q[c] for c in ("query_id", "lo", "hi", "from", "to", "most", "qv"))):
        diff = v - np.asarray(qv, np.float64)
        dist = np.sqrt((diff * diff).sum(1))
        dist = np.where((ranks >= lo) & (ranks <= hi) & ((ranks < known_lo) | (ranks > known_hi)) & (dist <= most), dist, np.inf)[owner]
        ok = np.flatnonzero(np.isfinite(dist))
        if not len(ok):
            continue
        if len(ok) > k:
            edge = np.partition(dist[ok], k - 1)[k - 1]
            ok = ok[dist[ok] <= edge]
        ok = ok[np.lexsort((flat[ok], dist[ok]))[:k]]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": flat[ok], "score": dist[ok]}))
    return pd.concat(out, ignore_index=True) if out else empty


_FOUND = "query_id long, vec_id long, score double"


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over all blocks and curves."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _search(ranked: DataFrame, queries: DataFrame, window: int, k: int, known: int = -1, best: DataFrame | None = None) -> DataFrame:
    """Each query's window on each curve, block by block, without the window ``known`` whose ``best`` are given; not merged."""
    last = None if best is None else best.where(F.col("rank") == k).select("query_id", F.col("score").alias("most"))
    bound = queries.withColumn("most", F.lit(float("inf"))) if last is None else (
        queries.join(last, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf")))))
    first = F.col("block") * BLOCK
    reach = (bound.withColumn("lo", F.col("rank") - window).withColumn("hi", F.col("rank") + window)
             .withColumn("from", F.col("rank") - known).withColumn("to", F.col("rank") + known)
             .withColumn("block", F.explode(F.sequence(F.floor(F.greatest("lo", F.lit(0)) / BLOCK), F.floor(F.col("hi") / BLOCK))))
             .where(~((first >= F.col("from")) & (first + (BLOCK - 1) <= F.col("to"))))
             .select("curve", "block", "query_id", "lo", "hi", "from", "to", "most", "qv"))
    blocks = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).select("curve", "block", "rank", "ids", "v")
    return (reach.groupBy("curve", "block").cogroup(blocks.groupBy("curve", "block"))
            .applyInPandas(lambda q, x: _best(q, x, k), _FOUND))


def brute_force(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries: they are sent to every row, each task keeps its k best."""
    sent = [(r["query_id"], np.array(r["qv"])) for r in queries.select("query_id", "qv").collect()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = pd.DataFrame({"query_id": [i for i, _ in sent], "lo": 0, "hi": 0, "from": 1, "to": -1, "most": np.inf, "qv": [v for _, v in sent]})
        for x in batches:
            if len(x) and len(q):
                yield _best(q, x.assign(rank=0), k)

    return _merge(points.select("ids", "v").mapInPandas(scan, _FOUND), k)


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES,
            window: int = WINDOW, target: float = TARGET, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row that ``is_query`` marks, itself left out.

    Vectors that are null, empty, all zero or hold null or non-finite components, and rows without
    an id, take no part. Rows with equal id and vector count once. With fewer than
    k others all are returned. Ties go to the smaller id.
    """
    points = written(_points(vectors, id_col, vec_col, k))
    n = points.count()
    ranked = _ranked(_keys(points, curves, seed))
    # queries with equal vectors are one search; its k + 1 best serve each after its own id is left out
    mine = (vectors.where(is_query).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("qv"))
            .where(F.col("query_id").isNotNull() & _valid("qv")).distinct().withColumn("qv", F.transform("qv", lambda x: x + 0.0)))
    asks = written(mine.withColumn("h", F.xxhash64("qv")).join(points.withColumn("h", F.xxhash64("v")), "h")
                   .where(F.col("qv") == F.col("v")).select(F.col("query_id").alias("asked"), F.col("point").alias("query_id")))
    searched = asks.select("query_id").distinct()
    queries = written(ranked.join(searched, F.col("point") == F.col("query_id"), "left_semi")
                      .select(F.col("point").alias("query_id"), F.col("v").alias("qv"), "curve", "rank"))
    probe = written(queries.where("curve = 0").orderBy(F.xxhash64("query_id")).limit(AUDIT))
    truth = written(brute_force(points, probe, k + 1))
    want = truth.count()
    best, known = None, -1
    while True:
        found = _search(ranked, queries, window, k + 1, known, best)
        best = written(_merge(found if best is None else found.unionByName(best.select("query_id", "vec_id", "score")), k + 1))
        if window >= n or not want:
            break
        if best.join(F.broadcast(truth.select("query_id", "vec_id")), ["query_id", "vec_id"], "left_semi").count() >= target * want:
            break
        known, window = window, 2 * window
    found = best.select("query_id", "vec_id", "score")
    order = Window.partitionBy("asked").orderBy("score", "vec_id")
    return (asks.join(found, "query_id").where("asked <> vec_id").withColumn("rank", F.row_number().over(order).cast("int"))
            .where(F.col("rank") <= k).select(F.col("asked").alias("query_id"), "rank", "vec_id", "score"))


@register("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
