"""Hard-negative mining by Strassen multiplication (11).

Entries become integers, floor(scale * x); the score of two rows is their inner product.
Anchors go out in blocks of ``BLOCK`` (bounded, so a block fits in every task), and each task
multiplies tiles of them with tiles of its candidates: Strassen's seven products a level, halves padded
with zeros, exact additions. Longs wrap modulo 2^64 and the scheme holds in that ring, so a
product is exact when the result fits, which a bound checks first (it raises beyond).

Two passes over the candidates a block. The first keeps each anchor's best rows of its own
label in a heap (score falling, then id), heaps of all tasks merge in Spark. The second knows each
positive's score and keeps, for every (anchor, positive), the best rows of other labels whose score
lies within the window; these heaps merge alike. A heap holds a pair once however often it is
pushed, so repeated rows need no shuffle of the table.

Defined results: rows with a null id, null label, a null or empty vector or null or non-finite
entries take no part. Rows that share an id are never positives or negatives of each
other; equal (id, label, vector) rows count once. Shorter vectors end in zeros. Scores may be negative:
the window of a negative positive score is empty, that of zero holds zero only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import register, table, written
from tablelens.llm.integers import matrix, usable, whole
from tablelens.session import checkpoint_dir

#: anchors that go out together; rows of an anchor and of a candidate tile; smallest side that is still halved
BLOCK, ANCHOR_TILE, CANDIDATE_TILE, LEAF = 8192, 1024, 2048, 32
SCALE = 256
_LOW, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# ---- products

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a (m, k) times b (k, n) of int64, exact; raises where an entry of the product might not fit."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if not min(m, k, n):
        return np.zeros((m, n), np.int64)
    largest = int(max(a.max(), -int(a.min()))) * int(max(b.max(), -int(b.min()))) * k
    if largest >= 2 ** 63:
        raise OverflowError("an inner product might not fit in a long")
    levels = max(min(m, k, n).bit_length() - leaf.bit_length(), 0)
    # a level at most doubles the entries of both sides; doubles are exact below 2^53
    exact = largest << (2 * levels) < 2 ** 53
    unit = 1 << levels
    pad = [-s % unit for s in (m, k, n)]
    if any(pad):
        a = np.pad(a, ((0, pad[0]), (0, pad[1])))
        b = np.pad(b, ((0, pad[1]), (0, pad[2])))
    return _multiply(a, b, levels, exact)[:m, :n]


def _multiply(a: np.ndarray, b: np.ndarray, levels: int, exact: bool) -> np.ndarray:
    if not levels:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if exact else a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]

    def p(x, y):
        return _multiply(x, y, levels - 1, exact)

    p1, p2, p3, p4 = p(a11 + a22, b11 + b22), p(a21 + a22, b11), p(a11, b12 - b22), p(a22, b21 - b11)
    p5, p6, p7 = p(a11 + a12, b22), p(a21 - a11, b11 + b12), p(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


# ---- heaps

class Heaps:
    """The ``k`` best (score falling, id rising) of each of ``n`` rows; an equal pair is held once."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.full((n, k), _LOW), np.full((n, k), _NO_ID)

    def floor(self, rows=slice(None)) -> np.ndarray:
        """The score below which nothing enters a row's heap."""
        return self.score[rows, -1]

    def push(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        touched, at = np.unique(rows, return_inverse=True)
        r = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        i = np.concatenate([ids, self.ids[touched].ravel()])
        o = np.lexsort((i, ~s, r))                  # ~s falls as s rises, without overflow
        r, s, i = r[o], s[o], i[o]
        again = np.zeros(len(r), bool)
        again[1:] = (r[1:] == r[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1]) & (i[1:] != _NO_ID)
        r, s, i = r[~again], s[~again], i[~again]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best = place < self.k
        self.score[touched[r[best]], place[best]] = s[best]
        self.ids[touched[r[best]], place[best]] = i[best]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all entries."""
        rows, at = np.nonzero(self.ids != _NO_ID)
        return rows, self.score[rows, at], self.ids[rows, at]


class _Anchors:
    """A block of anchors as arrays: ids, codes of their labels, integer vectors."""

    def __init__(self, found: pa.Table):
        self.ids = found["id"].to_numpy()
        self.labels = pc.unique(found["label"].combine_chunks())
        self.codes = pc.index_in(found["label"].combine_chunks(), value_set=self.labels).to_numpy()
        self.x = matrix(found["x"], pad=True)

    def tiles(self, batches: Iterator[pa.RecordBatch]):
        """(first anchor, scores, candidate ids, same label, other row) of every tile of candidates and anchors."""
        for b in batches:
            codes = pc.fill_null(pc.index_in(b.column(1), value_set=self.labels), -1).to_numpy(zero_copy_only=False)
            ids, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(2), pad=True)
            wide = max(x.shape[1], self.x.shape[1])
            x, own = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (x, self.x))
            for c in range(0, len(x), CANDIDATE_TILE):
                to = slice(c, c + CANDIDATE_TILE)
                turned = np.ascontiguousarray(x[to].T)
                for a in range(0, len(own), ANCHOR_TILE):
                    me = slice(a, a + ANCHOR_TILE)
                    yield (a, strassen(own[me], turned), ids[to], self.codes[me, None] == codes[None, to],
                           self.ids[me, None] != ids[None, to])


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key over all tasks' heaps, with ``rank`` from 1; equal pairs once."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return (found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
            .dropDuplicates([*keys, "rank"]))


def _positives(rows: DataFrame, anchors: _Anchors, k: int) -> DataFrame:
    """(anchor, id, score, rank): each anchor's k best other rows of its label."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(anchors.ids), k)
        for a, score, ids, same, other in anchors.tiles(batches):
            at, c = np.nonzero(same & other & (score >= heaps.floor(slice(a, a + len(score)))[:, None]))
            heaps.push(at + a, score[at, c], ids[c])
        at, score, ids = heaps.held()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(score), pa.array(ids)], ["anchor", "score", "id"])

    return _best(rows.mapInArrow(scan, "anchor long, score long, id long"), ["anchor"], k)


def _window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole score that is at least low % and at most high % of ``score``."""
    s = score.astype(object)
    return (-(-low * s // 100)).astype(np.int64), (high * s // 100).astype(np.int64)


def _negatives(rows: DataFrame, anchors: _Anchors, positives: pa.Table, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score, rank): the k best rows of other labels in each positive's window."""
    owner, slot = positives["anchor"].to_numpy(), positives["rank"].to_numpy() - 1
    slots = int(slot.max(initial=0)) + 1
    least, most = np.ones((slots, len(anchors.ids)), np.int64), np.zeros((slots, len(anchors.ids)), np.int64)
    of, worth = np.zeros_like(least), np.zeros_like(least)
    of[slot, owner], worth[slot, owner] = positives["id"].to_numpy(), positives["score"].to_numpy()
    least[slot, owner], most[slot, owner] = _window(worth[slot, owner], low, high)
    # an anchor's windows together: nothing outside these two scores is looked at again
    none = least > most
    bottom = np.where(none, _NO_ID, least).min(0)
    top = np.where(none, _LOW, most).max(0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heaps(len(anchors.ids), k) for _ in range(slots)]
        for a, score, ids, same, other in anchors.tiles(batches):
            me = slice(a, a + len(score))
            at, c = np.nonzero(~same & other & (score >= bottom[me, None]) & (score <= top[me, None]))
            s, i, at = score[at, c], ids[c], at + a
            for j, h in enumerate(heaps):
                fit = (s >= least[j, at]) & (s <= most[j, at]) & (s >= h.floor(at))
                h.push(at[fit], s[fit], i[fit])
        for j, h in enumerate(heaps):
            at, s, i = h.held()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at * slots + j), pa.array(anchors.ids[at]), pa.array(of[j, at]), pa.array(worth[j, at]), pa.array(s), pa.array(i)],
                ["pair", "anchor_id", "positive_id", "positive_score", "score", "id"])

    found = rows.mapInArrow(scan, "pair long, anchor_id long, positive_id long, positive_score long, score long, id long")
    return _best(found, ["pair"], k).drop("pair")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that ``is_anchor`` marks.

    An anchor's positives are its first other rows of the same label, a pair's negatives the first rows of
    another label whose score lies between low % and high % of the positive's.
    """
    spark = rows.sparkSession
    fit = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vec_col))
    whole_rows = rows.where(fit).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                                        whole(F.col(vec_col), scale).alias("x"), is_anchor.alias("anchor"))
    candidates = whole_rows.select("id", "label", "x")
    anchors = written(whole_rows.where("anchor").select("id", "label", "x").distinct())
    blocks = max(-(-anchors.count() // BLOCK), 1)
    place = os.path.join(checkpoint_dir(spark), f"llm-negatives-{uuid.uuid4().hex}")
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], out).write.parquet(place)
    for n in range(blocks):                          # about BLOCK anchors by hash: one block at a time
        block = dealt.where(F.col("block") == n).drop("block").toArrow()
        if not block.num_rows:
            continue
        asked = _Anchors(block)
        own = _positives(candidates, asked, positives).toArrow()
        _negatives(candidates, asked, own, negatives, low, high).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.mode("append").parquet(place)
    return spark.read.schema(out).parquet(place)


ORACLE_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""


@register("op11_hard_negatives", ORACLE_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 50 == 0)
