"""Batched Lloyd iterations: many k-means models advance together, one scan an iteration.

All models' centroids are stacked into one matrix. A batch of rows needs one matrix product for its
distances to every centroid of every model, and one for the sums of the rows nearest to each; tasks
send their totals per centroid (count, sums, cost), added up in Spark. A model that has settled leaves the
stack, so later scans carry only the others.

Seeds: D^2-weighted draws (one generator a model) over ``SEED_ROWS`` distinct rows in md5 order, the only
step that looks at a part of the rows; every iteration, cost and silhouette covers all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: distinct rows from which starting centroids are drawn
SEED_ROWS = 4096


@dataclass
class Model:
    """One k-means run: its centroids, then how it ended."""

    k: int
    seed: int
    centroids: np.ndarray
    cost: float = float("inf")
    iterations: int = 0
    settled: bool = False
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids by one matrix product, never negative."""
    d = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)
    return np.maximum(d, 0.0, out=d)


def nearest_sums(x: np.ndarray, c: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sums of rows, cost) of each stacked centroid; model m's centroids are c[starts[m]:starts[m + 1]]."""
    d = distances(x, c)
    mine = np.zeros(d.shape)
    rows = np.arange(len(x))
    cost = np.zeros(len(c))
    for lo, hi in zip(starts, starts[1:]):
        at = lo + d[:, lo:hi].argmin(1)
        mine[rows, at] = 1.0
        cost += np.bincount(at, d[rows, at], len(c))
    return mine.sum(0), mine.T @ x, cost


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([col.to_numpy(zero_copy_only=False) for col in b.columns])


def _per_centroid(rows: DataFrame, many: int, width: int, of_batch: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Add up (count, sums, extra) of all batches per centroid: a task sends each of its totals as one (cell, value) row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of_batch(_matrix(b))
                total = part if total is None else tuple(t + p for t, p in zip(total, part))
        if total is not None:
            flat = np.column_stack([total[0], total[2], total[1]]).ravel()
            cells = np.flatnonzero(flat).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "v"])

    found = rows.mapInArrow(scan, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()   # many x (width + 2) cells
    flat = np.zeros(many * (width + 2))
    flat[found["cell"].to_numpy()] = found["v"].to_numpy()
    flat = flat.reshape(many, width + 2)
    return flat[:, 0], flat[:, 2:], flat[:, 1]


def _stack(models: list[Model]) -> tuple[np.ndarray, list[int]]:
    return np.concatenate([m.centroids for m in models]), [0, *np.cumsum([m.k for m in models]).tolist()]


def seed_rows(rows: DataFrame, seed: int, many: int = SEED_ROWS) -> np.ndarray:
    """At most ``many`` distinct rows, the first in md5 order of their values: what centroids start from."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in rows.columns]))
    found = rows.withColumn("__order", key).distinct().orderBy("__order").limit(many).drop("__order").collect()
    return np.array([tuple(r) for r in found], float).reshape(len(found), len(rows.columns))


def start(sample: np.ndarray, k: int, seed: int) -> Model:
    """Starting centroids: rows drawn with weights of their squared distance to those already drawn."""
    r = np.random.default_rng([seed, k])
    chosen = [int(r.integers(len(sample)))]
    near = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < k:
        upto = np.cumsum(near)
        if upto[-1] > 0:
            at = min(int(np.searchsorted(upto, r.random() * upto[-1], "right")), len(sample) - 1)
        else:
            at = int(r.integers(len(sample)))
        chosen.append(at)
        near = np.minimum(near, distances(sample, sample[[at]])[:, 0])
    return Model(k, seed, sample[chosen].copy())


def settle(rows: DataFrame, models: list[Model], max_iter: int, tol: float) -> list[Model]:
    """Lloyd's iterations of all models, each until its next move would be at most ``tol`` (summed squared shifts)
    or ``max_iter`` scans are done. Cost and sizes are measured on the centroids that are returned; a centroid
    without rows stays where it is.
    """
    width = len(rows.columns)
    for step in range(max_iter):
        moving = [m for m in models if not m.settled]
        if not moving:
            break
        c, starts = _stack(moving)
        n, s, cost = _per_centroid(rows, len(c), width, lambda x: nearest_sums(x, c, starts))
        for m, lo, hi in zip(moving, starts, starts[1:]):
            m.cost, m.sizes, m.iterations = float(cost[lo:hi].sum()), n[lo:hi], step + 1
            moved, full = m.centroids.copy(), m.sizes > 0
            moved[full] = s[lo:hi][full] / m.sizes[full][:, None]
            if ((moved - m.centroids) ** 2).sum() <= tol or step + 1 == max_iter:
                m.settled = True
            else:
                m.centroids = moved
    return models


def silhouettes(rows: DataFrame, models: list[Model]) -> list[float]:
    """Mean silhouette of each model with squared Euclidean distances, in two scans for all models.

    The mean squared distance of a row to a cluster follows from the cluster's count, sum and sum of squared
    norms; a row alone in its cluster counts 0, as does a model with fewer than two clusters in use.
    """
    if not models:
        return []
    width = len(rows.columns)
    c, starts = _stack(models)

    def stats(x: np.ndarray):
        d, norm = distances(x, c), (x * x).sum(1)
        mine, squares, at_all = np.zeros(d.shape), np.zeros(len(c)), np.arange(len(x))
        for lo, hi in zip(starts, starts[1:]):
            at = lo + d[:, lo:hi].argmin(1)
            mine[at_all, at] = 1.0
            squares += np.bincount(at, norm, len(c))
        return mine.sum(0), mine.T @ x, squares

    n, s, squares = _per_centroid(rows, len(c), width, stats)

    def score(x: np.ndarray):
        d, norm = distances(x, c), (x * x).sum(1)
        some = np.maximum(n, 1)
        mean = np.maximum(norm[:, None] + squares / some - 2.0 * (x @ (s / some[:, None]).T), 0.0)
        mean[:, n == 0] = np.inf
        total, at_all = np.zeros(len(c)), np.arange(len(x))
        for lo, hi in zip(starts, starts[1:]):
            at = lo + d[:, lo:hi].argmin(1)
            size = n[at]
            a = mean[at_all, at] * size / np.maximum(size - 1, 1)
            other = mean[:, lo:hi].copy()
            other[at_all, at - lo] = np.inf
            b = other.min(1)
            both = np.maximum(a, b)
            fit = (size > 1) & np.isfinite(b) & (both > 0)
            total[lo] += ((b[fit] - a[fit]) / both[fit]).sum()
        return np.zeros(len(c)), np.zeros((len(c), width)), total

    _, _, total = _per_centroid(rows, len(c), width, score)
    return [float(total[lo] / max(n[lo:hi].sum(), 1)) for lo, hi in zip(starts, starts[1:])]
