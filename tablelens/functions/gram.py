"""Mergeable Gramian: counts, means and co-moments of many column pairs from one scan.

Every task keeps, for each pair of columns, the moments over the rows where both are present:
n, both means, the co-moment and both sums of squared deviations. A batch is centred on a value of
its own near the mean, so its sums come from matrix products without cancellation, also for values far
from zero; batches and tasks are merged by the pairwise update of means and co-moments. Tasks
send one row a left column (size: number of right columns), merged in two grouped steps, so no task
and no driver step grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import q
from tablelens.functions.moments import complete, present

#: groups that merge the tasks' rows of a column before the last step
SLOTS = 32
_PARTS = ("n", "ma", "mb", "c", "qa", "qb")


@dataclass
class Gram:
    """Per pair (left a, right b), over the rows with both: n, means, co-moment, sums of squared deviations."""

    n: np.ndarray
    ma: np.ndarray
    mb: np.ndarray
    c: np.ndarray
    qa: np.ndarray
    qb: np.ndarray

    def merged(self, o: Gram) -> Gram:
        n = self.n + o.n
        w = np.divide(o.n, n, out=np.zeros_like(n), where=n > 0)
        da, db, k = o.ma - self.ma, o.mb - self.mb, self.n * w
        return Gram(n, self.ma + w * da, self.mb + w * db, self.c + o.c + k * da * db, self.qa + o.qa + k * da * da, self.qb + o.qb + k * db * db)

    def correlation(self) -> np.ndarray:
        """Pearson's r clamped to [-1, 1]; NaN where a side has no spread or a moment isn't finite."""
        with np.errstate(all="ignore"):
            r = self.c / (np.sqrt(self.qa) * np.sqrt(self.qb))
            r = np.where((self.qa > 0) & (self.qb > 0) & np.isfinite(r), r, np.nan)
        return np.clip(r, -1.0, 1.0)             # NaN stays NaN


def _centred(x: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values less a value of their column near its mean, zero where missing; those values)."""
    with np.errstate(all="ignore"):
        n = here.sum(0)
        mean = np.where(here, x, 0).sum(0) / np.maximum(n, 1)
        near = np.where(here, np.abs(x - mean), np.inf).argmin(0)
        centre = np.where(n > 0, x[near, np.arange(x.shape[1])], 0.0)
        return np.where(here, x - centre, 0.0), centre


def gram_of(x: np.ndarray, left: list[int], right: list[int]) -> Gram:
    """The Gram of one matrix with NaN for missing cells."""
    here = ~np.isnan(x)
    z, centre = _centred(x, here)
    w = here.astype(float)
    a, b, wa, wb = z[:, left], z[:, right], w[:, left], w[:, right]
    with np.errstate(all="ignore"):
        n = wa.T @ wb
        s = np.maximum(n, 1)
        ma, mb = a.T @ wb / s, wa.T @ b / s
        c = a.T @ b - ma * mb * n
        qa, qb = (a * a).T @ wb - ma * ma * n, wa.T @ (b * b) - mb * mb * n
    return Gram(n, ma + centre[left][:, None], mb + centre[right], c, np.maximum(qa, 0), np.maximum(qb, 0))


def gram(df: DataFrame, left: list[str], right: list[str] | None = None, complete_rows: bool = False) -> Gram:
    """Moments of every pair of a left and a right column (default: the left ones). Null and NaN are missing;
    ``complete_rows`` leaves out rows with any missing cell first."""
    right = left if right is None else right
    cols = list(dict.fromkeys([*left, *right]))
    data = df.select(*[present(q(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    if complete_rows:
        data = complete(data)
    at_left, at_right = [cols.index(c) for c in left], [cols.index(c) for c in right]
    width = len(right)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
                part = gram_of(x, at_left, at_right)
                total = part if total is None else total.merged(part)
        if total is not None:
            slot = TaskContext.get().partitionId() % SLOTS
            lists = [pa.array(list(getattr(total, p)), pa.list_(pa.float64())) for p in _PARTS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left), dtype=np.int32)), pa.array(np.full(len(left), slot, np.int32)), *lists],
                                             ["i", "slot", *_PARTS])

    schema = "i int, slot int, " + ", ".join(f"{p} array<double>" for p in _PARTS)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [Gram(*[np.asarray(r, float) for r in row]) for row in zip(*[rows[p] for p in _PARTS])]
        total = parts[0]
        for g in parts[1:]:
            total = total.merged(g)
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "slot": [rows["slot"].iloc[0]], **{p: [getattr(total, p)] for p in _PARTS}})

    sent = data.mapInArrow(scan, schema)
    halfway = sent.groupBy("i", "slot").applyInPandas(merge, schema)
    rows = {r["i"]: r for r in halfway.groupBy("i").applyInPandas(merge, schema).collect()}    # one row a left column
    none = [0.0] * width
    return Gram(*[np.array([rows[i][p] if i in rows else none for i in range(len(left))], float).reshape(len(left), width) for p in _PARTS])
