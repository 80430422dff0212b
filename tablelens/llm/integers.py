"""Vectors as exact integers: the usable rows of a table, floor(scale * x), and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: a scaled entry beyond this stops the job, because a long couldn't hold it
LARGEST = 2.0 ** 62


def usable(vec: Column) -> Column:
    """The vector has entries, none of them null, NaN or infinite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite, F.lit(False))


def whole(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every entry x, as double, in longs."""
    def one(x):
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit("a scaled entry does not fit in a long")))
    return F.transform(vec, one)


def matrix(lists, pad: bool = False) -> np.ndarray:
    """(rows, entries) int64 of an Arrow list column without nulls; where lengths differ, ``pad`` ends the shorter ones in zeros, else it raises."""
    if hasattr(lists, "combine_chunks"):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    if not pad:
        raise ValueError("vectors of different lengths")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
