"""Order statistics of many columns at once, exact and with bounded memory, in few passes.

Doubles become integers of the same order, so a bracket of values can be cut into equal parts whatever
the scale. All columns and ranks go through every pass together:

1. *points*: each batch sends every ``STEP``-th of its sorted values and its count. A bounded sketch over
   the points of a column (``percentile_approx``) brackets each wanted rank; the counts add up to n.
2. *histogram*, only while a bracket may hold more than ``max_bracket`` rows: counts of ``PARTS`` equal parts of
   every bracket and of the rows below it. A rank moves to its part; a part of one value is the answer.
3. *values*: the rows of every bracket by distinct value, with the number of rows below. That
   number proves the bracket; a rank outside goes back to 2 with the bracket opened on that side.

Usually two passes (points, values), three on large tables. A bracket whose rows are a few hot values is
taken by 3 as soon as the histogram stops cutting it, since equal values are counted inside each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: values a point of the first pass stands for; margin in ranks (share of n, besides a few points); parts of a bracket
STEP, MARGIN, PARTS = 128, 0.01, 256
_LEAST, _MOST = -(2 ** 63), 2 ** 63 - 1


def to_key(v: np.ndarray) -> np.ndarray:
    """int64 of the same order as the doubles (no NaN; -0.0 is 0.0)."""
    b = (v + 0.0).view(np.int64)
    return np.where(b < 0, ~b ^ np.int64(_LEAST), b)


def from_key(k: int) -> float:
    b = np.array([k], np.int64)
    return float(np.where(b < 0, ~(b ^ np.int64(_LEAST)), b).view(np.float64)[0])


def _values(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, c in enumerate(b.columns):
        v = c.to_numpy(zero_copy_only=False).astype(np.float64)
        v = v[~np.isnan(v)]
        if len(v):
            yield i, v


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, v in _values(b):
            at = np.sort(v)[STEP // 2::STEP] if len(v) > STEP // 2 else np.sort(v)[len(v) // 2:len(v) // 2 + 1]
            n = np.zeros(len(at), np.int64)
            n[0] = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(n)], ["i", "v", "n"])


def _edges(lo: int, hi: int) -> np.ndarray:
    """Lower ends of at most PARTS equal parts of the whole numbers lo..hi."""
    step = max((hi - lo + PARTS) // PARTS, 1)
    return np.array(range(lo, hi + 1, step), np.int64)


def order_statistics(df: DataFrame, exprs: dict[str, Column], wanted: Callable[[int], list[int]], max_bracket: int = 200_000,
                     max_rounds: int = 20) -> dict[str, tuple[int, dict[int, tuple[float, int]]]]:
    """Per expression (n, {rank: (value, rows below it)}) for the ranks (from 0) that ``wanted`` names for its n.

    Null and NaN don't count. ``max_rounds`` bounds passes 2 and 3; raises when they don't suffice.
    """
    names = list(exprs)
    data = df.select(*[x.cast("double").alias(f"c{i}") for i, x in enumerate(exprs.values())])
    probes = [j / 1000 for j in range(1001)]
    found = {r["i"]: r for r in data.mapInArrow(_points, "i int, v double, n long").groupBy("i").agg(
        F.sum("n").alias("n"), F.percentile_approx("v", probes, 10000).alias("a")).collect()}       # one row a column
    out: dict[str, tuple[int, dict[int, tuple[float, int]]]] = {}
    brackets: dict[tuple[int, int], tuple[int, int]] = {}                # (column, rank) -> keys lo..hi
    guess: dict[tuple[int, int], float] = {}                             # rows that the bracket may hold
    stuck: set[tuple[int, int]] = set()
    for i, name in enumerate(names):
        n = found[i]["n"] if i in found else 0
        out[name] = (n, {})
        for rank in set(wanted(n)) if n else ():
            p, margin = rank / n, MARGIN + 4 * STEP / n
            lo, hi = int(np.floor((p - margin) * 1000)), int(np.ceil((p + margin) * 1000))
            a = to_key(np.array(found[i]["a"], float))
            brackets[i, rank] = (int(a[lo]) if lo > 0 else _LEAST, int(a[hi]) if hi < 1000 else _MOST)
            guess[i, rank] = n * min(2 * margin + 0.002, 1.0)

    def grouped(keys) -> list[tuple[int, int, int]]:
        return sorted({(i, *brackets[i, r]) for i, r in keys})

    for _ in range(max_rounds):
        if not brackets:
            return out
        large = [k for k in brackets if guess[k] > max_bracket and k not in stuck]
        if large:
            spans = grouped(large)
            edges = [_edges(lo, hi) for _, lo, hi in spans]

            def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counts = [np.zeros(len(e) + 2, np.int64) for e in edges]
                for b in batches:
                    sorted_ = {i: np.sort(to_key(v)) for i, v in _values(b)}
                    for (i, _, hi), e, c in zip(spans, edges, counts):
                        if i in sorted_:
                            at = [0, *np.searchsorted(sorted_[i], e), np.searchsorted(sorted_[i], hi, "right"), len(sorted_[i])]
                            c += np.diff(at)
                for s, c in enumerate(counts):
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["s", "at", "n"])

            totals = [np.zeros(len(e) + 2, np.int64) for e in edges]
            for r in data.mapInArrow(histogram, "s int, at int, n long").groupBy("s", "at").agg(F.sum("n").alias("n")).collect():  # PARTS a bracket
                totals[r["s"]][r["at"]] = r["n"]
            for key in large:
                i, rank = key
                s = spans.index((i, *brackets[key]))
                lo, hi = brackets[key]
                upto = np.cumsum(totals[s])
                part = int(np.searchsorted(upto, rank, "right")) - 1     # -1: below the bracket, len(edges): above it
                if part < 0:
                    brackets[key] = (_LEAST, lo)
                    continue
                if part >= len(edges[s]):
                    brackets[key] = (hi, _MOST)
                    continue
                new = (int(edges[s][part]), int(edges[s][part + 1]) - 1 if part + 1 < len(edges[s]) else hi)
                if new[0] == new[1]:
                    out[names[i]][1][rank] = (from_key(new[0]), int(upto[part]))
                    del brackets[key]
                    continue
                inside = int(totals[s][part + 1])
                if inside > max_bracket and inside >= 0.9 * (upto[-2] - upto[0]) and upto[-2] - upto[0] > 0 and hi - lo < 2 ** 52:
                    stuck.add(key)                                       # a few values hold nearly all of its rows
                brackets[key], guess[key] = new, inside
            continue
        spans = grouped(brackets)

        def inside_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below = np.zeros(len(spans), np.int64)
            for b in batches:
                keys = {i: np.sort(to_key(v)) for i, v in _values(b)}
                for s, (i, lo, hi) in enumerate(spans):
                    if i in keys:
                        x, y = np.searchsorted(keys[i], lo), np.searchsorted(keys[i], hi, "right")
                        below[s] += x
                        value, n = np.unique(keys[i][x:y], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), s, np.int32)), pa.array(value), pa.array(n)], ["s", "k", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(spans), dtype=np.int32)), pa.nulls(len(spans), pa.int64()), pa.array(below)], ["s", "k", "n"])

        counted = data.mapInArrow(inside_values, "s int, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n"))
        # the row of a null key (rows below) comes first; running counts within one bracket's distinct values
        order = Window.partitionBy("s").orderBy(F.col("k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        run = counted.withColumn("upto", F.sum("n").over(order))
        ranks = F.create_map(*[x for s, span in enumerate(spans) for x in (
            F.lit(s), F.array(*[F.lit(r) for i, r in brackets if (i, *brackets[i, r]) == span]))])[F.col("s")]
        hit = F.filter(ranks, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
        ends = counted.groupBy("s").agg(F.sum("n").alias("end"))
        answers = run.where(F.col("k").isNotNull()).select("s", "k", (F.col("upto") - F.col("n")).alias("below"), F.explode(hit).alias("rank"))
        got = {(spans[r["s"]], r["rank"]): (r["k"], r["below"]) for r in answers.collect()}            # one row a rank
        missing = [key for key in brackets if ((key[0], *brackets[key]), key[1]) not in got]
        below = {}
        if missing:
            below = {spans[r["s"]]: (r["n"], r["end"]) for r in counted.where("k IS NULL").join(ends, "s").collect()}
        for key in list(brackets):
            span = (key[0], *brackets[key])
            if (span, key[1]) in got:
                k, under = got[span, key[1]]
                out[names[key[0]]][1][key[1]] = (from_key(k), int(under))
                del brackets[key]
            else:
                brackets[key] = (_LEAST, span[1]) if key[1] < below[span][0] else (span[2], _MOST)
                guess[key] = float("inf")
    if brackets:
        raise RuntimeError(f"order statistics not found in {max_rounds} rounds: {sorted((names[i], r) for i, r in brackets)}")
    return out
