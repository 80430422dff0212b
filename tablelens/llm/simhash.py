"""SimHash near-duplicates over a Gray-order hierarchical index (8).

Equal fingerprints are one node. For every one of ``max_distance + 1`` disjoint bit
blocks the fingerprints are rotated so that the block leads, ranked in Gray order
(rank prefixes follow value prefixes, so equal leading bits stay together) and dealt
by the leading block. Two fingerprints within the distance agree on a whole block, so
they meet in one of these orders, and each order is searched exactly.

Inside a task the sorted run is the index: the bits that neighbours share form upper
nodes, one level per ``LEVEL`` bits, each node holding only its own slice of the
pattern. The self-join walks pairs of nodes downward and adds up pattern differences;
a pair of whole groups goes as soon as the sum passes the distance. Links inside a
task are reduced to a spanning forest, so no group's pairs are written out.

A block value with more than ``CELL`` distinct fingerprints is split by salt into a
triangle of cells, every pair of salts once; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import broadcast_if_small, components, fresh, register, table, unite, written

CELL, LEVEL, PAIRS = 4096, 12, 1_000_000


def fingerprint_of(text: str | None, shingle: int) -> int:
    """64-bit SimHash of one text as a signed long: a bit is set if over half the shingles' XXH64 (seed 42) have it."""
    import xxhash
    words = (text or "").encode().lower().split()   # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        ends = np.array([len(joined)])
        starts = np.array([0])
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
        ends = ends[shingle - 1:]
    h = xxhash.xxh64_intdigest
    set_in = np.zeros(64, np.int64)
    for lo in range(0, len(starts), 200_000):
        vals = np.array([h(joined[a:b], 42) for a, b in zip(starts[lo:lo + 200_000].tolist(), ends[lo:lo + 200_000].tolist())],
                        np.uint64)
        set_in += np.unpackbits(vals.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """Fingerprint of a text column; null and blank texts: zero."""

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in s.fillna("")], dtype="int64")

    return of(text)


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _gray_rank(v: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseXOR(F.shiftrightunsigned(v, k))
    return v


def _children(keys: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child range of every parent when ``keys`` and ``parents`` are first positions of runs."""
    lo = np.searchsorted(keys, parents)
    return lo, np.append(lo[1:], len(keys))


def close_pairs(cell: np.ndarray, value: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a < b) in one cell whose values differ in at most ``distance`` bits. Sorted by cell, then Gray rank."""
    n = len(value)
    starts, patterns = [], []
    top = 0
    for depth in [*range(LEVEL, 64, LEVEL), 64]:
        prefix = value >> np.uint64(64 - depth)
        new = np.ones(n, bool)
        new[1:] = (cell[1:] != cell[:-1]) | (prefix[1:] != prefix[:-1])
        at = np.flatnonzero(new)
        starts.append(at)
        patterns.append(prefix[at] & np.uint64((1 << (depth - top)) - 1))
        top = depth
    root = np.ones(n, bool)
    root[1:] = cell[1:] != cell[:-1]
    root = np.flatnonzero(root)
    ranges = [_children(starts[0], root)] + [_children(starts[i + 1], starts[i]) for i in range(len(starts) - 1)]
    some = np.arange(len(root))[ranges[0][1] - ranges[0][0] > 0]
    stack = [(0, some, some, np.zeros(len(some), np.int64))]
    while stack:
        level, a, b, acc = stack.pop()
        lo, hi = ranges[level]
        na = hi[a] - lo[a]
        work = na * (hi[b] - lo[b])
        if work.sum() > PAIRS and len(a) > 1:
            half = max(1, int(np.searchsorted(np.cumsum(work), work.sum() / 2)))
            half = min(half, len(a) - 1)
            stack += [(level, a[:half], b[:half], acc[:half]), (level, a[half:], b[half:], acc[half:])]
            continue
        same = np.repeat(a == b, na)
        left = np.repeat(lo[a], na) + np.arange(na.sum()) - np.repeat(np.cumsum(na) - na, na)
        b2, acc2 = np.repeat(b, na), np.repeat(acc, na)
        first = np.where(same, left, lo[b2])           # a node with itself: each pair of children once
        nb = hi[b2] - first
        cut = np.searchsorted(np.cumsum(nb), np.arange(0, max(1, int(nb.sum())), PAIRS), side="left")
        for s, e in zip(cut, [*cut[1:], len(nb)]):
            m = nb[s:e]
            x = np.repeat(left[s:e], m)
            y = np.repeat(first[s:e], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            d = np.repeat(acc2[s:e], m) + np.bitwise_count(patterns[level][x] ^ patterns[level][y])
            near = d <= distance
            x, y, d = x[near], y[near], d[near]
            if level == len(starts) - 1:
                x, y = x[x != y], y[x != y]
                if len(x):
                    yield starts[-1][x], starts[-1][y]
            elif len(x):
                stack.append((level + 1, x, y, d))


def _link_cells(distance: int):
    """Spanning-forest edges (a, b) of the links within each cell; rows come sorted by cell and Gray rank."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def search(x: pd.DataFrame) -> pd.DataFrame:
            change = (x[["r", "lead", "i", "j"]].to_numpy()[1:] != x[["r", "lead", "i", "j"]].to_numpy()[:-1]).any(1)
            cell = np.concatenate([[0], np.cumsum(change)])
            label = np.arange(len(x))
            for a, b in close_pairs(cell, x["v"].to_numpy().view(np.uint64), distance):
                label = unite(label, a, b)
            moved = np.flatnonzero(label != np.arange(len(x)))
            fp = x["fp"].to_numpy()
            return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

        rest = None
        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            key = x[["r", "lead", "i", "j"]].to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(1)).max(initial=-1)) + 1 if len(x) else 0
            rest = x.iloc[last:].reset_index(drop=True)
            if last:
                yield search(x.iloc[:last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield search(rest)

    return link


def fingerprint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps.fp`` exactly as links at ``distance`` bits or fewer do."""
    blocks = distance + 1
    width = 64 // blocks
    orders = F.array(*[F.struct(F.lit(r).alias("r"), _rotated(F.col("fp"), r * width).alias("v")) for r in range(blocks)])
    rows = (fps.select("fp", F.inline(orders))
            .withColumn("g", _gray_rank(F.col("v")))
            .withColumn("lead", F.shiftrightunsigned("g", 64 - width)))
    hot = broadcast_if_small(rows.groupBy("r", "lead").count().where(F.col("count") > CELL)
                             .select("r", "lead", F.ceil(F.col("count") / CELL).cast("int").alias("s")))
    rows = rows.join(hot, ["r", "lead"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    rows = (rows.withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
            .select("r", "lead", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), "g", "v", "fp"))
    dealt = rows.repartition("r", "lead", "i", "j")
    # unsigned order of the rank: flip the sign bit
    dealt = dealt.sortWithinPartitions("r", "lead", "i", "j", F.col("g").bitwiseXOR(F.lit(-2**63).cast("long")))
    return dealt.select("r", "lead", "i", "j", "v", "fp").mapInPandas(_link_cells(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """All rows and columns of ``docs`` with fingerprint (long), component (smallest id reachable) and kept.

    Returns the frame and the names of the three new columns (changed where they clash).
    One row of each component is kept: the smallest id, of repeated rows one. A null id is
    larger than any id; a component without ids has a null component. Texts without a
    word have fingerprint zero and link like any other. Empty table: empty result.
    """
    fp, comp, kept, row = fresh(docs.columns, "fingerprint", "component_id", "kept", "row")
    marked = written(docs.withColumn(fp, fingerprint(F.col(text_col), shingle)).withColumn(row, F.monotonically_increasing_id()))
    ids = marked.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                                        F.col(row).alias("row")).alias("k"))
    nodes = written(ids.groupBy("fp").agg(F.min("k").alias("k")))
    comps = components(fingerprint_links(nodes, max_distance))
    rooted = nodes.join(comps, nodes["fp"] == comps["id"], "left").select(
        "fp", "k", F.coalesce("component", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("k").alias("best"))
    named = rooted.join(best, "root").select(F.col("fp").alias(fp), F.col("best.id").alias(comp),
                                             F.col("best.row").alias(kept))
    out = marked.join(named, fp).withColumn(kept, F.col(kept) == F.col(row))
    return out.select(*docs.columns, fp, comp, kept), [fp, comp, kept]


@register("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, (fp, comp, kept) = near_duplicates(docs, 3, 3)
    return out.select("doc_id", F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), F.col(comp), F.col(kept))
