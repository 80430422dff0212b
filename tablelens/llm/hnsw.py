"""Embedding near-duplicates over sharded navigable small-world graphs (1).

Vectors meet only under equal labels. Equal vectors are one point with a count. Each
label's points are hashed into shards of about ``SHARD``; every shard builds a
hierarchical graph. Query blocks of the same label go to every shard, once each, as
(shard, block) groups of bounded size, so a hot label is many even groups.

A search keeps a beam of ``BEAM`` candidates. While a query's beam is full of links it is
widened (doubled), so a group of thousands is found whole. Every point of a shard is searched
for by its own vector once the graph is built; those not found (few links lead there) are
compared with every query instead. Of each block ``AUDIT`` rows are audited by brute force
over the shard: while one of their true ``NEAR`` nearest points is missing, whatever its cosine, the
block's beam is doubled (no miss in 256 points: recall above 98.8 % at 95 % confidence), and from a
``SCAN``-th of the shard on the whole shard is compared. Found candidates are verified by cosine in double
precision. Tasks return link counts per point and a spanning forest of their links, never
the pairs of a group; components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.ann import _valid
from tablelens.llm.common import broadcast_if_small, components, register, table, unite, written

SHARD, QUERY_BLOCK = 16_384, 8192
OUT_LINKS, IN_LINKS, BUILD_BEAM, BEAM, LANES, EXPAND = 12, 24, 40, 32, 512, 4
AUDIT, NEAR, SCAN = 64, 4, 16
THRESHOLD = 0.93


class Graph:
    """Layers over prefixes of a random order of the points: layer l holds the first n / 16**l."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None):
        self.x = x.astype(np.float32)
        self.links = links if links is not None else []

    @classmethod
    def build(cls, x: np.ndarray) -> "Graph":
        g = cls(x)
        sizes = [len(x)]
        while sizes[-1] > 256:
            sizes.append(sizes[-1] // 16)
        for size in reversed(sizes):
            g._add_layer(size)
        return g

    def _add_layer(self, size: int) -> None:
        out = np.full((size, OUT_LINKS), -1, np.int32)
        into = np.full((size, IN_LINKS), -1, np.int32)
        into_sim = np.full((size, IN_LINKS), -2.0, np.float32)
        done = 0
        while done < size:
            stop = min(size, max(256, 2 * done), done + 1024)
            batch = np.arange(done, stop)
            sim = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(sim, -2.0)
            ids = np.broadcast_to(batch, sim.shape)
            if done:
                start = self._descend(self.x[batch])
                start = np.where(start < done, start, 0)
                near, near_sim = self._walk(np.concatenate([out[:done], into[:done]], 1), self.x[batch], start, BUILD_BEAM)
                ids, sim = np.concatenate([near, ids], 1), np.concatenate([near_sim, sim], 1)
            width = min(BUILD_BEAM, sim.shape[1])
            top = np.argsort(-sim, 1, kind="stable")[:, :width]
            ids, sim = np.take_along_axis(ids, top, 1), np.take_along_axis(sim, top, 1)
            ids = np.where(sim > -2, ids, -1)
            out[batch] = self._spread(ids, sim)
            self._answer(batch, out[batch], into, into_sim)
            done = stop
        self.links.insert(0, np.concatenate([out, into], 1))

    def _spread(self, ids: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Neighbours in different directions: one is passed over if it is closer to a chosen one; free places go to the nearest of those."""
        v = self.x[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        n, width = ids.shape
        chosen = np.zeros((n, width), bool)
        count = np.zeros(n, int)
        for c in range(width):
            blocked = (chosen & (among[:, c] > sim[:, c, None])).any(1)
            take = ~blocked & (ids[:, c] >= 0) & (count < OUT_LINKS)
            chosen[:, c] = take
            count += take
        order = np.argsort(np.where(chosen, 0, 1) + np.where(ids >= 0, 0, 2), 1, kind="stable")[:, :OUT_LINKS]
        kept = np.take_along_axis(ids, order, 1)
        full = np.full((n, OUT_LINKS), -1, np.int32)
        full[:, :kept.shape[1]] = kept
        return full

    def _answer(self, batch: np.ndarray, out: np.ndarray, into: np.ndarray, into_sim: np.ndarray) -> None:
        """Links back; a full list keeps its nearest."""
        frm, to = np.repeat(batch, OUT_LINKS), out.ravel()
        frm, to = frm[to >= 0], to[to >= 0]
        if not len(to):
            return
        s = np.einsum("ij,ij->i", self.x[frm], self.x[to])
        old = np.unique(to)
        r, c = np.nonzero(into[old] >= 0)
        frm = np.concatenate([frm, into[old][r, c]])
        s = np.concatenate([s, into_sim[old][r, c]])
        to = np.concatenate([to, old[r]])
        order = np.lexsort((-s, to))
        frm, to, s = frm[order], to[order], s[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        keep = place < IN_LINKS
        into[old], into_sim[old] = -1, -2.0
        into[to[keep], place[keep]], into_sim[to[keep], place[keep]] = frm[keep], s[keep]

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """Entry point for the layer below the lowest one present."""
        at = np.zeros(len(q), np.int64)
        for layer in reversed(self.links):
            ids, _ = self._walk(layer, q, at, 8)
            at = ids[:, 0].astype(np.int64)
        return at

    def _walk(self, layer: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows of q side by side: (ids, similarities), best first, -1 where fewer are reachable."""
        ids_all, sim_all = [], []
        for lo in range(0, len(q), LANES):
            i, s = self._walk_lanes(layer, q[lo:lo + LANES], start[lo:lo + LANES], beam)
            ids_all.append(i)
            sim_all.append(s)
        return np.concatenate(ids_all), np.concatenate(sim_all)

    def _walk_lanes(self, layer, q, start, beam):
        n, m = len(q), len(layer)
        seen, turn = np.zeros(n * m, bool), np.empty(n * m, np.int32)
        live = np.arange(n)
        ids_all, sim_all = np.full((n, beam), -1, np.int64), np.full((n, beam), -2.0, np.float32)
        # the beams of the rows still walking
        ids, sim, todo = ids_all.copy(), sim_all.copy(), np.zeros((n, beam), bool)
        ids[:, 0], sim[:, 0], todo[:, 0] = start, np.einsum("ij,ij->i", self.x[start], q), True
        seen[live * m + start] = True
        while len(live):
            rank = np.where(todo, -sim, 3.0)
            pick = np.argpartition(rank, min(EXPAND, beam) - 1, 1)[:, :min(EXPAND, beam)]
            r, c = np.nonzero(np.take_along_axis(rank, pick, 1) < 3)
            at = pick[r, c]
            todo[r, at] = False
            to = layer[ids[r, at]]
            r, c = np.repeat(r, to.shape[1]), to.ravel()
            key = (live * m)[r] + c
            new = np.flatnonzero((c >= 0) & ~seen[key])
            r, to, key = r[new], c[new], key[new]
            count = np.arange(len(key), dtype=np.int32)
            turn[key] = count
            once = turn[key] == count                          # a node reached twice in one step counts once
            r, to = r[once], to[once]
            seen[key] = True
            s = np.einsum("ij,ij->i", self.x[to], q[live[r]])
            better = s > sim.min(1)[r]
            r, to, s = r[better], to[better], s[better]
            if len(r):
                place = np.arange(len(r)) - np.searchsorted(r, r)
                wide = int(place.max()) + 1
                add_i = np.full((len(live), wide), -1, np.int64)
                add_s = np.full((len(live), wide), -2.0, np.float32)
                add_i[r, place], add_s[r, place] = to, s
                more_s = np.concatenate([sim, add_s], 1)
                top = np.argpartition(-more_s, beam - 1, 1)[:, :beam]
                sim = np.take_along_axis(more_s, top, 1)
                ids = np.take_along_axis(np.concatenate([ids, add_i], 1), top, 1)
                todo = np.take_along_axis(np.concatenate([todo, add_i >= 0], 1), top, 1)
            on = todo.any(1)
            if not on.all():
                ids_all[live[~on]], sim_all[live[~on]] = ids[~on], sim[~on]
                live, ids, sim, todo = live[on], ids[on], sim[on], todo[on]
        order = np.argsort(-sim_all, 1, kind="stable")
        return np.take_along_axis(ids_all, order, 1), np.take_along_axis(sim_all, order, 1)

    def _start(self, q: np.ndarray) -> np.ndarray:
        start = np.zeros(len(q), np.int64)
        for layer in reversed(self.links[1:]):
            ids, _ = self._walk(layer, q, start, 8)
            start = ids[:, 0]
        return start

    def nearest(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The points in each row's beam, best first."""
        q = q.astype(np.float32)
        return self._walk(self.links[0], q, self._start(q), min(beam, len(self.x)))[0]

    def lost(self, beam: int) -> np.ndarray:
        """Points that a search for their own vector doesn't find."""
        if not len(self.x):
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.nearest(self.x, beam) != np.arange(len(self.x))[:, None]).all(1))

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, point) of at least that similarity, as far as the beam finds them; full beams are widened."""
        q = q.astype(np.float32)
        n = len(self.x)
        start = self._start(q)
        rows, found_r, found_i = np.arange(len(q)), [], []
        while len(rows):
            beam = min(beam, n)
            ids, sim = self._walk(self.links[0], q[rows], start[rows], beam)
            full = (sim[:, -1] >= least) & (beam < n)
            r, c = np.nonzero((sim >= least) & ~full[:, None])
            found_r.append(rows[r])
            found_i.append(ids[r, c])
            rows = rows[full]
            beam *= 2
        return np.concatenate(found_r or [rows]), np.concatenate(found_i or [rows])


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in v])


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph as one row."""
    rows = rows.sort_values("point").reset_index(drop=True)
    rows = rows.iloc[np.random.default_rng(5).permutation(len(rows))].reset_index(drop=True)
    x = _stack(rows["u"])
    g = Graph.build(x)
    return pd.DataFrame({"label": [rows["label"][0]], "shard": [rows["shard"][0]], "blocks": [rows["blocks"][0]],
                         "points": [rows["point"].to_numpy(np.int64).tobytes()], "copies": [rows["copies"].to_numpy(np.int64).tobytes()],
                         "x": [x.tobytes()], "lost": [g.lost(BEAM).astype(np.int64).tobytes()], "sizes": [[len(a) for a in g.links]], "links": [[a.tobytes() for a in g.links]]})


def _scan(u: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of u, row of x) of at least that similarity."""
    found = [(k + r, c) for k in range(0, len(u), 512) for r, c in [np.nonzero(u[k:k + 512] @ x.T >= least)]]
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def _candidates(g: Graph, u: np.ndarray, x: np.ndarray, lost: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of u, point) of at least that similarity, by a beam that passes the audit or by comparing all."""
    probe = np.unique(np.linspace(0, len(u) - 1, AUDIT).astype(int))
    near = np.argsort(-(u[probe] @ x.T), 1, kind="stable")[:, :NEAR]
    easy, beam = np.isin(near, lost), BEAM
    while beam * SCAN < len(x):
        ids = g.nearest(u[probe], beam)
        if (easy | (near[:, :, None] == ids[:, None]).any(2)).all():
            row, at = g.within(u, least, beam)
            if not len(lost):
                return row, at
            walked = ~np.isin(at, lost)
            r, c = _scan(u, x[lost], least)
            return np.concatenate([row[walked], r]), np.concatenate([at[walked], lost[c]])
        beam *= 2
    return _scan(u, x, least)


def _probe(threshold: float):
    """Links of one query block in one shard: rows (a, b, n): b null: n more links of point a; else a forest edge."""

    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")})
        if not len(q) or not len(s):
            return none
        s = s.iloc[0]
        points, copies = np.frombuffer(s["points"], np.int64), np.frombuffer(s["copies"], np.int64)
        x = np.frombuffer(s["x"], np.float64).reshape(len(points), -1)
        g = Graph(x, [np.frombuffer(b, np.int32).reshape(n, -1) for b, n in zip(s["links"], s["sizes"])])
        q = q.sort_values("point").reset_index(drop=True)
        u, own = _stack(q["u"]), q["point"].to_numpy(np.int64)
        row, at = _candidates(g, u, x, np.frombuffer(s["lost"], np.int64), threshold - 1e-4)
        sim = np.concatenate([np.einsum("ij,ij->i", u[row[k:k + 200_000]], x[at[k:k + 200_000]])
                              for k in range(0, max(1, len(row)), 200_000)])
        linked = sim >= threshold
        row, at = row[linked], at[linked]
        other = own[row] != points[at]
        row, at = row[other], at[other]
        counts = np.bincount(row, copies[at], len(u)).astype(np.int64)
        nodes = np.unique(np.concatenate([own[row], points[at]])) if len(row) else np.zeros(0, np.int64)
        label = unite(np.arange(len(nodes)), np.searchsorted(nodes, own[row]), np.searchsorted(nodes, points[at]))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        has = np.flatnonzero(counts)
        return pd.concat([pd.DataFrame({"a": own[has], "b": pd.array([None] * len(has), "Int64"), "n": counts[has]}),
                          pd.DataFrame({"a": nodes[moved], "b": pd.array(nodes[label[moved]], "Int64"), "n": 0})], ignore_index=True)

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                           label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Linked: equal labels, not null, and cosine at least ``threshold``. Vectors that are null,
    empty, all zero or hold null or non-finite components, and rows without id or label,
    link with nothing: no links, their own component, kept (a row without id: null component, not
    kept). Rows that repeat an id with its vector and label are one vector. Empty table: empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _valid("v"))
    good = good.withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("h", F.xxhash64("v"))
    points = written(good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("point"), F.count_distinct("vec_id").alias("copies")))
    # |v| may under- or overflow for extreme components: scale by the largest first
    big = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = points.withColumn("s", F.transform("v", lambda x: x / big))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    unit = scaled.select("label", "point", "copies", F.transform("s", lambda x: x / norm).alias("u"))
    sizes = broadcast_if_small(points.groupBy("label").agg(F.count("*").alias("n")))
    unit = (unit.join(sizes, "label").withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int"))
            .withColumn("blocks", F.ceil(F.col("n") / QUERY_BLOCK).cast("int"))
            .withColumn("shard", F.pmod(F.xxhash64("point"), F.col("shards")).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("point", F.lit(1)), F.col("blocks")).cast("int")))
    kind = unit.schema["label"].dataType.simpleString()
    graphs = written(unit.select("label", "shard", "blocks", "point", "copies", "u").groupBy("label", "shard").applyInPandas(
        _pack, f"label {kind}, shard int, blocks int, points binary, copies binary, x binary, lost binary, sizes array<long>, links array<binary>"))
    asked = unit.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("label", "shard", "block", "point", "u")
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ("label", "shard", "block")
    found = written(asked.groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInPandas(_probe(threshold), "a long, b long, n long"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    comps = components(found.where("b IS NOT NULL").select("a", "b"))
    per_point = (points.join(links, points["point"] == links["a"], "left")
                 .select("label", "h", "v", "point", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per_point = (per_point.join(comps, F.col("point") == F.col("id"), "left")
                 .select(F.col("label").alias("pl"), F.col("h").alias("ph"), F.col("v").alias("pv"), "n_links",
                         F.coalesce("component", "point").alias("component_id")))
    keyed = rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("h", F.xxhash64("v"))
    # points are named by their smallest id, so a component's smallest point is its smallest id
    out = keyed.join(per_point, (F.col("label") == F.col("pl")) & (F.col("h") == F.col("ph")) & (F.col("v") == F.col("pv"))
                     & F.col("vec_id").isNotNull(), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


@register("op1_vector_near_duplicates")
def op1_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
