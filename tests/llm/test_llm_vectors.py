"""Vector operators, archive revisits and the pipeline against brute force and SQL."""

import random
import tracemalloc

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.llm import ann, hnsw, warc

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [float("nan")] + [1.0] * 7, 1), (9005, [None] + [1.0] * 7, 1),
       (9006, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (9007, [1.0] * 8, None)]


def vectors(n=900, copies=60, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 8)).astype(np.float32)
    x[n // 2:n // 2 + copies] = x[7] + 0.02 * r.standard_normal((copies, 8))   # a group of near copies
    x[-copies:] = x[11]                                                        # and one of equal ones
    return [(i, x[i].tolist(), int(i % 3 == 0) if i < n // 2 else 1) for i in range(n)]


@pytest.mark.parametrize("shard,block", [(16_384, 8192), (150, 90)])
def test_links_equal_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", block)
    rows = vectors()
    extra = rows[5]                                                            # a repeated row is one vector
    df = spark.createDataFrame([*rows, *ODD, extra], SCHEMA).withColumn("n_links", F.lit("clash"))
    got = hnsw.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([c for *_, c in rows])
    link = (x @ x.T >= 0.93) & (y[:, None] == y[None])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None], 10**9).min(1))
        if (new == comp).all():
            break
        comp = new
    for r in got:
        if r.vec_id is None:
            assert r.n_links == 0 and r.component_id is None and not r.kept
        elif r.vec_id >= 9000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id) == (link[r.vec_id].sum(), comp[r.vec_id])
            assert r.kept == (r.vec_id == r.component_id)


def test_links_of_empty_and_bad_tables(spark):
    assert hnsw.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hnsw.near_duplicate_vectors(spark.createDataFrame(ODD, SCHEMA)).count() == len(ODD)


def test_graph_search_is_no_scan():
    x = np.random.default_rng(2).standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x)
    assert [len(a) for a in g.links] == [4000, 250]
    q = x[:200].astype(np.float32)
    ids, _ = g._walk(g.links[0], q, np.zeros(200, np.int64), 64)
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(t) & set(i)) / 10 for t, i in zip(true, ids)]) > 0.9


def test_points_that_the_graph_lost_are_linked(monkeypatch):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    build, hidden = hnsw.Graph.build, []

    def cut(v):
        g = build(v)
        hidden.append(v[2000])
        g.links = [np.where(a == 2000, -1, a).astype(np.int32) for a in g.links]      # nothing leads to this point
        return g

    monkeypatch.setattr(hnsw.Graph, "build", staticmethod(cut))
    shard = hnsw._pack(pd.DataFrame({"label": 1, "shard": 0, "blocks": 1, "point": range(3000), "copies": 1, "u": list(x)}))
    near = r.standard_normal((300, 16))
    near[150] = hidden[0] + 0.005 * r.standard_normal(16)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    out = hnsw._probe(0.93)(pd.DataFrame({"point": range(5000, 5300), "u": list(near)}), shard)
    want = (near @ x.T >= 0.93).sum(1)
    got = out[out.b.isna()].set_index("a").n
    assert want[150] and {int(a) - 5000: int(n) for a, n in got.items()} == {i: int(n) for i, n in enumerate(want) if n}


def test_audit_without_links_is_not_empty():
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ring = np.stack([(np.arange(3000) + d) % 3000 for d in (1, 2)], 1).astype(np.int32)    # a graph that leads nowhere
    u = np.concatenate([r.standard_normal((300, 16)), x[1500:1501] + 0.005])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    row, at = hnsw._candidates(hnsw.Graph(x, [ring]), u, x, np.zeros(0, np.int64), 0.93)
    want = u @ x.T >= 0.93
    assert want[300, 1500] and sorted(zip(row, at)) == sorted(zip(*np.nonzero(want)))


def test_walk_holds_no_beam_for_each_neighbour():
    r = np.random.default_rng(6)
    x = r.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x)
    tracemalloc.start()
    ids = g.nearest(x[:512], 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ids[:, 0] == np.arange(512)).mean() > 0.99 and all(len(set(i)) == 512 for i in ids.tolist())
    assert peak < 60e6                                     # with a beam (2 kB) for each of a step's neighbours: 89e6


def plain_nearest(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        o = [j for j in np.lexsort((ids, d)) if j != i][:k]
        yield ids[i], list(ids[o]), d[o]


def test_neighbours_equal_brute_force_when_windows_cover(spark):
    rows = vectors()
    df = spark.createDataFrame([*rows, *ODD, rows[3]], SCHEMA).withColumn("rank", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = list(plain_nearest(rows, 10))
    assert set(got) == {q for q, *_ in want}
    for q, ids, d in want:
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1] for f in found] == ids
        assert np.allclose([f[2] for f in found], d, atol=1e-12)


def test_neighbours_recall_with_small_windows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rows = vectors(3000, 40, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10, window=32).collect()}
    want = {(q, v) for q, ids, _ in plain_nearest(rows, 10) for v in ids}
    assert len(got & want) >= 0.9 * len(want)


def test_widened_windows_return_no_block_twice(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 32)
    search, made = ann._search, []

    def counted(*args):
        made.append(search(*args).collect())
        return spark.createDataFrame(made[-1], ann._FOUND)

    monkeypatch.setattr(ann, "_search", counted)
    rows = vectors(1000, 40, 8)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, 10, curves=2, window=32, target=1.1).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: ids for q, ids, _ in plain_nearest(rows, 10)}          # the last window holds all
    # 10 queries, 2 curves, 5 doublings; the 31 blocks of the last window alone would give 10 * 2 * 31 * 11 rows
    assert len(made) == 6 and sum(map(len, made)) < 10 * 2 * 6 * 22


def test_blocks_return_nothing_beyond_the_last_place():
    x = pd.DataFrame({"rank": range(6), "ids": [[10 + i] for i in range(6)], "v": [[float(i)] for i in range(6)]})
    q = pd.DataFrame({"query_id": [1, 2], "lo": [0, 0], "hi": [5, 4], "from": [1, 0], "to": [2, -1], "most": [3.0, np.inf], "qv": [[0.0], [5.0]]})
    got = ann._best(q, x, 2)
    assert got.values.tolist() == [[1, 10, 0.0], [1, 13, 3.0], [2, 14, 1.0], [2, 13, 2.0]]


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (5, [1.0, 2.5], None), (100, None, 1)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 5, 0.5)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = ann.hilbert_keys(side, 3)
    assert sorted(key) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# ---- 7: revisits

def test_revisits_equal_sql(spark):
    r = random.Random(7)
    hosts = ["http://www.Hot.example/a/", "https://hot.example/a#x", "http://hot.example:80/a?utm_source=f", "http://b.example/?z=1&a=2", None]
    pages = spark.createDataFrame([(i, r.choice(hosts[:3] * 3 + hosts), None if i % 50 == 7 else "h%d" % (i % 4)) for i in range(400)],
                                  "page_id long, url string, html string").repartition(5)
    got = sorted(tuple(str(x[c]) for c in ("record_id", "canonical_url", "captured_at", "refers_to", "outcome", "headers"))
                 for x in _op7(pages).collect())
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    rel = con.execute("SELECT record_id, canonical_url, captured_at, refers_to, outcome, headers FROM (" + warc.ORACLE_SQL + ")")
    assert got == sorted(tuple(str(x) for x in row) for row in rel.fetchall())
    assert len({g[4] for g in got}) == 3


def _op7(pages):
    out = warc.resolve_revisits(warc.capture_records(pages))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical_url", F.col("at").alias("captured_at"), "refers_to", "outcome", lines.alias("headers"))


def test_revisit_rules(spark):
    schema = "record_id long, url string, at long, kind string, headers map<string,string>, body string, outcome string"
    rows = [(1, "http://x.example/p", 1, "response", {"etag": "a", "content-length": "3", "server": "s"}, "one", None),
            (2, "http://x.example/p", 5, "response", None, "two", None),
            (3, "HTTP://WWW.X.example:80/p/#f", 4, "revisit", {"etag": "W/a", "content-length": "0", "server": "t", "x": "y"}, None, None),
            (4, "http://x.example/p", 4, "revisit", {"etag": "b"}, None, None),
            (5, "http://x.example/p", 9, "revisit", {"etag": "a"}, None, None),
            (6, "http://x.example/p", 1, "revisit", {"etag": "a"}, None, None),
            (7, None, 9, "revisit", None, None, None), (8, "http://x.example/p", None, "revisit", {"etag": "a"}, None, None),
            (0, "http://x.example/p", 1, "revisit", {"etag": "a"}, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {i: r.outcome for i, r in got.items()} == {3: "resolved", 4: "validator_mismatch", 5: "no_validator", 6: "resolved",
                                                     7: "no_earlier_response", 8: "no_earlier_response", 0: "no_earlier_response"}
    assert got[3].headers == {"etag": "W/a", "content-length": "3", "server": "t", "x": "y"} and got[3].body == "one"
    assert got[4].headers is None and got[4].refers_to is None
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    # every row three times: a result per revisit row, none multiplied; a repeated response counts once
    again = [tuple(r) for r in warc.resolve_revisits(df.union(df).union(df).repartition(4)).select(
        "record_id", "outcome", "refers_to", "body").collect()]
    assert sorted(again, key=str) == sorted([(r.record_id, r.outcome, r.refers_to, r.body) for r in got.values()] * 3, key=str)
    # one id, two different revisits: each is judged by its own validators
    more = spark.createDataFrame([(3, "http://x.example/p", 4, "revisit", {"etag": "c"}, None, None)], schema)
    assert sorted(r.outcome for r in warc.resolve_revisits(df.union(more)).where("record_id = 3").collect()) == ["resolved", "validator_mismatch"]


# ---- the pipeline

def test_pipeline_stages(spark, tmp_path):
    r = random.Random(1)

    def text(n, s):
        q = random.Random(s)
        return " ".join("%s%d" % (q.choice("abcdefgh"), q.randrange(5000)) for _ in range(n))

    rows, labels = [], []
    for i in range(240):
        t = text(80, i)
        if i % 6 == 0:
            t = " ".join(w if j % 9 else "badword" for j, w in enumerate(t.split()))
        rows.append((i, t, "en", r.choice("abc"), len(t)))
        if i % 2 == 0:
            labels.append((i, i % 4 // 2, int(i % 6 == 0)))
    rows += [(1000, rows[1][1], "en", "a", 1), (1001, rows[1][1].upper(), "en", "b", 1), (1002, None, None, None, None), (1003, "", "en", "c", 0)]
    block = text(60, 9999)
    rows += [(1100 + i, text(30, 7000 + i) + " " + block, "en", "c", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at.toPandas()
        assert k == 4 or at.columns == docs.columns
    clean = {i for i in range(240) if i % 6} | {1002, 1003, 1000, 1001} | {1100 + i for i in range(4)}
    assert set(seen["toxicity"].doc_id) == clean
    near = set(seen["simhash_near_dedup"].doc_id)
    assert clean - near == {1000, 1001, 1003}
    cut = seen["substring_dedup"].set_index("doc_id")
    assert sum(block in t for t in cut.text.dropna()) == 1 and set(cut.index) == near
    assert all(len(t) == n for t, n in zip(cut.text, cut.n_chars) if t is not None)
    assert set(seen["source_mixing"].doc_id) <= near
    last = seen["sentencepiece_encoding"]
    assert len(last) == len(seen["source_mixing"]) and (last.piece_ids.map(len) == last.n_pieces).all()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
