"""Whitening, hard negatives and decontamination against brute force, closed forms and SQL."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens.llm import decontaminate, integers, negatives, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [], 1), (9004, [float("nan")] + [1.0] * 5, 1), (9005, [None] + [1.0] * 5, 1), (9006, [float("inf")] + [1.0] * 5, 1)]


# ---- 11: hard negatives

@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (5, 3, 7), (64, 64, 64), (130, 65, 97), (33, 128, 300)])
@pytest.mark.parametrize("top", [100, 2 ** 28])
def test_strassen_is_exact(m, k, n, top):
    r = np.random.default_rng(m + n)
    a, b = r.integers(-top, top, (m, k)), r.integers(-top, top, (k, n))
    want = (a.astype(object) @ b.astype(object)).astype(np.int64)
    assert (negatives.strassen(a, b, leaf=8) == want).all() and (negatives.strassen(a, b) == want).all()


def test_strassen_halves_and_refuses_overflow(monkeypatch):
    seen = []
    plain = negatives._multiply
    monkeypatch.setattr(negatives, "_multiply", lambda a, b, levels, exact: seen.append(levels) or plain(a, b, levels, exact))
    negatives.strassen(np.ones((64, 64), np.int64), np.ones((64, 64), np.int64), leaf=16)
    assert seen.count(2) == 1 and seen.count(1) == 7 and seen.count(0) == 49
    with pytest.raises(OverflowError):
        negatives.strassen(np.full((2, 2), 2 ** 40), np.full((2, 2), 2 ** 40))
    assert negatives.strassen(np.zeros((0, 3), np.int64), np.zeros((3, 2), np.int64)).shape == (0, 2)


def test_heaps_merge_like_sorting():
    r = np.random.default_rng(3)
    h, rows, score, ids = negatives.Heaps(4, 3), r.integers(0, 4, 300), r.integers(0, 9, 300), r.integers(0, 40, 300)
    for part in np.array_split(np.arange(300), 7):
        h.push(rows[part], score[part], ids[part])
    want = {q: sorted({(-s, i) for x, s, i in zip(rows, score, ids) if x == q})[:3] for q in range(4)}
    got = {}
    for q, s, i in zip(*h.held()):
        got.setdefault(int(q), []).append((-int(s), int(i)))
    assert got == {q: [(int(s), int(i)) for s, i in v] for q, v in want.items()}


def plain_negatives(rows, every):
    rows = sorted({(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)), c) for i, v, c in rows})
    out = set()
    for i, v, c in rows:
        if i % every:
            continue
        score = {j: (int(np.dot(v, w)), d == c) for j, w, d in rows if j != i}
        order = sorted(score, key=lambda j: (-score[j][0], j))
        for p in [j for j in order if score[j][1]][:5]:
            s = score[p][0]
            fit = [j for j in order if not score[j][1] and 50 * s <= 100 * score[j][0] <= 95 * s][:3]
            out |= {(i, p, k, j, s, score[j][0]) for k, j in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("block,tile", [(8192, 2048), (4, 16)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(negatives, "BLOCK", block)
    r = np.random.default_rng(5)
    x = np.round(r.standard_normal((300, 6)), 1)                                # coarse: many equal scores
    x[200:240] = x[7]
    rows = [(i, [float(v) for v in x[i]], int(i % 4)) for i in range(300)]
    none = [*ODD, (None, [1.0] * 6, 1), (9007, [1.0] * 6, None)]
    df = spark.createDataFrame([*rows, *rows[:9], *none], SCHEMA).withColumn("rank", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_negatives(rows, 10)


def test_hard_negatives_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.75, 3.0], 2), (3, [-1.0, 0.0], 2), (4, None, 1)], SCHEMA)
    got = negatives.hard_negatives(one, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 49152)]               # the shorter vector ends in zeros
    assert negatives.hard_negatives(one.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(one.where("vec_id in (0, 2)"), F.col("vec_id") == 0).count() == 0


def test_hard_negatives_sql_and_zero_windows(spark):
    # a positive score of zero admits zero only, a negative one nothing
    rows = [(0, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (2, [0.0, 2.0], 1), (4, [-1.0, 0.0], 0), (5, [0.0, 0.0], 1), (6, [-0.5, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(0, 3, 1, 2, 0, 0), (0, 3, 2, 5, 0, 0)]


# ---- 12: whitening

def test_polynomial_equals_fractions(spark):
    r = np.random.default_rng(2)
    b = r.integers(-9, 9, (7, 5))
    m = (b @ b.T).tolist()                                                       # rank 5: two roots of zero
    got = whiten.characteristic_polynomial(spark, m)
    for x in range(8):                                                           # degree 7: eight values settle it
        a = [[Fraction(x * (i == j) - m[i][j]) for j in range(7)] for i in range(7)]
        det = Fraction(1)
        for k in range(7):
            p = next((i for i in range(k, 7) if a[i][k]), None)
            if p is None:
                det = Fraction(0)
                break
            if p != k:
                a[k], a[p], det = a[p], a[k], -det
            det *= a[k][k]
            for i in range(k + 1, 7):
                f = a[i][k] / a[k][k]
                a[i] = [u - f * v for u, v in zip(a[i], a[k])]
        assert det == sum(c * x ** i for i, c in enumerate(got))
    assert got[0] == got[1] == 0 != got[2]


def test_roots_with_multiplicity():
    def poly(roots):
        c = [1]
        for r in roots:
            c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        return c

    found = whiten.largest_roots(poly([0, 0, 3, 5, 5, 1000, 1001]), 9, bits=64)
    near = [((2 * low + 1) / 2 ** (shift + 1), times) for low, shift, times in found]
    assert [t for _, t in near] == [1, 1, 2, 1]
    assert np.allclose([v for v, _ in near], [1001, 1000, 5, 3], atol=1e-12)
    assert whiten.largest_roots([0, 0, 1], 4) == []
    assert whiten.roots_above(poly([1, 2, 4]), 2, 0) == 1 and whiten.roots_above(poly([1, 2, 4]), 3, 1) == 2


def plain_whitening(rows, k):
    x = np.floor(256 * np.array([v for _, v, _ in rows], np.float32).astype(float))
    u = np.unique(x, axis=0)
    c = u - u.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return (x - u.mean(0)) @ v / np.sqrt(e), e / np.trace(c.T @ c / len(u)), x, u


def test_whitening_equals_eigh(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 6)) @ np.diag([3, 2, 1.5, 1, .5, .2]) + 5
    x[300:] = x[3]                                                               # copies count once in the fit
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(400)]
    df = spark.createDataFrame([*rows, *ODD], SCHEMA).withColumn("whitened", F.lit("clash")).withColumn("x", F.lit(2)).repartition(3)
    out, model, error, (w, dev) = whiten.whiten(df)
    got = {q.vec_id: q for q in out.collect()}
    assert out.columns == [*df.columns, w, dev] and w == "whitened_" and set(got) == set(range(400))
    want, share, ints, fit = plain_whitening(rows, 4)
    have = np.array([got[i][w] for i in range(400)])
    assert np.allclose(have * np.sign((have * want).sum(0)), want, atol=1e-9)
    assert model.n == len(fit) == 300 + (0 if any((ints[:300] == ints[3]).all(1)) else 1)
    assert np.allclose([model.explained(i) for i in range(4)], share, rtol=1e-10) and error < 1e-9
    s = fit.sum(0)
    assert [int(got[i][dev]) for i in range(400)] == [int(((model.n * ints[i] - s) ** 2).sum()) for i in range(400)]
    c = np.array(model.components)
    assert np.allclose(c @ c.T, np.eye(4), atol=1e-15)


def test_whitening_of_equal_eigenvalues_and_low_rank(spark):
    corners = [(i, [float(v) for v in p], 0) for i, p in enumerate([(1, 0, 0, 7), (-1, 0, 0, 7), (0, 1, 0, 7), (0, -1, 0, 7), (0, 0, 1, 7), (0, 0, -1, 7)])]
    out, model, error, (w, _) = whiten.whiten(spark.createDataFrame(corners, SCHEMA))
    assert len(model.roots) == 3 and len(set(model.roots)) == 1 and error < 1e-12    # the constant entry has no component
    have = np.array([q[w] for q in out.collect()])
    assert np.allclose(have.T @ have / 6, np.eye(3), atol=1e-12)


def test_whitening_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], SCHEMA)
    out, model, error, (w, dev) = whiten.whiten(df)
    assert [(list(q[w]), int(q[dev])) for q in out.collect()] == [([], 0)] * 3 and (model.n, error) == (1, 0.0)
    out, model, _, _ = whiten.whiten(df.limit(0))
    assert out.count() == 0 and model.n == 0
    with pytest.raises(Exception, match="different lengths"):
        whiten.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA))


def test_whitening_of_large_entries(spark):
    big = [(i, [1e9 * i, 3.0e8 * (i % 3), float(i * i)], 0) for i in range(9)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    out, model, error, (w, dev) = whiten.whiten(df)
    ints = [[int(np.floor(256 * v)) for v in x] for _, x, _ in big]
    s = [sum(c) for c in zip(*ints)]
    assert {q.vec_id: int(q[dev]) for q in out.collect()} == {i: sum((9 * a - b) ** 2 for a, b in zip(x, s)) for i, x in enumerate(ints)}
    assert len(model.roots) == 3 and error < 1e-6


def test_matrix_pads_and_floors(spark):
    lists = pa.array([[1, 2], [], [3, 4, 5]], pa.list_(pa.int64()))
    assert integers.matrix(lists, pad=True).tolist() == [[1, 2, 0], [0, 0, 0], [3, 4, 5]]
    with pytest.raises(ValueError, match="different lengths"):
        integers.matrix(lists)
    assert integers.matrix(lists.slice(2)).tolist() == [[3, 4, 5]]
    row = spark.createDataFrame([(1, [-0.001, 0.5, -1.0], 0)], SCHEMA).select(integers.whole(F.col("embedding"), 256).alias("x")).first()
    assert row.x == [-1, 128, -256]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(1, [1e300])], "i long, v array<double>").select(integers.whole(F.col("v"), 256)).collect()


# ---- 13: decontamination

def plain_words(t):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_near(words, window, slack):
    need = {t: window.count(t) for t in window}
    return any(all(words[s:s + len(window) + slack].count(t) >= n for t, n in need.items()) for s in range(len(words)))


def plain_contamination(docs, items, slack=2):
    runs = []
    for i, t in items:
        w = plain_words(t)
        runs += [("null" if i is None else str(i), w[s:s + 10]) for s in range(max(len(w) - 9, 1)) if w]
    out = []
    for d, t in docs:
        w, hit, held, near = plain_words(t), set(), set(), set()
        for i, run in runs:
            for s in range(len(w) - len(run) + 1):
                if w[s:s + len(run)] == run:
                    hit |= set(range(s, s + len(run)))
                    held.add(i)
            if plain_near(w, run, slack):
                near.add(i)
        out.append((d, len(w), len(hit), tuple(sorted(held)), tuple(sorted(near))))
    return out


def case(seed=1):
    r = random.Random(seed)

    def prose(n):
        return " ".join(r.choice(["a", "the", "of"]) if r.random() < 0.4 else "w%d" % r.randrange(60) for _ in range(n))

    items = [(i, prose(r.choice([3, 9, 10, 11, 25, 40]))) for i in range(12)]
    items += [(12, None), (13, " .,! "), (14, items[4][1].upper()), (4, items[5][1]), (None, "naïve Ünder x"), (15, "a a a the a"), (16, "a " * 14)]
    docs = [(i, prose(r.choice([2, 30, 120]))) for i in range(20)]
    for i in range(20, 44):
        t = r.choice(items[:12] + items[14:])[1].split()
        cut = t[r.randrange(max(len(t) - 10, 1)):]
        if i % 3 == 0 and len(cut) > 3:
            cut[1], cut[2] = cut[2], cut[1]                                      # a proximity match, no phrase
        docs.append((i, prose(15) + (". " if i % 2 else "-") + " ".join(cut) + "\n" + prose(r.choice([0, 3]))))
    docs += [(44, None), (45, ""), (46, "?!"), (47, "x NAÏVE ünder naïve Ünder X"), (None, items[3][1]), (48, "the a a a a a the a"), docs[30], docs[30]]
    return docs, items


@pytest.mark.parametrize("segment,block", [(1 << 20, 100_000), (40, 60)])
def test_contamination_equals_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate.build, "__defaults__", ("doc_id", "text", segment))
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("term", F.lit(1)).repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    got = decontaminate.contamination(d, b).collect()
    want = plain_contamination(docs, items)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near_items)) for r in got), key=key) == sorted(want, key=key)
    assert sum(n > 0 for *_, n, _, _ in want) > 15 and any(set(near) > set(held) for *_, held, near in want)
    for r in got:
        assert sum(e - s for s, e in r.spans) == r.n_hit and all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:]))


def test_contamination_equals_sql(spark, tmp_path):
    docs, items = case(2)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = decontaminate.op13_benchmark_decontamination(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.register(name, spark.read.parquet(str(tmp_path / f"{name}.parquet")).toArrow())
    rel = con.execute(decontaminate.ORACLE_SQL)
    names = [c[0] for c in rel.description]
    assert names == got.columns
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got.collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.items_sha256 for r in got.where("n_items = 0").collect()} == {empty}


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.contamination(docs, items).first()
    assert (r.doc_id, r.n_words, r.n_hit, r["items"]) == (1, 3, 0, [])
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_index_lists_every_word_once(spark):
    docs, _ = case(3)
    index = decontaminate.build(spark.createDataFrame(docs, "doc_id long, text string"), segment=50).collect()
    owned = sum(r.owned for r in index if r.term is None)
    assert owned == sum(len(plain_words(t)) for _, t in docs) and sum(r.words or 0 for r in index if r.term is None) == owned
    assert all(r.n == len(r.positions) and r.positions == sorted(r.positions) for r in index if r.term is not None)
