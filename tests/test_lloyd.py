"""Batched k-means against one model at a time in plain numpy, and the scan's edges."""

import numpy as np
import pytest

from tablelens.functions import lloyd
from tablelens.operators import cluster as cl
from tablelens.plans import analyze as an


def plain_lloyd(x, c, max_iter, tol):
    """Lloyd's iterations of one model; (centroids, cost, iterations)."""
    for step in range(max_iter):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        moved = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        cost = d[np.arange(len(x)), at].sum()
        if ((moved - c) ** 2).sum() <= tol or step + 1 == max_iter:
            return c, cost, step + 1
        c = moved


def plain_silhouette(x, c):
    at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = []
    for i in range(len(x)):
        own = at == at[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, at == j].mean() for j in set(at.tolist()) - {at[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((60, 3)) * 0.6 + c for c in ([0, 0, 0], [5, 0, 1], [0, 6, 2], [5, 5, 9])])
    x = np.concatenate([x, np.repeat(x[:1], 80, 0)])                               # a hot value
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in x], "a double, b double, c double").repartition(5)
    return x, df


def test_batched_models_equal_single_ones(blobs):
    x, df = blobs
    sample = lloyd.seed_rows(df, 42)
    assert len(sample) == len(np.unique(x, axis=0))
    models = lloyd.settle(df, [lloyd.start(sample, k, s) for k in (2, 3, 4, 5) for s in range(3)], 50, 1e-6)
    for m in models:
        c, cost, steps = plain_lloyd(x, lloyd.start(sample, m.k, m.seed).centroids, 50, 1e-6)
        assert np.allclose(m.centroids, c, atol=1e-9) and m.cost == pytest.approx(cost, rel=1e-9) and m.iterations == steps
        assert m.sizes.sum() == len(x)
    for m, s in zip(models, lloyd.silhouettes(df, models)):
        assert s == pytest.approx(plain_silhouette(x, m.centroids), abs=1e-9)


def test_settled_models_leave_the_scan(blobs, monkeypatch):
    _, df = blobs
    seen, plain = [], lloyd._per_centroid
    monkeypatch.setattr(lloyd, "_per_centroid", lambda rows, many, *a: seen.append(many) or plain(rows, many, *a))
    models = lloyd.settle(df, [lloyd.start(lloyd.seed_rows(df, 1), k, s) for k in (2, 6) for s in range(4)], 50, 1e-6)
    assert len(seen) == max(m.iterations for m in models) and seen[0] == 32 and seen == sorted(seen, reverse=True) and seen[-1] < 32


def test_scan_finds_the_planted_clusters(blobs, spark):
    _, df = blobs
    got = {r.k: r for r in cl.kmeans_scan(df, ["a", "b", "c"]).collect()}
    assert sorted(got) == list(range(2, 9)) and [k for k, r in got.items() if r.suggested] == [4]
    assert all(got[k].inertia >= got[k + 1].inertia for k in range(2, 8)) and got[4].silhouette > 0.8


def test_scan_of_few_equal_or_missing_rows(spark):
    schema = "a double, b double"
    three = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0), (0.0, 9.0), (None, 1.0), (float("nan"), 1.0)], schema)
    assert [(r.k, r.suggested) for r in cl.kmeans_scan(three, ["a", "b"]).collect()] == [(2, True)]
    equal = spark.createDataFrame([(1.0, 2.0)] * 12, schema)
    assert [(r.inertia, r.silhouette) for r in cl.kmeans_scan(equal, ["a", "b"]).collect()] == [(0.0, 0.0)] * 7
    assert cl.kmeans_scan(equal.limit(2), ["a", "b"]).count() == 0
    assert cl.kmeans_scan(equal.limit(0), ["a", "b"]).count() == 0


def test_clustering_report_ends(blobs):
    _, df = blobs
    texts = [r["text"] for r in an.run_step("clustering_analysis", df, None, None).collect()]
    assert any("4" in t for t in texts)
