"""Clustering diagnostics.

* Scale report and standardisation come from one fused aggregate.
* PCA variance ratios are the eigenvalues of the k x k correlation matrix of
  the complete rows (standardised data), decomposed on the driver (k small).
* Hopkins: at most 50 sample points (md5 order, a bounded top-k) and 50
  md5-based pseudo-uniform points are inlined as literals; the nearest
  distances are 100 ``min`` aggregates in a single pass over the data, so no
  join and no pairs are materialised.
* k-means: all (k, restart) models in one scan per iteration, all silhouettes in
  two scans (``functions.lloyd``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import lloyd
from tablelens.functions.columns import q
from tablelens.operators import correlation as co
from tablelens.functions.fused import agg_one_row
from tablelens.functions.moments import complete, present
from tablelens.session import written

# Fixed values that must equal the reference's rules.
MIN_FEATURES = 2
MIN_ROWS = 10
SCALE_RATIO = 10.0
MAX_COMPONENTS = 10
VARIANCE_TARGET = 0.95
HOPKINS_SAMPLE = 50
HOPKINS_STRONG = 0.75
HOPKINS_RANDOM = 0.5
MAX_K = 8
N_INIT = 10
SEED = 42


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return complete(df.select(*[present(q(c)).alias(c) for c in features]))


def scale_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Std (ddof 1) of each feature over all its non-null rows, 3 decimals, plus the
    flag 'scales differ' (max/min of the positive stds > 10)."""
    one = df.agg(*[F.stddev_samp(present(q(c))).alias(f"s{i}") for i, c in enumerate(features)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                     F.round(F.col(f"s{i}"), 3).alias("std")) for i, c in enumerate(features)]
    long = one.select(F.inline(F.array(*rows)))
    pos = long.where(F.col("std") > 0).agg(
        (F.max("std") / F.greatest(F.min("std"), F.lit(1e-9)) > SCALE_RATIO).alias("scales_differ"))
    return long.crossJoin(pos)  # per-feature rows by one row


def standardize(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(x - mean) / std with ddof 0 over the complete rows; zero std leaves x - mean.
    Columns in ``keep`` are carried through unchanged."""
    data = complete(df.select(*[q(c) for c in keep], *[present(q(c)).alias(c) for c in features]), features)
    st = data.agg(*[e for i, c in enumerate(features) for e in
                    (F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}"))]).first()  # one row
    return data.select(*[q(c) for c in keep], *[((q(c) - F.lit(st[f"m{i}"]).cast("double")) / F.lit(st[f"s{i}"] if st[f"s{i}"] else 1.0)).alias(c)
                                                for i, c in enumerate(features)])


def _corr_matrix(df: DataFrame, features: list[str]) -> tuple[np.ndarray, int]:
    pairs = co.pearson_pairs(df, features, complete_rows=True)
    k = len(features)
    mat = np.zeros((k, k))
    n = 0
    for r in pairs.collect():  # k*k rows
        n = r["n"] if r["n"] is not None else n
        if r["r"] is not None:
            mat[r["pos_a"], r["pos_b"]] = r["r"]
    return mat, int(n)


def pca_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """Explained variance ratio per component (<= 10), cumulative, and the first
    component count reaching 95 % (null if none)."""
    spark = df.sparkSession
    mat, n = _corr_matrix(df, features)
    vals = np.sort(np.linalg.eigvalsh(mat))[::-1]
    total = float(np.trace(mat))
    ncomp = min(len(features), n, MAX_COMPONENTS)
    ratios = [float(v / total) if total > 0 else 0.0 for v in vals[:ncomp]]
    cum = np.cumsum(ratios)
    hit = next((i + 1 for i, c in enumerate(cum) if c >= VARIANCE_TARGET - 1e-12), None)
    rows = [(i + 1, ratios[i], float(cum[i]), hit) for i in range(ncomp)]
    return spark.createDataFrame(rows, "component int, variance_ratio double, cumulative double, "
                                       "n_components_for_95pct int")


def pca_projection(df: DataFrame, features: list[str]) -> DataFrame:
    """PC1 and PC2 scores of each complete row (largest loading made positive)."""
    mat, _ = _corr_matrix(df, features)
    vals, vecs = np.linalg.eigh(mat)
    order = np.argsort(vals)[::-1]
    vecs = vecs[:, order]
    z = standardize(df, features)
    out = []
    for comp in range(min(2, len(features))):
        v = vecs[:, comp]
        if v[np.argmax(np.abs(v))] < 0:
            v = -v
        expr = F.lit(0.0)
        for c, w in zip(features, v):
            expr = expr + F.col(c) * F.lit(float(w))
        out.append(expr.alias(f"pc{comp + 1}"))
    return z.select(*out)


def _u01(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2 ** 32


def _row_key(features: list[str]):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in features])


def hopkins(df: DataFrame, features: list[str], seed: int = SEED, m: int | None = None,
            key: str | None = None) -> DataFrame:
    """Hopkins statistic on the standardised complete rows.

    Sample: the first ``min(n, 50)`` rows in ``md5(seed:key)`` order (the row's
    feature text when no key column is given). Uniform points: coordinate j of
    point i is ``lo_j + (hi_j - lo_j) * U`` with ``U = int(md5('seed:u:i:j')[:8],
    16) / 2^32`` inside the standardised bounding box. u = nearest data
    distance of each uniform point; w = nearest distance from each sample point
    to another row (0 when the point is repeated). H = sum u / (sum u + sum w),
    0.5 if both are 0.

    Three passes, nothing cached: moments and ranges (one aggregate; the
    standardisation and the box follow from them), the sample (a bounded
    top-50), and one pass that keeps the 100 nearest distances per task.
    """
    spark = df.sparkSession
    data = complete(df.select(*([q(key)] if key else []), *[present(q(c)).alias(c) for c in features]), features)
    st = agg_one_row(data, [[F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"), F.min(c).alias(f"lo{i}"),
                             F.max(c).alias(f"hi{i}")] + ([F.count(F.lit(1)).alias("n")] if i == 0 else [])
                            for i, c in enumerate(features)], 8).first()  # one row
    n = st["n"] or 0
    if n < 1:
        return spark.createDataFrame([(None, 0)], "hopkins_statistic double, sample_size int")
    mean = [st[f"m{i}"] for i in range(len(features))]
    std = [st[f"s{i}"] if st[f"s{i}"] and st[f"s{i}"] > 0 else 1.0 for i in range(len(features))]
    lo = [(st[f"lo{i}"] - mean[i]) / std[i] for i in range(len(features))]
    hi = [(st[f"hi{i}"] - mean[i]) / std[i] for i in range(len(features))]
    z = data.select(*[((F.col(c) - F.lit(mean[i])) / F.lit(std[i])).alias(c) for i, c in enumerate(features)],
                    *([F.col(key).cast("string").alias("__k")] if key else [_row_key(features).alias("__k")]))
    m = min(n, HOPKINS_SAMPLE) if m is None else m
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("__k")))
    sample = [[r[c] for c in features] for r in z.orderBy(order, *features).limit(m).collect()]  # <= 50 rows
    uni = [[lo[j] + (hi[j] - lo[j]) * _u01(f"{seed}:u:{i}:{j}") for j in range(len(features))]
           for i in range(m)]

    points = np.array(uni + sample, dtype=float)

    def nearest(batches):
        """Per task: each probe's smallest distance and smallest positive one, and its number of zeros."""
        low = np.full(len(points), np.inf)
        positive, zeros = low.copy(), np.zeros(len(points), np.int64)
        for pdf in batches:
            x = pdf.to_numpy(float)
            for i, p in enumerate(points if len(x) else []):
                d = np.sqrt(((x - p) ** 2).sum(1))
                at_zero = d == 0
                zeros[i] += int(at_zero.sum())
                low[i] = min(low[i], d.min())
                if not at_zero.all():
                    positive[i] = min(positive[i], d[~at_zero].min())
        yield pd.DataFrame({"i": np.arange(len(points)), "low": low, "positive": positive, "zeros": zeros})

    found = (z.select(*features).mapInPandas(nearest, "i int, low double, positive double, zeros long").groupBy("i")
             .agg(F.min("low").alias("low"), F.min("positive").alias("positive"), F.sum("zeros").alias("zeros"))
             .orderBy("i").collect())  # one row per probe, <= 100
    su = sum(r["low"] for r in found[:m])
    sw = sum(r["positive"] for r in found[m:] if r["zeros"] < 2 and np.isfinite(r["positive"]))
    h = su / (su + sw) if (su + sw) > 0 else 0.5
    return spark.createDataFrame([(round(float(h), 4), int(m))], "hopkins_statistic double, sample_size int")


def hopkins_band(h) -> str:
    return "strong" if h > HOPKINS_STRONG else ("random" if h < HOPKINS_RANDOM else "some")


def kmeans_scan(df: DataFrame, features: list[str], max_k: int = MAX_K, n_init: int = N_INIT,
                seed: int = SEED, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """For k = 2..min(8, n-1): lowest k-means cost over ``n_init`` seeded restarts
    (iterated to convergence: ``max_iter`` 300, ``tol`` 1e-4), its silhouette (squared
    Euclidean, linear cost), and the suggested k (best silhouette).

    All (k, restart) models advance together, one scan of the standardised complete rows an
    iteration (see ``functions.lloyd``); the rows are written once, for the scans to read.
    """
    spark = df.sparkSession
    z = written(standardize(df, features))
    n = z.count()
    top = min(max_k, n - 1)
    rows = []
    if top >= 2:
        sample = lloyd.seed_rows(z, seed)
        models = lloyd.settle(z, [lloyd.start(sample, k, seed + r) for k in range(2, top + 1) for r in range(n_init)], max_iter, tol)
        best = [min((m for m in models if m.k == k), key=lambda m: (m.cost, m.seed)) for k in range(2, top + 1)]
        rows = [(m.k, round(m.cost, 3), round(s, 4)) for m, s in zip(best, lloyd.silhouettes(z, best))]
    out = spark.createDataFrame(rows, "k int, inertia double, silhouette double")
    if not rows:
        return out.withColumn("suggested", F.lit(False))
    best_k = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return out.withColumn("suggested", F.col("k") == best_k)
