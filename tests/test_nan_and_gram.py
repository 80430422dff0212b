"""NaN counts as missing in every family of operators; the Gramian equals corr."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions import gram as gm
from tablelens.functions.columns import nan_to_null
from tablelens.operators import cluster, correlation, features, generic, model, profile, series, target
from tablelens.plans import analyze as an

NAN = float("nan")


@pytest.fixture(scope="module")
def noisy(spark):
    """200 rows of noise; every tenth x and one y is NaN, the same cells are null in the twin frame."""
    r = np.random.default_rng(3)
    rows = [(i, NAN if i % 10 == 0 else float(a), NAN if i == 7 else float(b), float(c), "pq"[i % 2])
            for i, (a, b, c) in enumerate(r.standard_normal((200, 3)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, k string").repartition(3).cache()
    return df, nan_to_null(df)


def same(a, b, *order):
    assert a.orderBy(*order).toPandas().to_csv(float_format="%.9g") == b.orderBy(*order).toPandas().to_csv(float_format="%.9g")


def test_correlations_and_leakage(noisy):
    df, twin = noisy
    got = {r["column"]: r["r"] for r in target.target_correlations(df, "y").collect()}
    p = twin.toPandas()
    assert got["x"] == pytest.approx(p.x.corr(p.y), abs=1e-4) and abs(got["x"]) < 0.3
    assert target.high_correlation(df, "y").count() == 0 and target.near_duplicates(df, "y").count() == 0
    same(target.top_correlated(df, "y"), target.top_correlated(twin, "y"), "rank")
    same(correlation.spearman_pairs(df, ["x", "y", "z"]), correlation.spearman_pairs(twin, ["x", "y", "z"]), "pos_a", "pos_b")
    assert all(r["severity"] != "critical" for r in an.run_step("leakage_checks", df, None, "y").collect())


def test_outliers_histogram_patterns(noisy):
    df, twin = noisy
    same(generic.outlier_table(df, ["x", "y"]), generic.outlier_table(twin, ["x", "y"]), "position")
    row = {r["column"]: r for r in generic.outlier_table(df, ["x", "y"]).collect()}
    assert row["x"].n == 180 and row["y"].n == 199 and np.isfinite(row["x"].mean) and np.isfinite(row["x"].std_pop)
    same(generic.histogram(df, 5, ["x"]), generic.histogram(twin, 5, ["x"]), "bin")
    assert sum(r["count"] for r in generic.histogram(df, 5, ["x"]).collect()) == 180
    assert {r.pattern: r.n for r in generic.missing_patterns(df).collect()} == {"00000": 179, "01000": 20, "00100": 1}


def test_target_steps(noisy):
    df, twin = noisy
    same(target.anova(df, "k", ["x", "y"]), target.anova(twin, "k", ["x", "y"]), "column")
    assert all(np.isfinite(r.f_stat) and r.p_value is not None for r in target.anova(df, "k", ["x", "y"]).collect())
    same(target.target_transform(df, "x"), target.target_transform(twin, "x"), "target")
    same(target.binned_mi(df, "k", ["x", "y"]), target.binned_mi(twin, "k", ["x", "y"]), "column")
    same(target.binned_mi(df, "y", ["x"], bin_target=True), target.binned_mi(twin, "y", ["x"], bin_target=True), "column")
    same(target.scatter_bins(df, "y", ["x"]), target.scatter_bins(twin, "y", ["x"]), "bin_x", "bin_y")
    same(target.class_balance(df.select("x"), "x").where("class is null"), target.class_balance(twin.select("x"), "x").where("class is null"), "class")


def test_scale_and_series(noisy):
    df, twin = noisy
    same(cluster.scale_report(df, ["x", "y"]), cluster.scale_report(twin, ["x", "y"]), "position")
    assert not cluster.scale_report(df, ["x", "y"]).first().scales_differ
    dated = [f.withColumn("d", F.expr("date_add(date'2024-01-01', cast(id as int))")) for f in (df, twin)]
    same(*[series.ordered_series(f, "d", "x") for f in dated], "ts")


def test_imputation_and_model_metrics(noisy):
    df, twin = noisy
    for strategy in ("mean", "median", "most_frequent"):
        fills = [features.fit_fill_values(f, ["x", "y"], ["k"], strategy) for f in (df, twin)]
        assert fills[0] == fills[1] and fills[0]["x"] is not None and fills[0]["k"] == "p"
        assert features.fit_scaling(df, ["x"], fills[0]) == features.fit_scaling(twin, ["x"], fills[0])
    same(model.regression_metrics(df.withColumn("p", F.col("z")), "y", "p"), model.regression_metrics(twin.withColumn("p", F.col("z")), "y", "p"),
         *model.regression_metrics(twin.withColumn("p", F.col("z")), "y", "p").columns)


def test_profile_has_no_nan(noisy):
    df, twin = noisy
    same(profile.column_profile(df).select("column", "missing_count"), profile.column_profile(twin).select("column", "missing_count"), "column")


def test_gram_equals_corr_far_from_zero(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 4)) * [1, 1e-3, 10, 1] + [1e9, 1e6, 0, -1e8]
    x[:, 3] += 0.5 * x[:, 0]
    x[r.random(x.shape) < 0.1] = NAN
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in x], "a double, b double, c double, d double").repartition(7)
    g = gm.gram(df, list("abcd"))
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            assert g.n[i, j] == both.sum() and g.ma[i, j] == pytest.approx(u.mean(), rel=1e-12)
            assert g.correlation()[i, j] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-7)
            assert g.qa[i, j] == pytest.approx(((u - u.mean()) ** 2).sum(), rel=1e-6)
    whole = gm.gram(df, list("abcd"), complete_rows=True)
    full = x[~np.isnan(x).any(1)]
    assert (whole.n == len(full)).all() and np.allclose(whole.correlation(), np.corrcoef(full.T), atol=1e-9)


def test_gram_of_constant_infinite_and_empty(spark):
    df = spark.createDataFrame([(1e9 + 0.1, 1.0, float("inf"), None), (1e9 + 0.1, 2.0, 1.0, None), (1e9 + 0.1, 4.0, 2.0, None)] * 5,
                               "a double, b double, c double, d double").repartition(4)
    r = gm.gram(df, list("abcd")).correlation()
    assert np.isnan(r[0]).all() and r[1, 1] == 1.0 and np.isnan(r[1, 2]) and np.isnan(r[3]).all()
    pairs = {(p.col_a, p.col_b): p for p in correlation.pearson_pairs(df, list("ab"), complete_rows=False).collect()}
    assert pairs["a", "b"].r is None and pairs["b", "b"].r == 1.0 and pairs["a", "b"].n == 15
    assert correlation.pearson_pairs(df.limit(0), ["a", "b"]).where("r is not null").count() == 0


def test_hundred_columns_take_one_scan(spark):
    df = spark.range(2000).select(*[F.rand(i).alias(f"v{i}") for i in range(100)])
    g = gm.gram(df, df.columns)
    assert g.n.shape == (100, 100) and (g.n == 2000).all() and np.abs(g.correlation() - np.eye(100)).max() < 0.12
