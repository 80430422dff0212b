"""Target-aware steps on the reference's planted-signal frames."""

import random

from pyspark.sql import functions as F

from tablelens.functions.dist import chi2_sf, f_sf
from tablelens.operators import correlation as co
from tablelens.operators import target as tg


def test_pvalue_functions():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(f_sf(4.964602743730711, 1, 10) - 0.05) < 1e-9


def test_imbalance(spark):
    df = spark.createDataFrame([(float(i), 0 if i < 180 else 1) for i in range(200)], "age double, target int")
    r = tg.imbalance(df, "target").first()
    assert r["imbalance_ratio"] == 9.0 and r["severity"] == "moderate" and r["minority_class"] == "1"


def test_anova_detects_signal(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        t = i % 2
        rows.append((5 * t + rnd.gauss(0, 1), rnd.gauss(0, 1), t))
    df = spark.createDataFrame(rows, "signal double, noise double, target int")
    a = {r["column"]: r for r in tg.anova(df, "target").collect()}
    assert a["signal"]["p_value"] < 0.05 and a["signal"]["f_stat"] > a["noise"]["f_stat"]


def test_skewed_target_transform(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(300):
        x1 = rnd.gauss(50, 10)
        rows.append((x1, rnd.gauss(0, 1), 5 * x1 + rnd.expovariate(1 / 200)))
    df = spark.createDataFrame(rows, "x1 double, noise double, target double")
    t = tg.target_transform(df, "target").first()
    assert t["skew"] > 1 and t["suggested_transform"] == "log"
    top = [r["column"] for r in tg.top_correlated(df, "target").collect()]
    assert "x1" in top
    bp = tg.breusch_pagan(df, "target", ["x1"]).first()
    assert bp["lm"] >= 0 and 0 <= bp["p_value"] <= 1


def test_leakage(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(200):
        t = rnd.randint(0, 1)
        rows.append((t, rnd.random(), rnd.random(), t))
    df = spark.createDataFrame(rows, "leak_copy int, status_final double, unrelated double, target int")
    near = [r["column"] for r in tg.near_duplicates(df, "target").collect()]
    assert "leak_copy" in near
    names = [r["column"] for r in tg.suspicious_names(df, "target").collect()]
    assert "status_final" in names


def test_mutual_information_ranks_signal(spark):
    rnd = random.Random(6)
    rows = [(float(i % 2) * 3 + rnd.gauss(0, 1), rnd.gauss(0, 1), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "signal double, noise double, target int")
    mi = {r["column"]: r["mutual_info"] for r in tg.binned_mi(df, "target", ["signal", "noise"]).collect()}
    assert mi["signal"] > mi["noise"]


def test_class_balance_null_is_a_class(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (0,)], "y int")
    cb = {r["class"]: r["count"] for r in tg.class_balance(df, "y").collect()}
    assert cb == {"1": 2, None: 1, "0": 1}
    assert df.where(F.col("y").isNull()).count() == 1


def test_two_by_two_margins_beyond_long(spark):
    """The product of the four margins of 200,000 rows is above 2^63."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("x"),
                                     F.when(F.col("id") % 5 < 2, 1).otherwise(0).alias("y"))
    cell = co.contingency_stats(df, [("x", "y")]).first()
    # every cell equals its expectation, so Yates' correction leaves zero
    assert (cell["n"], cell["r"], cell["k"], cell["chi2"], cell["cramers_v"]) == (200_000, 2, 2, 0.0, 0.0)
    odd = df.withColumn("y", F.when((F.col("x") == "a") & (F.col("y") == 1), 0).otherwise(F.col("y")))
    t = co.chi_square_tests(odd, "y", ["x"]).first()
    a, b, c, d = 0, 100_000, 40_000, 60_000
    want = 200_000 * (abs(a * d - b * c) - 100_000) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert abs(t["chi2"] / want - 1) < 1e-12 and t["dof"] == 1
