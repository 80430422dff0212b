"""Generic steps on the reference's 100-row template frame."""

import random

from tablelens.operators import correlation as co
from tablelens.operators import generic as ge


def template_frame(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(100):
        income = 500000.0 if i >= 95 else rnd.gauss(50000, 8000)
        score = None if i >= 98 else rnd.gauss(70, 15)
        rows.append((i + 1, round(rnd.gauss(40, 10), 1), income, "abc"[i % 3], "x", score))
    return spark.createDataFrame(rows, "id long, age double, income double, category string, constant string, score double")


def test_missing_summary_worst(spark):
    s = ge.missing_summary(template_frame(spark)).first()
    assert s["worst_column"] == "score" and s["columns_with_missing"] == 1


def test_constant_and_id(spark):
    flags = {r["column"]: r["flag"] for r in ge.constant_and_id(template_frame(spark)).collect()}
    assert flags["constant"] == "constant" and flags["id"] == "id_like"


def test_outliers_found(spark):
    t = {r["column"]: r for r in ge.outlier_table(template_frame(spark), ["age", "income", "score"]).collect()}
    assert t["income"]["iqr_outliers"] >= 5
    assert t["income"]["whisker_high"] < 500000


def test_histogram_sums_to_rows(spark):
    h = ge.histogram(template_frame(spark), bins=10, cols=["age"]).collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 100


def test_duplicate_preview_small(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "c")], "k long, v string")
    rows = ge.duplicate_preview(df).collect()
    assert [(r["k"], r["v"]) for r in rows] == [(1, "a")] * 3 + [(3, "c")] * 2


def test_cramers_v_perfect_and_yates(spark):
    df = spark.createDataFrame([("a", "x") if i % 2 else ("b", "y") for i in range(40)], "p string, q string")
    st = co.contingency_stats(df, [("p", "q")]).first()
    # 2 x 2 with 20/0/0/20: Yates chi2 = n^3 (|O-E| - .5)^2 / (r1 r2 c1 c2) = 40^3 * 9.5^2 / 20^4
    assert abs(st["chi2"] - 40 ** 3 * 9.5 ** 2 / 20 ** 4) < 1e-9
    assert 0.9 < st["cramers_v"] <= 1.0


def test_vif_two_columns(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(200):
        a = rnd.random()
        rows.append((a, a + rnd.random() * 0.1))
    df = spark.createDataFrame(rows, "a double, b double")
    pairs = co.pearson_pairs(df, ["a", "b"])
    r = [x["r"] for x in pairs.collect() if x["pos_a"] == 0 and x["pos_b"] == 1][0]
    v = co.vif_from_pairs(pairs, ["a", "b"]).collect()
    assert all(abs(x["vif"] - 1 / (1 - r * r)) < 1e-6 for x in v) and all(x["vif"] >= 1 for x in v)


def test_spearman_matches_ranks(spark):
    xs = [1.0, 2.0, 2.0, 5.0, 7.0, 7.0, 7.0, 10.0]
    ys = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    r = [p["r"] for p in co.spearman_pairs(df, ["x", "y"]).collect() if p["pos_a"] == 0 and p["pos_b"] == 1][0]

    def ranks(v):
        s = sorted(v)
        return [s.index(a) + 1 + (s.count(a) - 1) / 2 for a in v]

    rx, ry = ranks(xs), ranks(ys)
    mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
    num = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    den = (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5
    assert abs(r - num / den) < 1e-12
