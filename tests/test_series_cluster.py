"""Time-series and clustering steps."""

import datetime as dt
import math
import random

from tablelens.operators import cluster as cl
from tablelens.operators import series as se


def weekly(spark):
    rnd = random.Random(7)
    start = dt.datetime(2020, 1, 1)
    rows = [(start + dt.timedelta(weeks=t), 50 * t / 103 + 10 * math.sin(2 * math.pi * t / 52) + rnd.gauss(0, 1))
            for t in range(104)]
    return spark.createDataFrame(rows, "date timestamp_ntz, value double")


def test_weekly_frequency_and_period(spark):
    df = weekly(spark)
    assert se.detect_date_column(df, "value").first()["date_column"] == "date"
    s = se.ordered_series(df, "date", "value")
    freq = se.infer_frequency(s).first()["inferred_freq"]
    assert freq == "W-WED"
    assert se.season_length(freq) == 52
    assert se.gap_count(s).first()["gap_count"] == 0


def test_decomposition_and_acf(spark):
    s = se.prepare_regular(se.ordered_series(weekly(spark), "date", "value"), "W-WED", checkpoint=False)
    d = se.decompose(s, 52)
    assert d.count() == 104
    st = se.strengths(d).first()
    assert st["seasonal_strength"] is not None and st["seasonal_strength"] > 0.5
    acf = se.acf(s)
    pacf = {r["lag"]: r["pacf"] for r in se.pacf_from_acf(acf).collect()}
    a = {r["lag"]: r["acf"] for r in acf.collect()}
    assert abs(pacf[2] - (a[2] - a[1] ** 2) / (1 - a[1] ** 2)) < 1e-12
    assert len(a) == 24


def test_gaps_and_interpolation(spark):
    start = dt.datetime(2021, 3, 1)
    days = [0, 1, 2, 5, 6, 7, 8, 9]
    rows = [(start + dt.timedelta(days=d), float(d * 2)) for d in days]
    s = spark.createDataFrame(rows, "ts timestamp_ntz, y double")
    assert se.infer_frequency(s).first()["inferred_freq"] is None
    assert se.gap_count(s).first()["gap_count"] == 1
    g = se.interpolate(se.regular_grid(s, "D"))
    vals = {r["pos"]: r["y"] for r in g.collect()}
    assert vals[3] == 6.0 and vals[4] == 8.0


def test_monthly_start_frequency(spark):
    rows = [(dt.datetime(2015 + m // 12, m % 12 + 1, 1), float(m)) for m in range(30)]
    s = spark.createDataFrame(rows, "ts timestamp_ntz, y double")
    assert se.infer_frequency(s).first()["inferred_freq"] == "MS"


def two_blobs(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.gauss(0 if i < 75 else 10, 0.5), rnd.gauss(0 if i < 75 else 10, 0.5)) for i in range(150)]
    return spark.createDataFrame(rows, "id long, f1 double, f2 double")


def test_hopkins_and_k(spark):
    df = two_blobs(spark)
    h = cl.hopkins(df, ["f1", "f2"], key="id").first()["hopkins_statistic"]
    assert h > 0.75
    # fewer restarts and a smaller k range than the defaults, to keep the unit test short
    scan = cl.kmeans_scan(df, ["f1", "f2"], max_k=4, n_init=2).collect()
    assert [r["k"] for r in scan if r["suggested"]] == [2]


def test_pca_two_columns(spark):
    df = two_blobs(spark)
    p = cl.pca_variance(df, ["f1", "f2"]).collect()
    assert abs(sum(r["variance_ratio"] for r in p) - 1.0) < 1e-9
    assert p[0]["n_components_for_95pct"] == 1
