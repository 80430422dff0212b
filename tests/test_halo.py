"""Window steps over blocks with border rows equal plain pandas; irregular series go by place."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import series as se
from tablelens.plans import analyze as an


def positioned(spark, y):
    return spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)], "pos long, y double").repartition(5)


@pytest.mark.parametrize("period", [3, 4, 7, 12])
@pytest.mark.parametrize("block", [None, 16])
def test_windows_equal_pandas(spark, period, block):
    y = np.random.default_rng(period).standard_normal(100).cumsum()
    s, p = positioned(spark, y), pd.Series(y)
    got = se.moving_average(s, period, block).orderBy("pos").toPandas()
    want = p.rolling(period, center=True).mean() if period % 2 else p.rolling(period).mean().rolling(2).mean().shift(-period // 2)
    assert list(got.pos) == list(range(100)) and np.allclose(got.ma, want, equal_nan=True)
    lags = se.lag_rolling(s, period, block).orderBy("pos").toPandas()
    assert list(lags.columns) == ["pos", "y", "lag_1", f"lag_{period}", "roll_mean", "roll_std"]
    for c, w in (("lag_1", p.shift(1)), (f"lag_{period}", p.shift(period)), ("roll_mean", p.rolling(period).mean()), ("roll_std", p.rolling(period).std())):
        assert np.allclose(lags[c], w, equal_nan=True), c
    a = se.acf(s, block=block).orderBy("lag").toPandas()
    d = y - y.mean()
    assert list(a.lag) == list(range(1, 25)) and np.allclose(a.acf, [(d[:-k] * d[k:]).sum() / (d * d).sum() for k in range(1, 25)])


def test_missing_positions_leave_nulls(spark):
    s = positioned(spark, np.arange(20.0)).where("pos <> 9")
    got = se.lag_rolling(s, 3, 4).orderBy("pos").toPandas().set_index("pos")
    assert np.isnan(got.lag_1[10]) and np.isnan(got.roll_mean[11]) and got.roll_mean[12] == 11.0 and got.lag_3[13] == 10.0


def test_plan_copies_border_rows_only(spark):
    s = positioned(spark, np.arange(5000.0))
    rows, _ = se.with_halo(s, 12, 12, 1000)
    assert rows.count() == 5000 + 4 * 24 + 24 and rows.where("__own").count() == 5000
    assert se.acf(s.limit(9)).count() == 0 and se.acf(positioned(spark, np.ones(30))).count() == 0


def test_irregular_series_has_an_acf(spark):
    r = np.random.default_rng(6)
    n = 300
    steps = r.integers(1, 90, n).cumsum()
    y = np.sin(np.arange(n) / 3) + 0.1 * r.standard_normal(n)
    y[[0, 17, 18, 299]] = np.nan
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)), float(v)) for m, v in zip(steps, y)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double").repartition(6)
    s = se.ordered_series(df, "ts", "y")
    assert se.infer_frequency(s).first()["inferred_freq"] is None
    filled = pd.Series(y).interpolate().dropna()
    got = se.prepare_irregular(s).orderBy("pos").toPandas()
    assert list(got.pos) == list(range(len(filled))) and np.allclose(got.y, filled)
    a = se.acf(se.prepare_irregular(s)).orderBy("lag").toPandas()
    d = filled.to_numpy() - filled.mean()
    assert np.allclose(a.acf, [(d[:-k] * d[k:]).sum() / (d * d).sum() for k in range(1, 25)])
    texts = [t["text"] for t in an.run_step("time_series_analysis", df, None, "y").collect()]
    assert any("Autocorrelation" in t for t in texts)


def test_median_gap_with_repeated_times(spark):
    minutes = [0, 0, 0, 1, 2, 3, 13, 14, 14, 60]
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), 1.0) for m in minutes], "ts timestamp_ntz, y double")
    gaps = np.diff(minutes) * 6e7
    got = se.gap_count(df).first()
    assert got.median_gap_us == np.median(gaps) and got.gap_count == (gaps > 1.5 * np.median(gaps)).sum()
    assert tuple(se.gap_count(df.limit(1)).first()) == (None, 0)
