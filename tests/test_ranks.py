"""Order statistics of many columns in few passes equal sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions import moments as mo
from tablelens.functions import ranks


def test_keys_keep_the_order():
    v = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, np.inf])
    k = ranks.to_key(v)
    assert (np.diff(k) >= 0).all() and k[4] == k[5] and len(set(k.tolist())) == 10
    assert [ranks.from_key(x) for x in k] == v.tolist()


@pytest.mark.parametrize("max_bracket,rounds", [(200_000, 1), (40, 12)])
def test_order_statistics_equal_sorting(spark, max_bracket, rounds):
    r = np.random.default_rng(9)
    n = 6000
    cols = {"gauss": r.standard_normal(n), "skewed": np.exp(6 * r.standard_normal(n)), "hot": np.where(r.random(n) < 0.6, 3.0, r.random(n)),
            "two": (r.random(n) < 0.5).astype(float), "few": r.integers(0, 5, n) * 1.5, "wild": r.choice([-np.inf, np.inf, 1e-300, -1e300, 0.0, -0.0], n)}
    x = np.column_stack(list(cols.values()))
    x[r.random(x.shape) < 0.05] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in row) for i, row in enumerate(x)], ", ".join(f"{c} double" for c in cols))
    ask = [0, 1, 17, 1500, 2800, 3000, 5000, 5500]
    got = ranks.order_statistics(df.repartition(6), {c: F.col(c) for c in cols}, lambda m: [*ask, m - 1], max_bracket, rounds + 1)
    for j, c in enumerate(cols):
        v = np.sort(x[:, j][~np.isnan(x[:, j])])
        assert got[c][0] == len(v)
        assert got[c][1] == {k: (v[k], int((v < v[k]).sum())) for k in [*ask, len(v) - 1]}


def test_passes_do_not_grow_with_the_columns(spark, monkeypatch):
    df = spark.range(4000).select(*[F.rand(i).alias(f"v{i}") for i in range(30)])
    seen, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: seen.append(f.__name__) or plain(self, f, *a, **k))
    got = mo.exact_quantiles(df, df.columns)
    assert seen == ["_points", "inside_values"] and all(abs(a - b) < 0.05 for q in got.values() for a, b in zip(q, (0.25, 0.5, 0.75)))
    seen.clear()
    mo.exact_quantiles(df, df.columns, max_bracket=50)
    assert len(seen) <= 4


def test_sorted_input_and_single_values(spark):
    df = spark.range(50_000).select(F.col("id").cast("double").alias("a"), F.lit(2.5).alias("b"), F.lit(None).cast("double").alias("c"))
    got = mo.exact_quantiles(df, ["a", "b", "c"], (0.0, 0.3333, 1.0))
    assert got == {"a": [0.0, pytest.approx(49_999 * 0.3333), 49_999.0], "b": [2.5] * 3, "c": [None] * 3}
    assert mo.exact_quantiles(df.limit(0), ["a"]) == {"a": [None] * 3}


def test_equal_neighbours_are_not_rounded(spark):
    df = spark.createDataFrame([(0.05,)] * 8 + [(0.1,)] * 3, "a double")
    assert mo.exact_quantiles(df, ["a"], (0.3, 0.55)) == {"a": [0.05, 0.05]}


def test_moments_of_one_scan_equal_pandas(spark):
    import pandas as pd
    from tablelens.functions.scan_moments import column_statistics
    r = np.random.default_rng(7)
    p = pd.DataFrame({"a": r.standard_normal(5000) + 1e8, "b": np.exp(r.standard_normal(5000)), "c": 2.5, "d": np.nan, "e": [1.0, 2.0] + [np.nan] * 4998})
    p.loc[::9, "a"] = np.nan
    got = dict(zip(p.columns, column_statistics(spark.createDataFrame(p).repartition(7), list(p.columns))))
    for c in "abe":
        for k, want in (("n", p[c].count()), ("mean", p[c].mean()), ("std", p[c].std()), ("std_pop", p[c].std(ddof=0)), ("min", p[c].min()), ("max", p[c].max())):
            assert got[c][k] == pytest.approx(want, rel=1e-9), (c, k)
    for c in "ab":
        assert got[c]["skew"] == pytest.approx(p[c].skew(), abs=1e-6) and got[c]["kurtosis"] == pytest.approx(p[c].kurt(), abs=1e-5)
    assert (got["c"]["std"], got["c"]["skew"], got["c"]["kurtosis"], got["c"]["min"]) == (0.0, 0.0, 0.0, 2.5)
    assert got["d"] == {"n": 0, **dict.fromkeys(("mean", "std", "std_pop", "min", "max", "skew", "kurtosis"))} and got["e"]["skew"] is None
