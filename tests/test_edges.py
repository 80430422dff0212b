"""Edge frames: empty, one row, all null, constant, two dates."""

import datetime as dt

from tablelens.operators import generic as ge
from tablelens.operators import profile as pr
from tablelens.operators import series as se


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert pr.missing(df).where("column = 'a'").first()["missing_pct"] == 0.0
    assert pr.duplicates(df).first()["duplicate_rows"] == 0
    assert pr.numeric_stats(df).first()["mean"] is None
    assert pr.distinct_counts(df).count() == 0


def test_one_row_and_all_null(spark):
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    s = pr.numeric_stats(one).first()
    assert s["n"] == 1 and s["std"] is None and s["skew"] is None and s["q50"] == 1.0
    nulls = spark.createDataFrame([(None, None)] * 5, "a double, b string")
    m = {r["column"]: r["missing_pct"] for r in pr.missing(nulls).collect()}
    assert m == {"a": 100.0, "b": 100.0}
    assert {r["column"] for r in pr.constant_columns(nulls).collect()} == {"a", "b"}
    assert ge.outlier_table(nulls, ["a"]).count() == 0


def test_two_dates_is_irregular(spark):
    s = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0), (dt.datetime(2020, 1, 2), 2.0)],
                              "ts timestamp_ntz, y double")
    assert se.infer_frequency(s).first()["inferred_freq"] is None
    assert se.range_points(s).first()["n_points"] == 2


def test_nested_columns_profile(spark):
    rows = [({"k": 1}, [1, 2], "a"), ({"k": 1}, [1, 2], "a"), ({"k": 2}, [3], "b")]
    df = spark.createDataFrame(rows, "m map<string,int>, arr array<int>, s string")
    d = {r["column"]: r["unique_count"] for r in pr.distinct_counts(df).collect()}
    assert d == {"m": 2, "arr": 2, "s": 2}
    assert pr.duplicates(df).first()["duplicate_rows"] == 1
    prof = pr.semantic_types(pr.column_profile(df))
    assert prof.count() == 3


def test_number_formatting_matches_python(spark):
    from pyspark.sql import functions as F
    from tablelens.plans import findings as fi
    vals = [12.25, 0.125, 3.0, 99.95, 1234567.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(fi.f1(F.col("x"))).collect()]
    assert got == [f"{v:.1f}" for v in vals]
    got = [r[0] for r in df.select(fi.thousands(F.col("x"))).collect()]
    assert got == [f"{int(v):,}" for v in vals]


def test_pca_95_not_reached_is_null(spark):
    """With 12 independent columns, 10 components cannot reach 95 %: the count is null."""
    import random
    from tablelens.operators import cluster as cl
    rnd = random.Random(30)
    cols = [f"c{i}" for i in range(12)]
    rows = [tuple(rnd.gauss(0, 1) for _ in cols) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    p = cl.pca_variance(df, cols).collect()
    assert len(p) == 10 and p[0]["n_components_for_95pct"] is None
    assert p[-1]["cumulative"] < 0.95
