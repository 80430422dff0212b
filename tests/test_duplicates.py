"""Repeated rows by digest equal grouping by value, also where digests collide."""

import pytest
from pyspark.sql import functions as F

from tablelens.functions import duplicates as du
from tablelens.operators import generic as ge
from tablelens.operators import profile as pr


@pytest.fixture
def table(spark):
    rows = [(i % 7, None if i % 5 == 0 else "ab"[i % 2], [0.0, -0.0, float("nan")][i % 3], [i % 2], {"k": i % 2}) for i in range(300)]
    rows += [(1000 + i, "x" * i, 1.0, [i], {"k": i}) for i in range(40)] + [(None, None, None, None, None)] * 3
    return spark.createDataFrame(rows, "a long, b string, c double, d array<int>, e map<string,int>").repartition(4)


def plain(df):
    """(rows, repeated rows, sizes of the groups) by value."""
    groups = df.select("a", "b", "c", "d", F.to_json("e").alias("e")).groupBy("a", "b", "c", "d", "e").count().collect()
    return sum(r["count"] for r in groups), sum(r["count"] - 1 for r in groups), sorted(r["count"] for r in groups if r["count"] > 1)


@pytest.mark.parametrize("limit", [500_000, 2])
def test_equal_to_grouping(table, monkeypatch, limit):
    monkeypatch.setattr(du, "BROADCAST_DIGESTS", limit)
    n, more, sizes = plain(table)
    got = pr.duplicates(table).first()
    assert (got.n_rows, got.duplicate_rows) == (n, more) and got.duplicate_pct == round(100 * more / n, 2)
    assert sorted(r["__n"] for r in du.repeated_rows(table).collect()) == sizes


def test_exact_under_forced_collisions(table, monkeypatch):
    want = pr.duplicates(table).first()
    monkeypatch.setattr(du, "digest", lambda df: (F.lit(1).cast("long"), F.coalesce(F.col("a") % 2, F.lit(5)).cast("long")))
    assert pr.duplicates(table).first() == want and sorted(r["__n"] for r in du.repeated_rows(table).collect()) == plain(table)[2]


def test_first_shuffle_holds_no_values(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(du, "written", lambda df: seen.append(df) or df)
    wide = spark.range(500).select(F.repeat(F.lit("long text "), 50).alias("t"), "id")
    assert du.repeated_rows(wide).count() == 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(__d1" in plan and seen[0].columns == ["__d1", "__d2"]


def test_preview_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (3, "z")], "a int, b string")
    assert [tuple(r) for r in ge.duplicate_preview(df, 3).collect()] == [(1, "x"), (1, "x"), (2, None)]
    assert pr.duplicates(df.limit(0)).first().n_rows == 0
