"""Loaders, sampling, plan and severity."""

import json

import pytest

from tablelens.plans import analyze as an
from tablelens.plans import findings as fi
from tablelens.sources import load as ld


ROWS = [(1, "ann", 1.5), (2, "bob", None), (3, "cy", 3.0), (4, "dee", 4.5), (5, "eve", 5.0)]


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_file_types():
    assert ld.file_type("A.CSV") == "csv" and ld.file_type("x.ndjson") == "json_lines"
    with pytest.raises(ld.LoadError):
        ld.file_type("data.txt")


def test_csv_variants(spark, tmp_path):
    body = "id,name,score\n" + "\n".join(f"{i},{n},{'' if s is None else s}" for i, n, s in ROWS) + "\n"
    info = ld.load_dataset(spark, _write(tmp_path / "a.csv", body))
    assert info.total_rows == 5 and info.df.columns == ["id", "name", "score"]
    semi = _write(tmp_path / "b.csv", body.replace(",", ";"))
    assert ld.sniff_delimiter(spark, semi) == ";"
    assert ld.load_dataset(spark, semi).total_rows == 5
    tsv = _write(tmp_path / "c.tsv", body.replace(",", "\t"))
    assert ld.load_dataset(spark, tsv).df.columns == ["id", "name", "score"]
    bad = _write(tmp_path / "d.csv", body + "6,fay,6.0,extra\n7,gus\n")
    df = ld.load_dataset(spark, bad).df
    assert df.count() == 6 and df.where("id = 7").first()["score"] is None


def test_json_variants(spark, tmp_path):
    recs = [{"id": i, "name": n, "score": s} for i, n, s in ROWS]
    arr = _write(tmp_path / "a.json", json.dumps(recs, indent=1))
    assert ld.load_dataset(spark, arr).total_rows == 5
    lines = "\n".join(json.dumps(r) for r in recs)
    assert ld.load_dataset(spark, _write(tmp_path / "b.jsonl", lines)).total_rows == 5
    assert ld.load_dataset(spark, _write(tmp_path / "c.json", lines)).total_rows == 5
    with pytest.raises(ld.LoadError):
        ld.load_dataset(spark, _write(tmp_path / "d.json", "this is not json {"))


def test_parquet_and_sampling(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(50).selectExpr("id", "id * 2 AS value").write.parquet(path)
    info = ld.load_dataset(spark, path, sample_threshold=10, sample_size=5)
    assert info.is_sampled and info.total_rows == 50 and info.df.count() == 5


def test_empty_rejected(spark, tmp_path):
    with pytest.raises(ld.LoadError):
        ld.load_dataset(spark, _write(tmp_path / "e.csv", ""))


def test_preview_page(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    page = [r["k"] for r in ld.preview(df, ["k"], offset=495, limit=10).collect()]
    assert page == [495, 496, 497, 498, 499]


def test_plan_order_and_edit():
    assert an.build_plan("regression")[-2:] == ["regression_target_analysis", "leakage_checks"]
    assert an.build_plan(None)[-1] == "clustering_analysis"
    assert len(an.build_plan("binary_classification")) == 10
    with pytest.raises(ValueError):
        an.edit_plan([])
    with pytest.raises(ValueError):
        an.edit_plan(["overview", "nope"])


def test_severity_buckets(spark):
    rows = [(0, 0, None, 0.0), (1, 5, "a", 15.0), (1, 9, "b", 49.9), (2, 20, "c", 50.0)]
    df = spark.createDataFrame(rows, "columns_with_missing long, total_missing_cells long, worst_column string, worst_pct double")
    sev = [r["severity"] for r in fi.missing_findings(df).where("bullet = 0").collect()]
    assert sev == ["info", "warning", "warning", "critical"]
    texts = [r["text"] for r in fi.missing_findings(df.limit(1)).collect()]
    assert texts == ["Every column is complete."]


def test_sniff_pipe_and_tab_and_type_expr(spark, tmp_path):
    from pyspark.sql import functions as F
    body = "a|b|c\n1|2|3\n4|5|6\n"
    assert ld.sniff_delimiter(spark, _write(tmp_path / "p.csv", body)) == "|"
    assert ld.sniff_delimiter(spark, _write(tmp_path / "t.csv", body.replace("|", "\t"))) == "\t"
    names = spark.createDataFrame([("x.PARQUET",), ("y.ndjson",), ("z.txt",)], "name string")
    got = [r[0] for r in names.select(ld.file_type_expr(F.col("name"))).collect()]
    assert got == ["parquet", "json_lines", None]


def test_sinks_roundtrip(spark, tmp_path):
    from tablelens.sources import sinks
    prof = spark.createDataFrame([("a", 0, 1.0)], "column string, position int, missing_pct double")
    sinks.store_profile(prof, str(tmp_path / "prof"), "t1")
    sinks.store_profile(prof, str(tmp_path / "prof"), "t2")
    sinks.store_profile(prof, str(tmp_path / "prof"), "t1")  # overwrite only t1
    assert spark.read.parquet(str(tmp_path / "prof")).count() == 2
    f = fi.simple_findings("overview", ["one", "two"])
    sinks.append_findings(f, str(tmp_path / "fnd"), "r1")
    sinks.append_findings(f, str(tmp_path / "fnd"), "r2")
    assert spark.read.parquet(str(tmp_path / "fnd")).count() == 4
