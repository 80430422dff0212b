"""Nothing is lost or switched by size: hot values, nulls, NaN, wide decimals, text labels."""

import os
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablelens.functions import freq as fq
from tablelens.functions import moments as mo
from tablelens.functions.sampling import _flag_first_k, flag_lowest_k, md5_key
from tablelens.operators import features as fe
from tablelens.operators import model as md
from tablelens.operators import target as tg

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def test_quantiles_of_hot_values_equal_percentile(spark):
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.rand(3)).alias("hot"),
        (F.col("id") % 3).cast("double").alias("few"),
        F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 1000).alias("nan"),
        F.lit(None).cast("double").alias("none")).persist()
    got = mo.exact_quantiles(df, df.columns, PROBS, max_bracket=500)
    ref = df.withColumn("nan", F.nanvl("nan", F.lit(None))).agg(*[F.percentile(c, list(PROBS)).alias(c) for c in df.columns]).first()
    for c in ("hot", "few", "nan"):
        assert got[c] == pytest.approx(list(ref[c]))
    assert got["none"] == [None] * len(PROBS)
    with pytest.raises(RuntimeError):
        mo.exact_quantiles(df, ["hot"], (0.2,), max_bracket=1, max_rounds=1)
    df.unpersist()


def test_splits_keep_every_row(spark):
    rows = [(None if i % 10 == 0 else i, None if i % 7 == 0 else "ab"[i % 2], None if i % 3 == 0 else i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, c string, t long")
    for train, test in (fe.random_split(df, "k"), fe.stratified_split(df, "c", "k"), fe.time_split(df, "t", tiebreak=["k"])):
        assert train.count() + test.count() == 1000
        assert test.count() == pytest.approx(200, abs=2)
    train, test = fe.time_split(df, "t", tiebreak=["k"])
    assert train.where("t IS NULL").count() == 800 - df.where("t IS NOT NULL").count()   # nulls come last
    kept = fe.undersample(df, "c", "k").groupBy("c").count().collect()
    assert len(kept) == 3 and len({r["count"] for r in kept}) == 1


def test_equal_keys_are_cut_at_the_right_count(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), F.lit("g").alias("g"))
    flagged = flag_lowest_k(df, md5_key(1, F.col("k")), lambda n: F.round(n * 0.3), ["g"])
    assert flagged.count() == 1000 and flagged.where("__sel").count() == 300


def test_a_hot_date_is_split_by_its_tiebreak(spark):
    df = spark.range(2000).select("id", F.lit(7).alias("t"))
    first = _flag_first_k(df, F.col("t"), 1234, ["id"], 10_000).where("__sel")
    assert {r["id"] for r in first.collect()} == set(range(1234))


def test_perfect_separator_is_the_strongest_feature(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2), float(i)) for i in range(40)], "y int, same double, other double")
    rows = {r["column"]: r for r in tg.anova(df, "y", ["same", "other"]).collect()}
    assert rows["same"]["f_stat"] == float("inf") and rows["same"]["p_value"] == 0
    assert tg.top_anova_features(tg.anova(df, "y", ["same", "other"]), 1).first()["column"] == "same"


def test_nan_is_missing_and_decimals_stay_apart(spark):
    df = spark.createDataFrame([(float("nan"), Decimal("12345678901234567890123456789012345678")),
                                (1.0, Decimal("12345678901234567890123456789012345679"))], "x double, d decimal(38,0)")
    assert {r["column"]: r["missing_count"] for r in mo.null_counts(df).collect()} == {"x": 1, "d": 0}
    found = {r["column"]: r["unique_count"] for r in fq.distinct_summary(fq.frequency_table(df)).collect()}
    assert found == {"x": 1, "d": 2}


def test_text_labels_in_the_baseline(spark):
    rows = [(i, float(i % 3) + i / 1000, ("red", "green", "blue")[i % 3]) for i in range(90)]
    res = md.baseline(spark.createDataFrame(rows, "id long, x double, y string"), "y", "multiclass_classification", "id", n_trees=5)
    assert res.metrics.first()["accuracy"] == 1.0
    assert {r["predicted_class"] for r in res.predictions.collect()} <= {"red", "green", "blue"}
    two = spark.createDataFrame([(i, x, "yes" if y == "red" else "no") for i, x, y in rows], "id long, x double, y string")
    m = md.baseline(two, "y", "binary_classification", "id", n_trees=5, positive="yes").metrics.first()
    assert m["precision"] == 1.0 and m["roc_auc"] == 1.0
    assert md.positive_class(["0", "1"]) == "1" and md.positive_class(["a", "b"]) == "b"


def test_a_given_checkpoint_folder_and_master_stay(tmp_path):
    code = ("from tablelens.session import get_session, checkpoint_dir\n"
            "s = get_session()\nprint('OUT', s.sparkContext.master, checkpoint_dir(s))\n")
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "TABLELENS_DRIVER_MEM": "1g",
           "PYSPARK_SUBMIT_ARGS": f"--master local[1] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path} pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=str(tmp_path), capture_output=True, text=True, timeout=120).stdout
    assert "OUT local[1] " in out and str(tmp_path) in out.split("OUT")[1]
