"""Feature engineering and the baseline model."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tablelens.operators import features as fe
from tablelens.operators import model as mo


def feature_frame(spark):
    rnd = random.Random(9)
    rows = [(i, "x", round(rnd.gauss(40, 10), 1), "abc"[i % 3], i % 2) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, always_x string, age double, city string, target int")


def test_feature_engineering_end_to_end(spark, tmp_path):
    df = feature_frame(spark)
    res = fe.feature_engineering(df, "target", "binary_classification", "row_id")
    s = res.summary.first()
    assert "always_x" in s["dropped_constant"] and "row_id" in s["dropped_id_like"]
    assert s["split_strategy"] == "stratified" and s["train_rows"] + s["test_rows"] == 200
    assert res.train.join(res.test, "row_id").count() == 0
    assert s["n_features_out"] == 1 + 3
    path = str(tmp_path / "pipe")
    res.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    unseen = spark.createDataFrame([(999, "x", None, "zzz", 1)], df.schema)
    vec = loaded.transform(unseen).first()["features"].toArray().tolist()
    assert len(vec) == 4 and vec[1:] == [0.0, 0.0, 0.0]


def test_high_cardinality_excluded_and_no_split(spark):
    rnd = random.Random(10)
    rows = [(rnd.gauss(40, 5), f"lvl{i % 30}") for i in range(50)]
    df = spark.createDataFrame(rows, "age double, high_card string")
    res = fe.feature_engineering(df, None, None, "age")
    s = res.summary.first()
    assert s["excluded_high_cardinality"] == ["high_card"] and s["split_strategy"] == "none"


def test_override_validation():
    with pytest.raises(ValueError):
        fe.FeatureSettings.from_overrides({"bogus": 1})
    assert fe.FeatureSettings.from_overrides({"test_size": 0.3}).test_size == 0.3


def test_splits_exact_and_disjoint(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    train, test = fe.stratified_split(df, "y", "id", 0.2)
    assert test.count() == 200 and train.count() == 800
    assert test.where("y = 1").count() == 50
    t2 = fe.random_split(df, "id", 0.25)[1]
    assert t2.count() == 250
    tr, te = fe.time_split(df, "id", 0.2, tiebreak=["id"])
    assert te.agg(F.min("id")).first()[0] == 800


def test_baseline_classifier(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(200):
        s = rnd.gauss(0, 1)
        rows.append((i, s, rnd.gauss(0, 1), int(s > 0)))
    df = spark.createDataFrame(rows, "id long, signal double, noise double, target int")
    res = mo.baseline(df, "target", "binary_classification", "id")
    m = res.metrics.first()
    assert m["accuracy"] > 0.7 and m["roc_auc"] is not None
    assert res.importance.first()["feature"] == "signal"


def test_baseline_regression_and_skip(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(200):
        x = rnd.gauss(0, 1)
        rows.append((i, x, rnd.gauss(0, 1), 5 * x + rnd.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "id long, x1 double, noise double, target double")
    assert mo.baseline(df, "target", "regression", "id").metrics.first()["r2"] > 0.5
    skipped = mo.baseline(df, "target", "clustering", "id").summary.first()
    assert skipped["skipped_reason"]


def test_metric_formulas(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "label int, prediction int")
    m = mo.classification_metrics(df).first()
    assert m["accuracy"] == 0.8 and m["precision"] == 1.0 and m["recall"] == 0.6667
    auc = mo.roc_auc(spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.5)], "y int, s double"), "y", "s").first()
    assert auc["roc_auc"] == 0.75
