"""Registered feature-engineering, baseline-model and advised-transform queries
(F01-F13, B01-B10, V01-V04, K03)."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tablelens.operators import features as fe
from tablelens.operators import model as mo
from tablelens.plans import fixtures as fx
from tablelens.plans.catalog import register
from tablelens.plans.q_generic import OX, OX_FAMILIES, orders_x
from tablelens.plans.q_profile import DL, LX
from tablelens.plans.sqlgen import profile_cte
from tablelens.session import checkpoint_dir


@register("f01_drop_plan", f"WITH {OX}, p AS ({profile_cte('ox', OX_FAMILIES)})\n"
          "SELECT \"column\", position, CASE WHEN unique_with_null <= 1 THEN 'constant' ELSE 'id_like' END AS reason "
          "FROM p WHERE \"column\" <> 'o_orderstatus' AND (unique_with_null <= 1 OR (unique_with_null > 1 AND "
          "unique_with_null / greatest(n_rows, 1) > 0.98 AND \"column\" NOT IN ('o_totalprice')))")
def f01_drop_plan(spark, sf):
    return fe.drop_plan(orders_x(spark, sf), "o_orderstatus")


@register("f02_split_kinds")
def f02_split_kinds(spark, sf):
    df = orders_x(spark, sf)
    drops = [r["column"] for r in fe.drop_plan(df, "o_orderstatus").collect()]
    num, cat = fe.split_kinds(df, drops, "o_orderstatus")
    return spark.createDataFrame([(c, "numeric") for c in num] + [(c, "categorical") for c in cat],
                                 "column string, kind string").crossJoin(df.agg(F.count(F.lit(1)).alias("n_rows")))


_F03 = ["o_orderstatus", "o_orderdate", "o_orderpriority", "o_const"]


@register("f03_high_cardinality", f"WITH {OX}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) > 15 AS excluded FROM ox"
    for c in _F03))
def f03_high_cardinality(spark, sf):
    return fe.high_cardinality(orders_x(spark, sf), _F03, 15)


_F04 = fx.LN_COLUMNS


@register("f04_numeric_impute", f"WITH {LX}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(median(CAST({c} AS DOUBLE)), 6) AS fill_value FROM lx" for c in _F04))
def f04_numeric_impute(spark, sf):
    fills = fe.fit_fill_values(fx.lineitem_x(spark, sf), _F04, [], "median")
    return spark.createDataFrame([(c, round(float(v), 6)) for c, v in fills.items()], "column string, fill_value double")


_F05 = ["l_returnflag", "l_linestatus", "l_shipdate", "l_const"]


@register("f05_categorical_impute", f"WITH {LX}\n" + "\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS fill_value FROM lx WHERE {c} IS NOT NULL "
    f"GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 1)" for c in _F05))
def f05_categorical_impute(spark, sf):
    fills = fe.fit_fill_values(fx.lineitem_x(spark, sf), [], _F05)
    return spark.createDataFrame([(c, v) for c, v in fills.items()], "column string, fill_value string")


@register("f06_scaling", f"WITH {LX}, md AS (SELECT " + ", ".join(f"median({c}) AS m{i}" for i, c in enumerate(_F04)) +
          " FROM lx)\n" + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS \"column\", avg(coalesce({c}, m{i})) AS mean, "
              f"stddev_pop(coalesce({c}, m{i})) AS std FROM lx, md" for i, c in enumerate(_F04)))
def f06_scaling(spark, sf):
    df = fx.lineitem_x(spark, sf)
    fills = fe.fit_fill_values(df, _F04, [], "median")
    sc = fe.fit_scaling(df, _F04, fills)
    return spark.createDataFrame([(c, m, s) for c, (m, s) in sc.items()],
                                 "column string, mean double, std double")


@register("f07_one_hot_levels", f"WITH {DL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", v AS level, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS idx "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM dl WHERE {c} IS NOT NULL)" for c in ("lang", "source")))
def f07_one_hot_levels(spark, sf):
    df = fx.documents_labels(spark, sf)
    pre = fe.build_preprocessor(df, [], ["lang", "source"], fe.FeatureSettings())
    idx = pre.stages[1]
    rows = [(c, lvl, i) for c, labels in zip(["lang", "source"], idx.labelsArray) for i, lvl in enumerate(labels)]
    return spark.createDataFrame(rows, "column string, level string, idx int")


@register("f08_stratified_split", f"WITH {DL}\nSELECT doc_id FROM (SELECT doc_id, row_number() OVER "
          "(PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY quality) AS n "
          "FROM dl) WHERE rn <= round(0.2 * n)")
def f08_stratified_split(spark, sf):
    _, test = fe.stratified_split(fx.documents_labels(spark, sf), "quality", "doc_id", 0.2)
    return test.select("doc_id")


@register("f09_time_split", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, "
          "count(*) OVER () AS n FROM orders) WHERE rn > CAST(floor(n * 0.8) AS BIGINT)")
def f09_time_split(spark, sf):
    _, test = fe.time_split(fx.read_table(spark, sf, "orders"), "o_orderdate", 0.2, tiebreak=["o_orderkey"])
    return test.select("o_orderkey")


@register("f10_random_split", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER "
          "(ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) AS rn, count(*) OVER () AS n FROM orders) "
          "WHERE rn <= round(0.2 * n)")
def f10_random_split(spark, sf):
    _, test = fe.random_split(fx.read_table(spark, sf, "orders"), "o_orderkey", 0.2)
    return test.select("o_orderkey")


@register("f11_no_split")
def f11_no_split(spark, sf):
    res = fe.feature_engineering(fx.documents_labels(spark, sf), None, "clustering", "doc_id")
    return res.summary


@register("f12_fit_transform")
def f12_fit_transform(spark, sf):
    res = fe.feature_engineering(fx.documents_labels(spark, sf), "quality", "binary_classification", "doc_id")
    return res.summary


@register("f13_overrides")
def f13_overrides(spark, sf):
    res = fe.feature_engineering(fx.documents_labels(spark, sf), "quality", "binary_classification", "doc_id",
                                 overrides={"scaling": "none", "high_cardinality_threshold": 25,
                                            "numeric_impute": "mean", "drop_columns": ["toxic"]})
    return res.summary


@register("k03_pipeline_artifact")
def k03_pipeline_artifact(spark, sf):
    df = fx.documents_labels(spark, sf)
    res = fe.feature_engineering(df, "quality", "binary_classification", "doc_id")
    path = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    res.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    out = loaded.transform(res.test)
    width = len(fe.feature_names(out))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.lit(width).alias("width"))


@register("b01_gate")
def b01_gate(spark, sf):
    res = mo.baseline(fx.documents_labels(spark, sf), "quality", "clustering", "doc_id")
    return res.summary


@register("b02_rf_classifier")
def b02_rf_classifier(spark, sf):
    res = mo.baseline(fx.documents_labels(spark, sf), "quality", "binary_classification", "doc_id")
    return res.metrics


P_FEATURES = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("b03_rf_regressor")
def b03_rf_regressor(spark, sf):
    res = mo.baseline(fx.read_table(spark, sf, "part").select(*P_FEATURES), "p_retailprice", "regression", "p_partkey")
    return res.metrics


@register("b04_class_weights", f"WITH {DL}\nSELECT quality, count(*) AS n_class, "
          "round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM dl GROUP BY quality")
def b04_class_weights(spark, sf):
    w = mo.class_weights(fx.documents_labels(spark, sf), "quality")
    return w.select("quality", "n_class", F.round("weight", 6).alias("weight"))


@register("b05_classification_metrics", f"WITH {DL}, cm AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p, "
          "count(*) AS c FROM dl GROUP BY 1, 2),\n"
          "pos AS (SELECT sum(c) FILTER (WHERE y = '1' AND p = '1') AS tp, sum(c) FILTER (WHERE y <> '1' AND p = '1') AS fp, "
          "sum(c) FILTER (WHERE y = '1' AND p <> '1') AS fn FROM cm),\n"
          "pr AS (SELECT CASE WHEN coalesce(tp, 0) + coalesce(fp, 0) > 0 THEN coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fp, 0)) ELSE 0 END AS prec, "
          "CASE WHEN coalesce(tp, 0) + coalesce(fn, 0) > 0 THEN coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fn, 0)) ELSE 0 END AS rec FROM pos)\n"
          "SELECT round((SELECT sum(c) FILTER (WHERE y = p) / sum(c) FROM cm), 4) AS accuracy, round(prec, 4) AS precision, "
          "round(rec, 4) AS recall, round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 4) AS f1 FROM pr")
def b05_classification_metrics(spark, sf):
    df = fx.documents_labels(spark, sf)
    return mo.classification_metrics(df, "quality", "toxic")


@register("b06_roc_auc", f"WITH {DL}, r AS (SELECT quality, rank() OVER (ORDER BY CAST(n_chars AS DOUBLE)) + "
          "(count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM dl)\n"
          "SELECT round((sum(rk) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * "
          "(count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * "
          "count(*) FILTER (WHERE quality <> 1)), 4) AS roc_auc FROM r")
def b06_roc_auc(spark, sf):
    return mo.roc_auc(fx.documents_labels(spark, sf), "quality", "n_chars")


@register("b07_regression_metrics", "WITH d AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)\n"
          "SELECT round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, "
          "round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)), 4) AS r2 FROM d")
def b07_regression_metrics(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    return mo.regression_metrics(li.select(F.col("l_extendedprice").alias("label"),
                                           (F.col("l_quantity") * 2000).alias("prediction")))


@register("b08_feature_importance")
def b08_feature_importance(spark, sf):
    res = mo.baseline(fx.documents_labels(spark, sf), "quality", "binary_classification", "doc_id")
    return res.importance


@register("b09_permutation_importance")
def b09_permutation_importance(spark, sf):
    return mo.permutation_importance(fx.documents_labels(spark, sf), "quality", "binary_classification", "doc_id")


@register("b10_own_preprocessing")
def b10_own_preprocessing(spark, sf):
    df = fx.documents_labels(spark, sf)
    num, cat, train, test, pre = mo._prepare(df, "quality", "doc_id", "binary_classification")
    width = len(fe.feature_names(pre.transform(train.limit(0))))
    return spark.createDataFrame([(num, cat, width)], "numeric array<string>, categorical array<string>, width int") \
        .crossJoin(train.agg(F.count(F.lit(1)).alias("train_rows"))).crossJoin(test.agg(F.count(F.lit(1)).alias("test_rows")))


@register("v01_transforms", "SELECT event_id, round(ln(value), 6) AS log_value, round(CASE WHEN value >= 0 THEN "
          "(pow(value + 1, 0.5) - 1) / 0.5 ELSE -(pow(-value + 1, 1.5) - 1) / 1.5 END, 6) AS yeo_johnson FROM events")
def v01_transforms(spark, sf):
    ev = fx.read_table(spark, sf, "events")
    return ev.select("event_id", F.round(fe.log_transform(F.col("value")), 6).alias("log_value"),
                     F.round(fe.yeo_johnson(F.col("value"), 0.5), 6).alias("yeo_johnson"))


@register("v02_undersample", f"WITH {DL}, m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM dl GROUP BY quality))\n"
          "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn "
          "FROM dl) WHERE rn <= (SELECT m FROM m)")
def v02_undersample(spark, sf):
    return fe.undersample(fx.documents_labels(spark, sf), "quality", "doc_id").select("doc_id")


@register("v03_frequency_encode", f"WITH {DL}\nSELECT doc_id, round(count(*) OVER (PARTITION BY source) / "
          "count(*) OVER (), 6) AS source_freq FROM dl")
def v03_frequency_encode(spark, sf):
    out = fe.frequency_encode(fx.documents_labels(spark, sf), "source")
    return out.select("doc_id", F.round("source_freq", 6).alias("source_freq"))


@register("v04_target_encode", f"WITH {DL}\nSELECT doc_id, round(avg(CAST(quality AS DOUBLE)) OVER (PARTITION BY source), 6) "
          "AS source_target_mean FROM dl")
def v04_target_encode(spark, sf):
    out = fe.target_encode(fx.documents_labels(spark, sf), "source", "quality")
    return out.select("doc_id", F.round("source_target_mean", 6).alias("source_target_mean"))
