"""Baseline model (B01-B10): random forest on its own light preprocessing.

Metrics are computed from confusion counts / one aggregate (not MLlib's
weighted evaluators, which differ from macro averages). ROC AUC is the
rank-sum statistic with average ranks from the distributed rank helper.
Permutation importance re-aims the reference's SHAP plot: each feature column
is permuted within random buckets (row numbers by two md5 orders inside a
bucket), so no task ever holds more than a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import freq as fq
from tablelens.functions import moments as mo
from tablelens.functions.columns import family, nan_to_null, q
from tablelens.functions.sampling import SEED, md5_key
from tablelens.operators import correlation as co
from tablelens.operators import features as fe
from tablelens.session import checkpoint_dir

# Fixed values that must equal the reference's rules.
N_TREES = 200
MAX_DEPTH = 8
MIN_ROWS = 20
TEST_SIZE = 0.2
MAX_LEVELS = 15
MAX_CLASSES = 1000   # classes of a target (own bound)
TOP_IMPORTANCE = 10
FIT_ROWS = 50_000    # rows of one fitting task (own bound): each level reads a row with its count for every tree
CLASSIFICATION = ("binary_classification", "multiclass_classification")
SUPERVISED = (*CLASSIFICATION, "regression")


def gate(df: DataFrame, target: str | None, problem_type: str | None) -> str | None:
    """The reason to skip the baseline, or None when it can run."""
    if not target or target not in df.columns:
        return "no confirmed target column"
    if problem_type not in SUPERVISED:
        return f"problem type {problem_type!r} is not supervised"
    usable = [c for c in df.columns if c != target]
    if not usable:
        return "no usable feature columns"
    if df.count() < MIN_ROWS:
        return f"fewer than {MIN_ROWS} rows"
    return None


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight per class, n / (k * n_class)."""
    counts = df.groupBy(q(target).alias("__y")).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()  # over the class table (rows = classes)
    return counts.select(F.col("__y").alias(target), "n_class",
                         (F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class"))).alias("weight"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           positive: str | None = "1") -> DataFrame:
    """Accuracy; precision, recall, F1 for the positive class when the labels are
    binary with that class present, else macro averages; 0 on zero division; 4 decimals."""
    y, p = q(label).cast("string"), q(prediction).cast("string")
    cm = pred.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    classes = cm.select(F.col("y").alias("cls")).unionByName(cm.select(F.col("p").alias("cls"))).distinct()
    per = classes.join(cm, (F.col("cls") == F.col("y")) | (F.col("cls") == F.col("p")), "left").groupBy("cls").agg(
        F.sum(F.when((F.col("y") == F.col("cls")) & (F.col("p") == F.col("cls")), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") != F.col("cls")) & (F.col("p") == F.col("cls")), F.col("c")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == F.col("cls")) & (F.col("p") != F.col("cls")), F.col("c")).otherwise(0)).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    per = per.select("cls", prec.alias("precision"), rec.alias("recall"))
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
    acc = cm.agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)) / F.sum("c")).alias("accuracy"))
    agg = per.agg(F.count(F.lit(1)).alias("n_classes"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.max(F.when(F.col("cls") == F.lit(positive), F.struct("precision", "recall", "f1"))).alias("pos"))
    ylabels = cm.agg(F.count_distinct("y").alias("ny"))
    binary = (F.col("ny") <= 2) & F.col("pos").isNotNull()
    return acc.crossJoin(agg).crossJoin(ylabels).select(  # one row each
        F.round("accuracy", 4).alias("accuracy"),
        F.round(F.when(binary, F.col("pos.precision")).otherwise(F.col("mp")), 4).alias("precision"),
        F.round(F.when(binary, F.col("pos.recall")).otherwise(F.col("mr")), 4).alias("recall"),
        F.round(F.when(binary, F.col("pos.f1")).otherwise(F.col("mf")), 4).alias("f1"))


def roc_auc(pred: DataFrame, label: str, score: str, positive: str = "1") -> DataFrame:
    """ROC AUC by the rank-sum statistic (average ranks for ties); two classes only."""
    data = pred.select(q(label).cast("string").alias("y"), mo.present(q(score)).alias("s")).where(
        F.col("y").isNotNull() & F.col("s").isNotNull())
    ranks = co.average_ranks(data, "s")
    j = data.join(ranks, data["s"] == ranks["v"])
    one = j.agg(F.count_distinct("y").alias("k"),
                F.count_if(F.col("y") == positive).alias("npos"),
                F.count_if(F.col("y") != positive).alias("nneg"),
                F.sum(F.when(F.col("y") == positive, F.col("avg_rank"))).alias("rsum"))
    auc = (F.col("rsum") - F.col("npos") * (F.col("npos") + 1) / 2) / (F.col("npos") * F.col("nneg"))
    return one.select(F.when((F.col("k") == 2) & (F.col("npos") > 0) & (F.col("nneg") > 0),
                             F.round(auc, 4)).alias("roc_auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R^2 (1 - SSE / SST around the label mean), 4 decimals, one aggregate."""
    y, p = mo.present(q(label)), mo.present(q(prediction))
    one = pred.agg(F.avg(F.pow(y - p, 2)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                   F.sum(F.pow(y - p, 2)).alias("sse"), F.var_pop(y).alias("vy"), F.count(y).alias("n"))
    r2 = F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("vy") * F.col("n")))
    return one.select(F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                      F.round(r2, 4).alias("r2"))


def class_labels(df: DataFrame, target: str) -> list[str]:
    """The classes as text, in order (numbers by value): at most ``MAX_CLASSES``, else it raises."""
    rows = df.where(q(target).isNotNull()).groupBy(q(target).alias("y")).count().orderBy("y").limit(MAX_CLASSES + 1)
    found = [r[0] for r in rows.select(F.col("y").cast("string")).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"'{target}' has more than {MAX_CLASSES} classes")
    return found


def label_index(target: str, classes: list[str]) -> Column:
    """Position of the row's class among ``classes`` as a double (null for an unknown class)."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), q(target).cast("string"))
    return F.when(at > 0, (at - 1).cast("double"))


def positive_class(classes: list[str], wanted: str | None = None) -> str | None:
    """The class that binary metrics are about: the wanted one, else '1' or 'true', else the last in order."""
    for c in (wanted, "1", "true"):
        if c is not None and c in classes:
            return c
    return classes[-1] if classes else None


@dataclass
class BaselineResult:
    summary: DataFrame
    metrics: DataFrame
    importance: DataFrame
    predictions: DataFrame | None


def _prepare(df: DataFrame, target: str, key: str, problem_type: str):
    """Own preprocessing: median / most-frequent fill, one-hot of columns with <= 15
    values, no scaling, nothing dropped as ID-like; stratified 0.2 split when possible."""
    feats = [c for c in df.columns if c != target and c != key]
    num = [c for c in feats if family(df.schema[c].dataType) == "numeric"]
    others = [c for c in feats if c not in num]
    cat = []
    if others:
        ds = fq.distinct_summary(fq.frequency_table(df, others)).collect()  # one row per column
        cat = [r["column"] for r in sorted(ds, key=lambda r: r["position"]) if r["unique_count"] <= MAX_LEVELS]
    is_cls = problem_type in CLASSIFICATION
    if is_cls and fe.can_stratify(df, target):
        train, test = fe.stratified_split(df, target, key, TEST_SIZE)
    else:
        train, test = fe.random_split(df, key, TEST_SIZE)
    checkpoint_dir(df.sparkSession)
    train, test = train.checkpoint(), test.checkpoint()   # fitting reads them many times: the split runs once
    tasks = -(-train.count() // FIT_ROWS)
    if tasks > 1:
        train = train.repartition(tasks).checkpoint()     # a small file is one split, however many rows it holds
    settings = fe.FeatureSettings(scaling="none")
    pre = fe.build_preprocessor(train, num, cat, settings)
    return num, cat, train, test, pre


def baseline(df: DataFrame, target: str, problem_type: str, key: str, seed: int = SEED,
             n_trees: int = N_TREES, max_depth: int = MAX_DEPTH, positive: str | None = None) -> BaselineResult:
    """Fit the forest on the train rows and score the test rows.

    Class labels of any type are indexed in order; ``predictions`` has ``predicted_class`` as text.
    """
    spark = df.sparkSession
    df = nan_to_null(df)
    reason = gate(df, target, problem_type)
    skip_schema = "target string, problem_type string, skipped_reason string"
    if reason:
        s = spark.createDataFrame([(target, problem_type, reason)], skip_schema)
        return BaselineResult(s, spark.createDataFrame([], "metric string, value double"),
                              spark.createDataFrame([], "feature string, importance double"), None)
    data = df.where(q(target).isNotNull())
    num, cat, train, test, pre = _prepare(data, target, key, problem_type)
    is_cls = problem_type in CLASSIFICATION
    tr = pre.transform(train)
    te = pre.transform(test)
    names = fe.feature_names(tr)
    if is_cls:
        weights = class_weights(train, target)
        tr = tr.join(F.broadcast(weights.select(target, "weight")), target)  # one row per class
        classes = class_labels(data, target)
        about = positive_class(classes, positive)
        tr = tr.withColumn("label", label_index(target, classes))
        te = te.withColumn("label", label_index(target, classes))
        model = RandomForestClassifier(numTrees=n_trees, maxDepth=max_depth, seed=seed, labelCol="label",
                                       featuresCol="features", weightCol="weight").fit(tr)
        names_of = F.array(*[F.lit(c) for c in classes])
        pred = (model.transform(te).withColumn("p1", vector_to_array("probability")[classes.index(about)])
                .withColumn("predicted_class", names_of[F.col("prediction").cast("int")]))
        m = classification_metrics(pred.select(q(target).cast("string").alias("label"),
                                               F.col("predicted_class").alias("prediction")), positive=about)
        auc = roc_auc(pred, target, "p1", positive=about)
        metrics = m.crossJoin(auc)  # one row by one row
    else:
        tr = tr.withColumn("label", q(target).cast("double"))
        te = te.withColumn("label", q(target).cast("double"))
        model = RandomForestRegressor(numTrees=n_trees, maxDepth=max_depth, seed=seed, labelCol="label",
                                      featuresCol="features").fit(tr)
        pred = model.transform(te)
        metrics = regression_metrics(pred)
    imp = model.featureImportances.toArray().tolist()
    ranked = sorted(enumerate(zip(names, imp)), key=lambda t: (-round(t[1][1], 4), t[0]))
    rows = [(n, round(v, 4)) for _, (n, v) in ranked[:TOP_IMPORTANCE]]
    importance = spark.createDataFrame([(n, float(v)) for n, v in rows], "feature string, importance double")
    summary = spark.createDataFrame([(target, problem_type, None)], skip_schema)
    return BaselineResult(summary, metrics, importance, pred)


def permute_column(df: DataFrame, col: str, key: str, seed: int = SEED, bucket_rows: int = 100_000) -> DataFrame:
    """Random permutation of one column within random buckets of about ``bucket_rows`` rows."""
    n = df.count()
    buckets = max(1, n // bucket_rows)
    h1 = md5_key(f"{seed}:a", F.col(f"`{key}`"))
    h2 = md5_key(f"{seed}:b", F.col(f"`{key}`"))
    b = F.pmod(F.xxhash64(h1), F.lit(buckets))
    base = df.withColumn("__b", b).withColumn("__r1", F.row_number().over(Window.partitionBy("__b").orderBy(h1)))
    vals = df.select(q(col).alias("__v"), b.alias("__b"),
                     F.row_number().over(Window.partitionBy(b).orderBy(h2)).alias("__r1"))
    out = base.drop(col).join(vals, ["__b", "__r1"]).withColumnRenamed("__v", col)
    return out.select(*df.columns)


def permutation_importance(df: DataFrame, target: str, problem_type: str, key: str,
                           features: list[str] | None = None, seed: int = SEED,
                           n_trees: int = 50, max_depth: int = MAX_DEPTH) -> DataFrame:
    """B09 (re-aimed): drop of the test metric (accuracy or R^2) after permuting one feature."""
    spark = df.sparkSession
    data = df.where(q(target).isNotNull())
    num, cat, train, test, pre = _prepare(data, target, key, problem_type)
    is_cls = problem_type in CLASSIFICATION
    label = label_index(target, class_labels(data, target)) if is_cls else q(target).cast("double")
    tr = pre.transform(train).withColumn("label", label)
    est = (RandomForestClassifier if is_cls else RandomForestRegressor)(
        numTrees=n_trees, maxDepth=max_depth, seed=seed, labelCol="label", featuresCol="features")
    model = est.fit(tr)

    def score(frame):
        pred = model.transform(pre.transform(frame).withColumn("label", label))
        if is_cls:
            return pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        return regression_metrics(pred).first()["r2"]

    base = score(test)
    rows = []
    for c in (features or num + cat):
        rows.append((c, float(base - score(permute_column(test, c, key, seed)))))
    return spark.createDataFrame(rows, "feature string, importance double")
