"""Target-aware steps: class balance and feature association (C01-C07),
regression target analysis (R01-R05), leakage checks (L01-L06)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import moments as mo
from tablelens.functions.columns import as_text, family, numeric_columns, q
from tablelens.functions.dist import chi2_sf, f_pvalue
from tablelens.operators import correlation as co
from tablelens.operators import generic as ge

# Fixed values that must equal the reference's rules.
IMBALANCE_MODERATE = 3.0
IMBALANCE_SEVERE = 10.0
P_SIGNIFICANT = 0.05
MAX_BOX_CLASSES = 200        # box plots by class: one column of quantiles per class
MIN_PAIR_ROWS = 5            # correlations need more than 5 complete rows
MIN_BP_ROWS = 10             # Breusch-Pagan needs more than 10 complete rows
LEAK_NAME_HINTS = ("_after", "outcome", "status_final", "_final", "_result", "post_", "leak", "label")
LEAK_CORR = 0.95
NEAR_DUP_CORR = 0.999
NEAR_DUP_MATCH = 0.98


# ----------------------------------------------------------------------------- classes

def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count per class (null is a class) and pct of all rows, 2 decimals."""
    counts = df.groupBy(as_text(df, target).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # over the class table: rows = number of classes
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("count") / F.sum("count").over(w), 2))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """majority/minority class (ties: smallest class text), minority pct, ratio, severity."""
    cb = class_balance(df, target).withColumn("class_key", F.coalesce("class", F.lit("None")))
    one = cb.agg(
        F.min_by("class_key", F.struct(-F.col("count"), F.col("class_key"))).alias("majority_class"),
        F.min_by("class_key", F.struct(F.col("count"), F.col("class_key"))).alias("minority_class"),
        F.max("count").alias("majority_count"), F.min("count").alias("minority_count"),
        F.min("pct").alias("minority_pct"), F.count(F.lit(1)).alias("n_classes"))
    ratio = F.when(F.col("minority_count") > 0,
                   F.round(F.col("majority_count") / F.col("minority_count"), 2))
    return one.withColumn("imbalance_ratio", ratio).withColumn(
        "severity", F.when(F.col("imbalance_ratio") >= IMBALANCE_SEVERE, "severe")
        .when(F.col("imbalance_ratio") >= IMBALANCE_MODERATE, "moderate").otherwise("none"))


def _long_pairs(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, y, x) for rows where both the feature and the target are present."""
    y = as_text(df, target)
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), mo.present(q(c)).alias("x"))
             for i, c in enumerate(features)]
    return (df.select(y.alias("y"), F.inline(F.array(*cells)))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def anova(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """One-way ANOVA F and p per numeric feature (groups with > 1 row, >= 2 groups).

    One grouped aggregate over (feature, class) gives n, mean and variance of
    each group; the between/within sums are done over that small table.
    """
    features = [c for c in (numeric_columns(df) if features is None else features) if c != target]
    spark = df.sparkSession
    if not features:
        return spark.createDataFrame([], "column string, f_stat double, p_value double")
    g = (_long_pairs(df, target, features).groupBy("feature", "position", "y")
         .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")))
    classes = g.groupBy("feature").agg(F.count(F.lit(1)).alias("n_classes"))
    g = g.join(classes, "feature").where((F.col("n_classes") >= 2) & (F.col("n") > 1))
    tot = g.groupBy("feature", "position").agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    parts = g.join(tot, ["feature", "position"]).groupBy("feature", "position", "n_total", "k").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    parts = parts.where(F.col("k") >= 2)
    # no spread inside any class: a perfect separator has an infinite F and p = 0
    fstat = (F.when(F.col("ssw") > 0, (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n_total") - F.col("k"))))
             .when(F.col("ssb") > 0, F.lit(float("inf"))))
    out = parts.select(F.col("feature").alias("column"), "position", fstat.alias("f"),
                       (F.col("k") - 1).alias("d1"), (F.col("n_total") - F.col("k")).alias("d2"))
    return out.where(F.col("f").isNotNull()).select(
        "column", "position", F.when(F.col("f") == float("inf"), F.col("f")).otherwise(F.round("f", 3)).alias("f_stat"),
        F.when(F.col("f") == float("inf"), F.lit(0.0)).otherwise(
            F.round(f_pvalue(F.when(F.col("f") != float("inf"), F.col("f")), F.col("d1"), F.col("d2")), 5)).alias("p_value"))


def chi_square(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Chi-square (Yates on 2 x 2) and p per non-numeric feature, 3 and 5 decimals."""
    t = co.chi_square_tests(df, target, [c for c in features if c != target])
    return t.select("column", F.round("chi2", 3).alias("chi2"), F.round("p_value", 5).alias("p_value"))


def quantile_bins(df: DataFrame, cols: list[str], bins: int = 10, exact: bool = True) -> DataFrame:
    """Adds ``<col>__bin`` = number of the ``bins``-quantile edges strictly below the value."""
    probs = [i / bins for i in range(1, bins)]
    edges = mo.quantile_row(df, cols, probs, exact=exact, prefix="__e")
    out = df.crossJoin(F.broadcast(edges))  # one-row side
    for i, c in enumerate(cols):
        x = mo.present(q(c))
        out = out.withColumn(f"{c}__bin", F.when(x.isNotNull(), F.size(F.filter(f"__e{i}", lambda e: e < x))))
    return out.drop(*[f"__e{i}" for i in range(len(cols))])


def median_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric imputation with the exact median (one fused aggregate, then coalesce)."""
    if not cols:
        return df
    med = mo.quantile_row(df, cols, (0.5,), prefix="__m")
    out = df.crossJoin(F.broadcast(med))  # one-row side
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.coalesce(mo.present(q(c)), F.col(f"__m{i}")[0]))
    return out.drop(*[f"__m{i}" for i in range(len(cols))])


def binned_mi(df: DataFrame, target: str, features: list[str], bins: int = 10,
              bin_target: bool = False) -> DataFrame:
    """C05 / R04 (re-aimed): plug-in mutual information on quantile bins, natural log.

    Rows with a null target are dropped, features are median-filled, then
    MI = sum p(b, y) ln(p(b, y) / (p(b) p(y))) from one grouped count.
    """
    features = [c for c in features if c != target]
    spark = df.sparkSession
    if not features:
        return spark.createDataFrame([], "column string, mutual_info double")
    data = df.where(~mo.gone(df, target))
    data = median_fill(data, features)
    ycol = q(target)
    if bin_target:
        data = quantile_bins(data, [target], bins)
        ycol = F.col(f"{target}__bin").cast("string")
    else:
        ycol = as_text(data, target)
    data = quantile_bins(data, features, bins).withColumn("__y", ycol)
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__bin").alias("b")) for c in features]
    joint = (data.select("__y", F.inline(F.array(*cells)))
             .groupBy("feature", "b", "__y").agg(F.count(F.lit(1)).alias("nby")))
    pb = joint.groupBy("feature", "b").agg(F.sum("nby").alias("nb"))
    py = joint.groupBy("feature", "__y").agg(F.sum("nby").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nby").alias("n"))
    j = joint.join(pb, ["feature", "b"]).join(py, ["feature", "__y"]).join(n, "feature")
    term = (F.col("nby") / F.col("n")) * F.log(F.col("nby") * F.col("n") / (F.col("nb") * F.col("ny")))
    return j.groupBy(F.col("feature").alias("column")).agg(
        F.greatest(F.lit(0.0), F.sum(term)).alias("mutual_info"))


def boxplot_by_class(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Exact quartiles and range of each feature per class (for the top features by F).

    Every (feature, class) is one column of ``exact_quantiles``; the classes are the rows of the
    class table, at most ``MAX_BOX_CLASSES`` (a numeric target has no classes: raises).
    """
    spark = df.sparkSession
    y = as_text(df, target)
    ranges = (_long_pairs(df, target, features).groupBy(F.col("feature").alias("column"), F.col("y").alias("class"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max")))
    rows = ranges.limit(MAX_BOX_CLASSES * max(1, len(features)) + 1).collect()
    if len(rows) > MAX_BOX_CLASSES * max(1, len(features)):
        raise ValueError(f"'{target}' has more than {MAX_BOX_CLASSES} classes")
    cells = {f"{i}": F.when(y == F.lit(r["class"]), q(r["column"])) for i, r in enumerate(rows)}
    qs = mo.exact_quantiles(df, cells)
    out = [(r["column"], r["class"], r["n"], r["min"], *qs[f"{i}"], r["max"]) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, "column string, class string, n long, min double, q1 double, median double, q3 double, max double")


def top_anova_features(anova_df: DataFrame, k: int = 3) -> DataFrame:
    w = Window.orderBy(F.desc("f_stat"), F.asc("position"))  # rows = number of features
    return anova_df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def significant_features(anova_df: DataFrame, chi_df: DataFrame, mi_df: DataFrame, k: int = 3) -> DataFrame:
    """P < 0.05 by ANOVA F and by chi-square, top 3 each; top 3 by MI."""
    a = anova_df.where(F.col("p_value") < P_SIGNIFICANT).select(
        F.lit("anova").alias("test"), "column", F.col("f_stat").alias("stat"), "p_value")
    c = chi_df.where(F.col("p_value") < P_SIGNIFICANT).select(
        F.lit("chi_square").alias("test"), "column", F.col("chi2").alias("stat"), "p_value")
    m = mi_df.select(F.lit("mutual_info").alias("test"), "column", F.col("mutual_info").alias("stat"),
                     F.lit(None).cast("double").alias("p_value"))
    allr = a.unionByName(c).unionByName(m)
    w = Window.partitionBy("test").orderBy(F.desc("stat"), F.asc("column"))  # rows = features
    return allr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ----------------------------------------------------------------------------- regression

def target_transform(df: DataFrame, target: str) -> DataFrame:
    """Target skew (G1, 3 decimals), minimum, and the suggested transform."""
    y = mo.present(q(target))
    one = df.agg(F.coalesce(mo.sample_skew(y), F.lit(0.0)).alias("skew"),
                 F.coalesce(F.min(y), F.lit(0.0)).alias("min"))
    tr = (F.when(F.abs("skew") <= 1, F.lit(None).cast("string"))
          .when(F.col("min") > 0, "log")
          .when(F.col("min") >= 0, "Yeo-Johnson, or Box-Cox on values moved above zero")
          .otherwise("Yeo-Johnson"))
    return one.select(F.lit(target).alias("target"), F.round("skew", 3).alias("skew"), "min",
                      tr.alias("suggested_transform"))


def target_correlations(df: DataFrame, target: str, features: list[str] | None = None,
                        min_rows: int = MIN_PAIR_ROWS, digits: int = 4) -> DataFrame:
    """Pearson of each numeric feature with the target on pairwise-complete rows."""
    features = [c for c in (numeric_columns(df) if features is None else features) if c != target]
    if not features:
        return df.sparkSession.createDataFrame([], "column string, position int, r double, n long")
    tc = co.pairs_with_target(df, target, features)
    return (tc.where((F.col("n") > min_rows) & F.col("r").isNotNull())
            .select("column", "position", F.round("r", digits).alias("r"), "n"))


def top_correlated(df: DataFrame, target: str, features: list[str] | None = None, k: int = 3) -> DataFrame:
    """Top ``k`` features by |r| with the target (4 decimals)."""
    tc = target_correlations(df, target, features)
    w = Window.orderBy(F.desc(F.abs("r")), F.asc("position"))  # rows = number of features
    return tc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scatter_bins(df: DataFrame, target: str, features: list[str], bins: int = 20) -> DataFrame:
    """R03 (re-aimed scatter plot): 2-D equal-width binned counts of target against each feature."""
    cols = features + [target]
    one = df.agg(*[e for i, c in enumerate(cols) for e in
                   (F.min(mo.present(q(c))).alias(f"lo{i}"), F.max(mo.present(q(c))).alias(f"hi{i}"))])
    data = df.crossJoin(F.broadcast(one))  # one-row side

    def b(c, i):
        lo, hi, x = F.col(f"lo{i}"), F.col(f"hi{i}"), mo.present(q(c))
        return F.when(hi == lo, F.lit(0)).otherwise(
            F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).cast("int")

    ti = len(features)
    cells = [F.struct(F.lit(c).alias("column"), b(c, i).alias("bin_x")) for i, c in enumerate(features)]
    long = data.select(b(target, ti).alias("bin_y"), F.inline(F.array(*cells)))
    return (long.where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
            .groupBy("column", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count")))


def _cov_solve(one, names, yname):
    """Slope vector for y on names from covariances (intercept model)."""
    k = len(names)
    sxx = np.array([[one[f"c_{a}_{b}"] for b in names] for a in names], dtype=float)
    sxy = np.array([one[f"c_{a}_{yname}"] for a in names], dtype=float)
    return np.linalg.lstsq(sxx, sxy, rcond=None)[0] if k else np.zeros(0)


def _cov_aggs(cols: list[str]):
    exprs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            exprs.append(F.covar_pop(F.col(a), F.col(b)).alias(f"c_{a}_{b}"))
    return exprs


def _sym(one: dict, cols: list[str]) -> dict:
    out = dict(one)
    for i, a in enumerate(cols):
        for b in cols[i:]:
            out[f"c_{b}_{a}"] = one[f"c_{a}_{b}"]
    return out


def breusch_pagan(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """LM = n R^2 of squared OLS residuals on the features; p from chi2(k).

    Pass 1: means and covariances (one aggregate) -> OLS slopes on the driver
    (k <= 3). Pass 2: residual^2 covariances with the features (one aggregate)
    -> auxiliary R^2. Both passes are single fused aggregates over the data.
    """
    spark = df.sparkSession
    schema = "target string, n long, lm double, p_value double"
    if not features:
        return spark.createDataFrame([], schema)
    names = [f"x{i}" for i in range(len(features))]
    data = mo.complete(df.select(*[mo.present(q(c)).alias(n) for c, n in zip(features, names)],
                                 mo.present(q(target)).alias("y")))
    cols = names + ["y"]
    one = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                   *_cov_aggs(cols)).collect()[0].asDict()  # one row
    n = one["n"]
    if n <= MIN_BP_ROWS:
        return spark.createDataFrame([], schema)
    one = _sym(one, cols)
    beta = _cov_solve(one, names, "y")
    intercept = one["m_y"] - sum(b * one[f"m_{c}"] for b, c in zip(beta, names))
    fitted = F.lit(float(intercept))
    for b, c in zip(beta, names):
        fitted = fitted + F.lit(float(b)) * F.col(c)
    u = data.withColumn("u", F.pow(F.col("y") - fitted, 2))
    two = u.agg(F.var_pop("u").alias("vu"), *[F.covar_pop(F.col(c), F.col("u")).alias(f"c_{c}_u")
                                               for c in names]).collect()[0].asDict()  # one row
    sxu = np.array([two[f"c_{c}_u"] for c in names])
    sxx = np.array([[one[f"c_{a}_{b}"] for b in names] for a in names])
    g = np.linalg.lstsq(sxx, sxu, rcond=None)[0]
    r2 = float(sxu @ g / two["vu"]) if two["vu"] and two["vu"] > 0 else 0.0
    lm = n * r2
    p = chi2_sf(lm, len(features))
    return spark.createDataFrame([(target, int(n), float(lm), float(round(p, 5)))], schema)


# ----------------------------------------------------------------------------- leakage

def id_like_features(df: DataFrame, target: str) -> DataFrame:
    """ID-like columns other than the target (distinct with null / rows > 0.98)."""
    return ge.constant_and_id(df, exclude=(target,)).where(F.col("flag") == "id_like").select("column", "position")


def suspicious_names(df: DataFrame, target: str) -> DataFrame:
    """Column names holding a post-outcome hint (lower-case substring)."""
    rows = [(c, i) for i, c in enumerate(df.columns)
            if c != target and any(h in c.lower() for h in LEAK_NAME_HINTS)]
    return df.sparkSession.createDataFrame(rows, "column string, position int")


def _numeric_like(df: DataFrame, name: str) -> bool:
    dt = df.schema[name].dataType
    return family(dt) == "numeric" or isinstance(dt, T.BooleanType)


def high_correlation(df: DataFrame, target: str) -> DataFrame:
    """|r| with the target above 0.95 (flag near-duplicate above 0.999).

    Booleans count as numeric here (cast to 0/1); pairs need more than 5 rows.
    """
    if not _numeric_like(df, target):
        return df.sparkSession.createDataFrame([], "column string, position int, correlation double, near_duplicate boolean")
    feats = [c for c in df.columns if c != target and _numeric_like(df, c)]
    data = df.select(*[mo.present(q(c)).alias(c) for c in feats + [target]])
    tc = target_correlations(data, target, feats, digits=12)
    pos = {c: i for i, c in enumerate(df.columns)}
    posmap = F.create_map(*[x for c in feats for x in (F.lit(c), F.lit(pos[c]))])
    return tc.where(F.abs("r") > LEAK_CORR).select(
        "column", posmap[F.col("column")].alias("position"), F.round("r", 4).alias("correlation"),
        (F.abs("r") > NEAR_DUP_CORR).alias("near_duplicate"))


def text_match(df: DataFrame, target: str) -> DataFrame:
    """For pairs where either side is not numeric, share of rows whose text is equal."""
    tnum = _numeric_like(df, target)
    feats = [c for c in df.columns if c != target and not (tnum and _numeric_like(df, c))]
    if not feats:
        return df.sparkSession.createDataFrame([], "column string, match_rate double, near_duplicate boolean")
    t = as_text(df, target)
    one = df.agg(*[F.avg(F.when(as_text(df, c).eqNullSafe(t), 1.0).otherwise(0.0)).alias(f"m{i}")
                   for i, c in enumerate(feats)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("match_rate")) for i, c in enumerate(feats)]
    return one.select(F.inline(F.array(*rows))).withColumn(
        "near_duplicate", F.col("match_rate") > NEAR_DUP_MATCH)


def near_duplicates(df: DataFrame, target: str) -> DataFrame:
    """L04 + L05: sorted distinct names of near-duplicate columns."""
    a = high_correlation(df, target).where("near_duplicate").select("column")
    b = text_match(df, target).where("near_duplicate").select("column")
    return a.unionByName(b).distinct()


def id_like_correlated(df: DataFrame, target: str) -> DataFrame:
    """ID-like columns that are also highly correlated with the target."""
    return id_like_features(df, target).select("column").intersect(
        high_correlation(df, target).select("column"))
