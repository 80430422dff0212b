"""Findings: bullet texts (A01) and severity (A02) per analysis step.

Every step's summary is a one-row (or per-column) DataFrame; texts and
severities are Spark expressions over it (``format_string``, ``when``), so a
run's findings are one ``unionByName`` of small frames (A05).

Numbers are formatted like Python's format mini-language: ``{:,}`` through
``format_number(x, 0)`` and ``{:.1f}`` through half-even rounding then
``%.1f``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules.
# (warning, critical) thresholds per step metric:
MISSING_BUCKET = (15, 50)
DUPLICATE_BUCKET = (5, 20)
CONSTANT_ID_BUCKET = (1, 5)
OUTLIER_BUCKET = (5, 15)
IMBALANCE_BUCKET = (3, 10)
STRONG_CORRELATION = 0.95

FINDINGS_SCHEMA = "step string, severity string, bullet int, text string"


def f1(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x.cast("double"), 1))


def f2(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x.cast("double"), 2))


def thousands(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def bucket(value: Column, warning: float, critical: float) -> Column:
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.when(v >= critical, "critical").when(v >= warning, "warning").otherwise("info")


def _bullets(one: DataFrame, step: str, severity: Column, texts: list[Column]) -> DataFrame:
    """Explode an ordered list of optional texts (null = no bullet) into finding rows."""
    arr = F.filter(F.array(*texts), lambda t: t.isNotNull())
    return one.select(F.lit(step).alias("step"), severity.alias("severity"),
                      F.posexplode(arr).alias("bullet", "text"))


def missing_findings(summary: DataFrame) -> DataFrame:
    """summary: columns_with_missing, total_missing_cells, worst_column, worst_pct."""
    none = F.col("columns_with_missing") == 0
    t1 = F.when(none, F.lit("Every column is complete.")).otherwise(F.format_string(
        "Incomplete columns: %s; empty cells: %s.",
        F.col("columns_with_missing").cast("string"), thousands(F.col("total_missing_cells"))))
    t2 = F.when(~none & F.col("worst_column").isNotNull(), F.format_string(
        "Most gaps: '%s', %s%% of its cells.", F.col("worst_column"), f1(F.col("worst_pct"))))
    return _bullets(summary, "missing_values", bucket(F.col("worst_pct"), *MISSING_BUCKET), [t1, t2])


def duplicate_findings(summary: DataFrame) -> DataFrame:
    """summary: duplicate_rows, duplicate_pct."""
    t = F.when(F.col("duplicate_rows") == 0, F.lit("No row occurs twice.")).otherwise(
        F.format_string("Repeated rows: %s, that is %s%% of the table.", thousands(F.col("duplicate_rows")),
                        f1(F.col("duplicate_pct"))))
    return _bullets(summary, "duplicates", bucket(F.col("duplicate_pct"), *DUPLICATE_BUCKET), [t])


def constant_id_findings(flags: DataFrame) -> DataFrame:
    """flags: column, position, flag in {constant, id_like}."""
    one = flags.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("flag") == "constant",
                                                                     F.struct("position", "column")))),
                                 lambda s: s["column"]), ", ").alias("const"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("flag") == "id_like",
                                                                     F.struct("position", "column")))),
                                 lambda s: s["column"]), ", ").alias("ids"),
        F.count(F.lit(1)).alias("n"))  # the inputs are per-column rows
    t1 = F.when(F.col("const") != "", F.format_string("One value only: %s.", F.col("const"))) \
        .otherwise(F.lit("Every column varies."))
    t2 = F.when(F.col("ids") != "", F.format_string(
        "Over 98%% distinct, so probably row names: %s. A model should not see them.", F.col("ids")))
    return _bullets(one, "constant_and_id_columns", bucket(F.col("n"), *CONSTANT_ID_BUCKET), [t1, t2])


def distribution_findings(skews: DataFrame) -> DataFrame:
    """skews: column, position, skew."""
    ranked = skews.where(F.abs("skew") > 1)
    one = skews.agg(F.count(F.lit(1)).alias("n")).crossJoin(ranked.agg(  # one row by one row
        F.slice(F.sort_array(F.collect_list(F.struct((-F.abs("skew")).alias("a"), "position", "column", "skew"))), 1, 3)
        .alias("top")))
    t1 = F.when(F.col("n") == 0, F.lit("There is no numeric column whose shape could be described.")).otherwise(
        F.format_string("Numeric columns described: %s.", F.col("n").cast("string")))
    listed = F.array_join(F.transform("top", lambda s: F.format_string("%s: skew %s", s["column"], f2(s["skew"]))), ", ")
    t2 = F.when((F.col("n") > 0) & (F.size("top") > 0), F.format_string(
        "Lopsided: %s. A power or logarithm transform would even them out.", listed))
    return _bullets(one, "univariate_distributions", F.lit("info"), [t1, t2])


def outlier_findings(table: DataFrame) -> DataFrame:
    """table: column, position, iqr_outliers, iqr_outlier_pct, z_score_outliers."""
    one = table.agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("iqr_outlier_pct")).alias("a"), "position", "column",
                                                     "iqr_outliers", "iqr_outlier_pct", "z_score_outliers"))), 1, 3)
        .alias("top"), F.max("iqr_outlier_pct").alias("worst"), F.count(F.lit(1)).alias("n"))
    items = F.filter("top", lambda s: s["iqr_outliers"] > 0)
    texts = F.transform(items, lambda s: F.format_string(
        "'%s': outside the quartile fences %s rows (%s%%), over three deviations from the mean %s.", s["column"],
        s["iqr_outliers"].cast("string"), f1(s["iqr_outlier_pct"]), s["z_score_outliers"].cast("string")))
    fallback = F.when(F.col("n") == 0, F.lit("There is no numeric column to search for outliers.")).otherwise(
        F.lit("Neither the quartile fences nor the z-scores mark a row."))
    arr = F.when(F.size(texts) > 0, texts).otherwise(F.array(fallback))
    return one.select(F.lit("outliers").alias("step"), bucket(F.col("worst"), *OUTLIER_BUCKET).alias("severity"),
                      F.posexplode(arr).alias("bullet", "text"))


def correlation_findings(strongest: DataFrame, vif: DataFrame | None = None) -> DataFrame:
    """strongest: col_a, col_b, r (G18); vif: column, vif."""
    s = strongest.agg(F.first("col_a").alias("a"), F.first("col_b").alias("b"), F.first("r").alias("r"))
    if vif is None:
        v = s.sparkSession.createDataFrame([("",)], "high string")
    else:
        v = vif.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
            F.col("vif") > 10, F.struct((-F.col("vif")).alias("k"), "column")))), lambda x: x["column"]), ", ").alias("high"))
    one = s.crossJoin(v)  # one row by one row
    t1 = F.when(F.col("a").isNotNull(), F.format_string("Closest linear pair: %s and %s, r = %s.",
                                                         F.col("a"), F.col("b"), f2(F.col("r"))))
    t2 = F.when(F.col("high") != "", F.format_string(
        "Largely explained by the other columns (variance inflation over 10): %s. Keep one of each such set.", F.col("high")))
    sev = F.when((F.abs(F.coalesce("r", F.lit(0.0))) >= STRONG_CORRELATION) | (F.col("high") != ""), "warning").otherwise("info")
    out = _bullets(one, "correlations", sev, [t1, t2])
    fallback = one.where(F.col("a").isNull() & (F.col("high") == "")).select(
        F.lit("correlations").alias("step"), F.lit("info").alias("severity"), F.lit(0).alias("bullet"),
        F.lit("Correlations need two columns of one kind.").alias("text"))
    return out.unionByName(fallback)


def class_balance_findings(imb: DataFrame, target: str) -> DataFrame:
    """imb: majority_class, minority_class, minority_pct, n_classes, imbalance_ratio."""
    t1 = F.format_string("'%s' takes %s classes; the rarest, '%s', holds %s%% of the rows.", F.lit(target),
                         F.col("n_classes").cast("string"), F.col("minority_class"), f1(F.col("minority_pct")))
    t2 = F.when(F.col("imbalance_ratio") >= 3, F.format_string(
        "%s: the largest class has %s rows for each row of the rarest. Weight the classes or undersample, and judge "
        "a model by F1 or precision and recall rather than accuracy.",
        F.when(F.col("imbalance_ratio") >= 10, "Very uneven classes").otherwise("Uneven classes"), f1(F.col("imbalance_ratio"))))
    return _bullets(imb, "class_balance", bucket(F.col("imbalance_ratio"), *IMBALANCE_BUCKET), [t1, t2])


def leakage_findings(near_dup: DataFrame, high_corr: DataFrame, id_corr: DataFrame, names: DataFrame) -> DataFrame:
    """Inputs are the L01-L06 results (column lists)."""
    def listed(df, alias, order="column"):
        return df.agg(F.array_join(F.sort_array(F.collect_list(order)), ", ").alias(alias))

    one = (listed(near_dup, "nd").crossJoin(listed(id_corr, "ic")).crossJoin(listed(names, "nm"))  # one-row sides
           .crossJoin(high_corr.join(near_dup, "column", "left_anti").agg(
               F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("position", "column", "correlation"))), 1, 3),
                                        lambda s: F.format_string("%s: r %s", s["column"], f2(s["correlation"]))), ", ").alias("hc"))))
    t1 = F.when(F.col("nd") != "", F.format_string(
        "Almost equal to the target, row by row: %s. If they are computed from it, they must go.", F.col("nd")))
    t2 = F.when(F.col("hc") != "", F.format_string(
        "Follows the target too closely to be an input by chance: %s.", F.col("hc")))
    t3 = F.when(F.col("ic") != "", F.format_string(
        "Row names that go with the target: %s. The table's order or a leak explains this, not a property.", F.col("ic")))
    t4 = F.when(F.col("nm") != "", F.format_string(
        "Named like something recorded after the outcome: %s. Make sure of when each value was known.", F.col("nm")))
    sev = (F.when((F.col("nd") != "") | (F.col("ic") != ""), "critical")
           .when((F.col("hc") != "") | (F.col("nm") != ""), "warning").otherwise("info"))
    out = _bullets(one, "leakage_checks", sev, [t1, t2, t3, t4])
    none = one.where((F.col("nd") == "") & (F.col("hc") == "") & (F.col("ic") == "") & (F.col("nm") == "")).select(
        F.lit("leakage_checks").alias("step"), F.lit("info").alias("severity"), F.lit(0).alias("bullet"),
        F.lit("Names, correlations and copies give no sign of leakage.").alias("text"))
    return out.unionByName(none)


def simple_findings(step: str, texts: list[str], severity: str = "info") -> DataFrame:
    """Steps whose bullets are already plain strings on the driver (a handful)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(step, severity, i, t) for i, t in enumerate(texts)], FINDINGS_SCHEMA)
