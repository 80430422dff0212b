"""The analysis plan (A03), plan edits (A04) and a full run's report.

``analyze(df, ...)`` runs the generic steps, then the steps of the problem
type, then feature engineering and the baseline model, and returns every
finding as one DataFrame. The input is persisted once and its frequency table
is shared by all steps that need distinct counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import freq as fq
from tablelens.functions.columns import nan_to_null, numeric_columns
from tablelens.functions.moments import complete
from tablelens.operators import correlation as co
from tablelens.operators import generic as ge
from tablelens.operators import profile as pr
from tablelens.operators import target as tg
from tablelens.plans import findings as fi

# Fixed values that must equal the reference's rules.
GENERIC_STEPS = ["overview", "duplicates", "constant_and_id_columns", "missing_values",
                 "univariate_distributions", "outliers", "correlations"]
PROBLEM_TYPE_STEPS = {
    "regression": ["regression_target_analysis", "leakage_checks"],
    "binary_classification": ["class_balance", "classification_feature_analysis", "leakage_checks"],
    "multiclass_classification": ["class_balance", "classification_feature_analysis", "leakage_checks"],
    "clustering": ["clustering_analysis"],
    "time_series": ["time_series_analysis"],
}
ALL_STEPS = GENERIC_STEPS + ["class_balance", "classification_feature_analysis", "regression_target_analysis",
                             "leakage_checks", "clustering_analysis", "time_series_analysis"]


def build_plan(problem_type: str | None) -> list[str]:
    """The seven generic steps, then the problem type's own steps (no type: clustering)."""
    if problem_type is None:
        problem_type = "clustering"
    return GENERIC_STEPS + PROBLEM_TYPE_STEPS.get(problem_type, [])


def edit_plan(steps: list[str] | str) -> list[str]:
    """An ordered subset of known steps; empty or unknown steps raise."""
    if isinstance(steps, str):
        steps = [s.strip() for s in steps.split(",")]
    steps = [s.strip() for s in steps if s and s.strip()]
    if not steps:
        raise ValueError("the plan has no step")
    unknown = [s for s in steps if s not in ALL_STEPS]
    if unknown:
        raise ValueError(f"no such step: {', '.join(unknown)}")
    return steps


@dataclass
class RunReport:
    target: str | None
    problem_type: str | None
    steps: list[str]
    findings: DataFrame


def _numeric_first(df: DataFrame, limit: int | None) -> list[str]:
    return numeric_columns(df, limit)


def run_step(step: str, df: DataFrame, freq: DataFrame, target: str | None,
             numeric_limit: int | None = None) -> DataFrame:
    """One analysis step's findings (A01 texts with A02 severity)."""
    nums = [c for c in _numeric_first(df, numeric_limit)]
    if step == "overview":
        ov = ge.overview(df).collect()  # one row per dtype
        n_rows = ov[0]["n_rows"] if ov else 0
        size = pr.table_bytes(df).first()["data_bytes"]
        types = ", ".join(f"{r['dtype']} ({r['column_count']})" for r in ov)
        return fi.simple_findings("overview", [
            f"Rows: {n_rows:,}. Columns: {len(df.columns)}. Size of the cells: {size / 1e6:.1f} MB.",
            f"Types: {types}."])
    if step == "missing_values":
        return fi.missing_findings(ge.missing_summary(df))
    if step == "duplicates":
        return fi.duplicate_findings(ge.duplicate_summary(df))
    if step == "constant_and_id_columns":
        return fi.constant_id_findings(ge.constant_and_id(df, freq))
    if step == "univariate_distributions":
        return fi.distribution_findings(ge.skew_kurtosis(df, nums))
    if step == "outliers":
        return fi.outlier_findings(ge.outlier_table(df, nums))
    if step == "correlations":
        if len(nums) < 2:
            return fi.simple_findings("correlations", ["Correlations need two columns of one kind."])
        pairs = co.pearson_pairs(df, nums)
        return fi.correlation_findings(co.strongest_pair(pairs), co.vif_from_pairs(pairs, nums))
    if step == "class_balance":
        if not target:
            return fi.simple_findings(step, ["No target class, so no balance to report."])
        return fi.class_balance_findings(tg.imbalance(df, target), target)
    if step == "leakage_checks":
        if not target:
            return fi.simple_findings(step, ["No target that could leak."])
        return fi.leakage_findings(tg.near_duplicates(df, target), tg.high_correlation(df, target),
                                   tg.id_like_correlated(df, target), tg.suspicious_names(df, target))
    if step == "classification_feature_analysis":
        if not target:
            return fi.simple_findings(step, ["No target class to compare features by."])
        feats = [c for c in nums if c != target]
        sig = tg.significant_features(tg.anova(df, target, feats),
                                      tg.chi_square(df, target, [c for c in df.columns if c not in nums and c != target]),
                                      tg.binned_mi(df, target, feats))
        rows = sig.orderBy("test", "rank").collect()  # <= 9 rows
        texts = [f"{r['column']} tells the classes apart ({r['test']} {r['stat']:.3f}"
                 + (f", p {r['p_value']:.5f})." if r["p_value"] is not None else ").") for r in rows]
        return fi.simple_findings(step, texts or ["No feature differs between the classes at the 5 % level."])
    if step == "regression_target_analysis":
        if not target:
            return fi.simple_findings(step, ["No numeric target to describe."])
        feats = [c for c in nums if c != target]
        t = tg.target_transform(df, target).first()
        texts = [f"'{target}' has skew {t['skew']:.2f}."]
        if t["suggested_transform"]:
            texts.append(f"Its values are lopsided; a {t['suggested_transform']} transform would even them out.")
        top = tg.top_correlated(df, target, feats).orderBy("rank").collect()  # <= 3 rows
        if top:
            texts.append("Moves most with " + ", ".join(f"{r['column']} (r {r['r']:.2f})" for r in top) + ".")
            bp = tg.breusch_pagan(df, target, [r["column"] for r in top]).first()
            if bp is not None and bp["p_value"] is not None:
                spread = "changes with these columns" if bp["p_value"] < 0.05 else "is about the same throughout"
                texts.append(f"The error of a straight-line fit {spread} (Breusch-Pagan p {bp['p_value']:.4f}).")
        return fi.simple_findings(step, texts)
    if step == "clustering_analysis":
        return _clustering_findings(df, target, nums)
    if step == "time_series_analysis":
        return _series_findings(df, target)
    return fi.simple_findings(step, [f"Step '{step}' has no findings text in this run."])


def _clustering_findings(df: DataFrame, target: str | None, nums: list[str]) -> DataFrame:
    """U01-U08 summarised as bullets (scale spread, 95 % components, Hopkins band, k)."""
    from tablelens.operators import cluster as cl
    feats = [c for c in nums if c != target]
    n_complete = complete(df.select(*feats)).count() if len(feats) >= cl.MIN_FEATURES else 0
    if len(feats) < cl.MIN_FEATURES or n_complete < cl.MIN_ROWS:
        return fi.simple_findings("clustering_analysis", ["Too few numeric columns or complete rows for clustering."])
    texts = []
    stds = [r["std"] for r in cl.scale_report(df, feats).collect() if r["std"] and r["std"] > 0]
    if stds and max(stds) / max(min(stds), 1e-9) > cl.SCALE_RATIO:
        texts.append(f"Deviations run from {min(stds):.2f} to {max(stds):.2f}: standardise before distances are taken.")
    pca = cl.pca_variance(df, feats).first()
    if pca and pca["n_components_for_95pct"]:
        texts.append(f"Components for 95% of the variance: {pca['n_components_for_95pct']}.")
    h = cl.hopkins(df, feats).first()["hopkins_statistic"]
    if h is not None:
        if h > cl.HOPKINS_STRONG:
            texts.append(f"Hopkins {h:.2f}: the rows lie in clear clumps.")
        elif h < cl.HOPKINS_RANDOM:
            texts.append(f"Hopkins {h:.2f}: the rows lie about as random points do.")
        else:
            texts.append(f"Hopkins {h:.2f}: some clumping.")
    best = [r["k"] for r in cl.kmeans_scan(df, feats).where("suggested").collect()]
    if best:
        texts.append(f"Best silhouette at k = {best[0]}.")
    return fi.simple_findings("clustering_analysis", texts or ["Nothing stands out for clustering."])


def _has_grid(freq: str) -> bool:
    from tablelens.operators import series as se
    try:
        return bool(se.parse_step(freq))
    except ValueError:          # business days have no even step
        return False


def _series_findings(df: DataFrame, target: str | None) -> DataFrame:
    """T01-T13 summarised as bullets (date column, frequency, gaps, strengths, advice)."""
    from tablelens.operators import series as se
    if not target:
        return fi.simple_findings("time_series_analysis", [
            "A series needs a date column and a target; one is missing."])
    date_col = se.detect_date_column(df, target).first()["date_column"]
    if date_col is None:
        return fi.simple_findings("time_series_analysis", [
            "A series needs a date column and a target; one is missing."])
    s = se.ordered_series(df, date_col, target)
    freq = se.infer_frequency(s).first()["inferred_freq"]
    n = s.count()
    texts = [f"Time runs along '{date_col}' (step {freq or 'uneven'}) with {n:,} points."]
    gaps = se.gap_count(s).first()["gap_count"]
    if gaps:
        texts.append(f"Steps over 1.5 times the usual one: {gaps}. Periods may be missing.")
    period = se.season_length(freq)
    known = s.where(F.col("y").isNotNull()).count()
    if known:
        # without a frequency the points count by their place in time order
        reg = se.prepare_regular(s, freq) if freq and _has_grid(freq) else se.prepare_irregular(s)
        auto = se.acf(reg)
        top = auto.orderBy(F.abs("acf").desc(), "lag").first()
        if top is not None:
            part = se.pacf_from_acf(auto).orderBy(F.abs("pacf").desc(), "lag").first()
            texts.append(f"Autocorrelation is largest at lag {top['lag']} ({top['acf']:.3f}), "
                         f"partial autocorrelation at lag {part['lag']} ({part['pacf']:.3f}).")
        if freq and period and reg.count() >= 2 * period:
            st = se.strengths(se.decompose(reg, period)).first()
            tr = st["trend_strength"] if st["trend_strength"] is not None else "n/a"
            ss = st["seasonal_strength"] if st["seasonal_strength"] is not None else "n/a"
            texts.append(f"Split at period {period}: strength of the trend {tr}, of the season {ss}.")
            texts.append(f"Useful inputs: the values 1 and {period} steps back, mean and deviation of the last {period}.")
    texts.append("Test on the latest rows; a shuffled split would look ahead.")
    return fi.simple_findings("time_series_analysis", texts)


def analyze(df: DataFrame, target: str | None = None, problem_type: str | None = None,
            steps: list[str] | None = None, numeric_limit: int | None = None,
            key: str | None = None, overrides: dict | None = None,
            persist_input: bool = False) -> RunReport:
    """Run the plan (or the edited ``steps``), then, when a row ``key`` is given,
    feature engineering and (for supervised types) the baseline model; collect every finding."""
    # the input is re-read per step unless asked otherwise (caching a very large
    # table costs more than rescanning its parquet columns); the frequency table is cached
    df = nan_to_null(df)
    data = df.persist(StorageLevel.MEMORY_AND_DISK) if persist_input else df
    if target is not None and problem_type is None:
        prof = pr.semantic_types(pr.column_profile(data, stats=False))
        problem_type = pr.problem_types(prof).where(F.col("column") == target).first()["problem_type"]
    plan = edit_plan(steps) if steps is not None else build_plan(problem_type)
    freq = fq.frequency_table(data).persist(StorageLevel.MEMORY_AND_DISK)
    parts = [run_step(s, data, freq, target, numeric_limit).withColumn("order", F.lit(i))
             for i, s in enumerate(plan)]
    if key is not None:
        parts.append(_feature_findings(data, target, problem_type, key, overrides).withColumn("order", F.lit(len(plan))))
        parts.append(_baseline_findings(data, target, problem_type, key).withColumn("order", F.lit(len(plan) + 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("target", F.lit(target).cast("string")).withColumn(
        "problem_type", F.lit(problem_type).cast("string"))
    # findings are a few rows per step: materialise them, then release the cached input
    rows = out.collect()
    final = df.sparkSession.createDataFrame(rows, out.schema)
    freq.unpersist()
    if persist_input:
        data.unpersist()
    return RunReport(target, problem_type, plan, final)


def _feature_findings(df: DataFrame, target, problem_type, key, overrides) -> DataFrame:
    """F01-F12 summarised as bullets."""
    from tablelens.operators import features as fe
    order_col = None
    if problem_type == "time_series" and target:
        from tablelens.operators import series as se
        order_col = se.detect_date_column(df, target).first()["date_column"]
    s = fe.feature_engineering(df, target, "regression" if problem_type == "time_series" and order_col is None else problem_type,
                               key, overrides, order_col).summary.first()
    texts = []
    dropped = list(s["dropped_constant"]) + list(s["dropped_id_like"])
    if dropped:
        texts.append("Left out as constant or row names: " + ", ".join(f"'{c}'" for c in dropped) + ".")
    if s["excluded_high_cardinality"]:
        texts.append("Too many levels for one-hot columns: " + ", ".join(s["excluded_high_cardinality"])
                     + ". Encode them by frequency or by target mean.")
    texts.append(f"Numeric columns: {len(s['numeric_columns'])}, filled by {s['numeric_impute']}, scaled by {s['scaling']}. "
                 f"Categorical columns: {len(s['categorical_columns'])}, filled by {s['categorical_impute']}, one-hot. "
                 f"Features: {s['n_features_out']}.")
    if s["split_strategy"] != "none":
        texts.append(f"Split ({s['split_strategy']}): {s['train_rows']:,} rows to train on, {s['test_rows']:,} to test.")
    return fi.simple_findings("feature_engineering", texts)


def _baseline_findings(df: DataFrame, target, problem_type, key) -> DataFrame:
    """B01-B08 summarised as bullets."""
    from tablelens.operators import model as mo
    res = mo.baseline(df, target, problem_type, key)
    reason = res.summary.first()["skipped_reason"]
    if reason:
        return fi.simple_findings("baseline_model", [f"No baseline: {reason}."])
    m = res.metrics.first().asDict()
    metrics = ", ".join(f"{k}={v:.4f}" for k, v in m.items() if v is not None)
    top = [r["feature"] for r in res.importance.limit(3).collect()]  # top of a 10-row table
    texts = [f"Forest on the test rows ({problem_type}): {metrics}."]
    if top:
        texts.append("It relies most on " + ", ".join(top) + ".")
    return fi.simple_findings("baseline_model", texts)
