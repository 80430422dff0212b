"""Feature engineering (F01-F13) and the text-advised extras.

The fitted preprocessing is a ``pyspark.ml`` ``PipelineModel``: imputation and
scaling are ``SQLTransformer`` stages holding the values fitted on the train
rows (exact medians, modes, population std), categoricals go through
``StringIndexer(handleInvalid='keep')`` + ``OneHotEncoder(dropLast=True)`` so
every train level gets a column and unseen levels encode as all zeros, and a
``VectorAssembler`` builds the feature vector. The model saves and loads with
the standard ML writer (K03).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import freq as fq
from tablelens.functions import moments as mo
from tablelens.functions.columns import FLOAT_TYPES, family, nan_to_null, q
from tablelens.functions.sampling import SEED, flag_lowest_k, lowest_k, split_by_value, md5_key

# Fixed values that must equal the reference's rules.
ALLOWED_OVERRIDES = ("numeric_impute", "categorical_impute", "scaling", "high_cardinality_threshold",
                     "test_size", "drop_columns")
ID_LIKE_RATIO = 0.98
MIN_SPLIT_ROWS = 10
CLASSIFICATION = ("binary_classification", "multiclass_classification")


@dataclass
class FeatureSettings:
    """the only settings a user may override."""

    numeric_impute: str = "median"
    categorical_impute: str = "most_frequent"
    scaling: str = "standard"
    high_cardinality_threshold: int = 15
    test_size: float = 0.2
    drop_columns: list[str] = field(default_factory=list)

    @classmethod
    def from_overrides(cls, overrides: dict | None) -> "FeatureSettings":
        overrides = dict(overrides or {})
        unknown = sorted(set(overrides) - set(ALLOWED_OVERRIDES))
        if unknown:
            raise ValueError(f"unknown feature-engineering setting(s): {', '.join(unknown)}; "
                             f"allowed: {', '.join(ALLOWED_OVERRIDES)}")
        s = cls(**overrides)
        if s.numeric_impute not in ("median", "mean", "most_frequent"):
            raise ValueError(f"numeric_impute must be median, mean or most_frequent, not {s.numeric_impute!r}")
        if s.categorical_impute not in ("most_frequent",):
            raise ValueError(f"categorical_impute must be most_frequent, not {s.categorical_impute!r}")
        if s.scaling not in ("standard", "none"):
            raise ValueError(f"scaling must be standard or none, not {s.scaling!r}")
        if not (0.0 < float(s.test_size) < 1.0):
            raise ValueError("test_size must be between 0 and 1")
        if int(s.high_cardinality_threshold) < 1:
            raise ValueError("high_cardinality_threshold must be at least 1")
        return s


def drop_plan(df: DataFrame, target: str | None, extra: list[str] | tuple[str, ...] = (),
              freq: DataFrame | None = None) -> DataFrame:
    """columns to drop with the reason: constant, ID-like (not float), or user list.
    The target is never dropped by the first two rules."""
    freq = fq.frequency_table(df) if freq is None else freq
    ds = fq.distinct_summary(freq)
    n = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]
    t = ds.crossJoin(n)  # per-column rows by one row
    not_target = F.lit(True) if target is None else (F.col("column") != target)
    reason = (F.when(not_target & (F.col("unique_with_null") <= 1), "constant")
              .when(not_target & (F.col("unique_with_null") > 1) & (F.col("unique_with_null") / F.col("n") > ID_LIKE_RATIO)
                    & ~F.col("column").isin(floats or [""]), "id_like")
              .when(F.col("column").isin(list(extra) or [""]), "user"))
    return t.select("column", "position", reason.alias("reason")).where(F.col("reason").isNotNull())


def split_kinds(df: DataFrame, drop: list[str], target: str | None) -> tuple[list[str], list[str]]:
    """numeric = number dtypes (booleans excluded); everything else is categorical."""
    cols = [c for c in df.columns if c not in drop and c != target]
    num = [c for c in cols if family(df.schema[c].dataType) == "numeric"]
    cat = [c for c in cols if c not in num]
    return num, cat


def high_cardinality(df: DataFrame, cat_cols: list[str], threshold: int, freq: DataFrame | None = None) -> DataFrame:
    """categorical columns with more than ``threshold`` distinct non-null values."""
    if not cat_cols:
        return df.sparkSession.createDataFrame([], "column string, unique_count long, excluded boolean")
    freq = fq.frequency_table(df, cat_cols) if freq is None else freq.where(F.col("column").isin(cat_cols))
    ds = fq.distinct_summary(freq)
    return ds.select("column", "unique_count", (F.col("unique_count") > threshold).alias("excluded"))


def fit_fill_values(train: DataFrame, num_cols: list[str], cat_cols: list[str],
                    numeric_impute: str = "median") -> dict[str, object]:
    """Fill values fitted on the train rows.

    Numeric: exact median (bounded-memory quantiles, see ``moments.quantile_row``),
    mean, or most frequent (smallest on ties; counts per value, map-side combined). Categorical: most frequent with the smallest value on
    ties, read from the frequency table's top-1 (a partial top-k, no per-value
    map in one task).
    """
    out: dict[str, object] = {}
    if num_cols:
        if numeric_impute == "median":
            row = mo.quantile_row(train, num_cols, (0.5,)).first()  # one row
            for i, c in enumerate(num_cols):
                out[c] = row[f"q{i}"][0] if row[f"q{i}"] else None
        elif numeric_impute == "mean":
            row = train.agg(*[F.avg(mo.present(q(c))).alias(f"n{i}") for i, c in enumerate(num_cols)]).first()
            for i, c in enumerate(num_cols):
                out[c] = row[f"n{i}"]
        else:
            cells = F.array(*[F.struct(F.lit(i).alias("i"), mo.present(q(c)).alias("x")) for i, c in enumerate(num_cols)])
            counts = train.select(F.inline(cells)).where("x is not null").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
            best = counts.groupBy("i").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("x"))
            found = {r["i"]: r["x"] for r in best.collect()}  # one row per column
            for i, c in enumerate(num_cols):
                out[c] = found.get(i)
    if cat_cols:
        casted = train.select(*[q(c).cast("string").alias(c) for c in cat_cols])
        top = fq.top_values(fq.frequency_table(casted, cat_cols), 1).select("column", "value").collect()  # <= 1 per column
        found = {r["column"]: r["value"] for r in top}
        for c in cat_cols:
            out[c] = found.get(c)
    return out


def fit_scaling(train: DataFrame, num_cols: list[str], fills: dict[str, object]) -> dict[str, tuple[float, float]]:
    """mean and population std (ddof 0) after imputation, fitted on the train rows."""
    if not num_cols:
        return {}
    exprs = []
    for i, c in enumerate(num_cols):
        x = F.coalesce(mo.present(q(c)), F.lit(fills.get(c)).cast("double"))
        exprs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = train.agg(*exprs).first()  # one row
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(num_cols)}


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v))


def build_preprocessor(train: DataFrame, num_cols: list[str], cat_cols: list[str],
                       settings: FeatureSettings) -> PipelineModel:
    """fit the preprocessing pipeline on the train rows only."""
    fills = fit_fill_values(train, num_cols, cat_cols, settings.numeric_impute)
    scale = fit_scaling(train, num_cols, fills) if settings.scaling == "standard" else {}
    sel = ["*"]
    num_out = []
    for c in num_cols:
        x = f"coalesce(CAST(`{c}` AS DOUBLE), CAST({_sql_literal(fills.get(c))} AS DOUBLE))"
        if c in scale:
            m, s = scale[c]
            x = f"(({x}) - {m!r}) / {s if s > 0 else 1.0!r}"
        sel.append(f"{x} AS `{c}__num`")
        num_out.append(f"{c}__num")
    cat_in = []
    for c in cat_cols:
        sel.append(f"coalesce(CAST(`{c}` AS STRING), {_sql_literal(fills.get(c))}) AS `{c}__cat`")
        cat_in.append(f"{c}__cat")
    stages = [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")]
    idx_out = [f"{c}__idx" for c in cat_cols]
    ohe_out = [f"{c}__ohe" for c in cat_cols]
    if cat_cols:
        stages.append(StringIndexer(inputCols=cat_in, outputCols=idx_out, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx_out, outputCols=ohe_out, dropLast=True))
    stages.append(VectorAssembler(inputCols=num_out + ohe_out, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(train)


def feature_names(transformed: DataFrame, col: str = "features") -> list[str]:
    """Encoded feature names from the vector metadata (numeric, then one-hot levels)."""
    meta = transformed.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    names = [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]
    return [n.replace("__num", "").replace("__ohe", "").replace("__cat", "") for n in names]


def stratified_split(df: DataFrame, target: str, key: str, test_size: float = 0.2,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """per class, the round(test_size * n_class) rows with the smallest md5(seed:key) are test.

    Exact and without sorting a whole class (see ``functions.sampling.lowest_k``).
    """
    k = md5_key(seed, F.col(f"`{key}`"))
    tagged = df.withColumn("__cls", F.coalesce(q(target).cast("string"), F.lit("\u0000null")))
    flagged = flag_lowest_k(tagged, k, lambda n: F.round(n * F.lit(float(test_size))), ["__cls"]).drop("__cls")
    return flagged.where(~F.col("__sel")).drop("__sel"), flagged.where(F.col("__sel")).drop("__sel")


def random_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """the round(test_size * n) rows with the smallest md5(seed:key) are test."""
    k = md5_key(seed, F.col(f"`{key}`"))
    flagged = flag_lowest_k(df, k, lambda n: F.round(n * F.lit(float(test_size))))
    return flagged.where(~F.col("__sel")).drop("__sel"), flagged.where(F.col("__sel")).drop("__sel")


def time_split(df: DataFrame, order_col: str, test_size: float = 0.2,
               tiebreak: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first int(n (1 - test_size)) rows by ``order_col`` (then ``tiebreak``)
    train, the rest test."""
    n = df.count()
    k = int(n * (1 - test_size))
    order = q(order_col)
    dt = df.schema[order_col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        order = F.unix_micros(q(order_col).cast("timestamp"))
    return split_by_value(df, order, k, tiebreak=tiebreak)


def can_stratify(df: DataFrame, target: str) -> bool:
    """Every class has at least 2 rows."""
    row = df.groupBy(q(target)).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).first()
    return row["m"] is not None and row["m"] >= 2


@dataclass
class FeatureResult:
    summary: DataFrame
    dropped: DataFrame
    excluded: DataFrame
    model: PipelineModel | None
    train: DataFrame
    test: DataFrame | None


def feature_engineering(df: DataFrame, target: str | None, problem_type: str | None, key: str,
                        overrides: dict | None = None, order_col: str | None = None) -> FeatureResult:
    """F01-F12 end to end; returns the fitted pipeline and a one-row summary."""
    s = FeatureSettings.from_overrides(overrides)
    spark = df.sparkSession
    df = nan_to_null(df)
    freq = fq.frequency_table(df)
    drops = drop_plan(df, target, s.drop_columns, freq)
    drop_rows = drops.collect()  # one row per dropped column
    drop_cols = [r["column"] for r in drop_rows]
    num, cat_all = split_kinds(df, drop_cols, target)
    hc = high_cardinality(df, cat_all, s.high_cardinality_threshold, freq)
    excluded = [r["column"] for r in hc.where("excluded").collect()]  # <= number of columns
    cat = [c for c in cat_all if c not in excluded]
    n = df.count()
    strategy = "none"
    train, test = df, None
    if target is not None and n >= MIN_SPLIT_ROWS and (num or cat):
        if problem_type == "time_series":
            if order_col is None:
                raise ValueError("a time-ordered split needs an order column")
            train, test = time_split(df, order_col, s.test_size)
            strategy = "time_ordered"
        elif problem_type in CLASSIFICATION and can_stratify(df, target):
            train, test = stratified_split(df, target, key, s.test_size)
            strategy = "stratified"
        else:
            train, test = random_split(df, key, s.test_size)
            strategy = "random"
    model = build_preprocessor(train, num, cat, s) if (num or cat) else None
    n_out = 0
    if model is not None:
        n_out = len(feature_names(model.transform(train.limit(0))))
    train_rows = train.count()
    test_rows = test.count() if test is not None else 0
    summary = spark.createDataFrame(
        [(target, [r["column"] for r in drop_rows if r["reason"] == "constant"],
          [r["column"] for r in drop_rows if r["reason"] == "id_like"], excluded, num, cat,
          s.numeric_impute, s.categorical_impute, s.scaling, strategy, int(train_rows), int(test_rows), int(n_out))],
        "target string, dropped_constant array<string>, dropped_id_like array<string>, "
        "excluded_high_cardinality array<string>, numeric_columns array<string>, categorical_columns array<string>, "
        "numeric_impute string, categorical_impute string, scaling string, split_strategy string, "
        "train_rows long, test_rows long, n_features_out long")
    return FeatureResult(summary, drops, hc, model, train, test)


# ----------------------------------------------------------------------------- V01 - V04

def yeo_johnson(x, lam: float):
    """Yeo-Johnson transform with a given lambda (expression)."""
    pos = x >= 0
    if abs(lam) < 1e-12:
        a = F.log1p(x)
    else:
        a = (F.pow(x + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        b = -F.log1p(-x)
    else:
        b = -(F.pow(-x + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(pos, a).otherwise(b)


def log_transform(x):
    """Natural log (for a strictly positive skewed column)."""
    return F.log(x)


def undersample(df: DataFrame, target: str, key: str, seed: int = SEED) -> DataFrame:
    """Keep, per class, the minority-class count of rows with the smallest md5(seed:key)."""
    counts = df.groupBy(q(target).alias("__cls")).agg(F.count(F.lit(1)).alias("n"))
    m = counts.agg(F.min("n")).first()[0]  # one number
    tagged = df.withColumn("__cls", q(target))
    return lowest_k(tagged, md5_key(seed, F.col(f"`{key}`")), lambda n: F.least(n, F.lit(m)), ["__cls"]).drop("__cls")


def frequency_encode(df: DataFrame, col: str) -> DataFrame:
    """Add ``<col>_freq`` = share of rows holding the value (null rows get the null share)."""
    n = df.count()
    counts = df.groupBy(q(col).alias("__v")).agg((F.count(F.lit(1)) / F.lit(float(n))).alias(f"{col}_freq"))
    return df.join(counts, df[col].eqNullSafe(counts["__v"]), "left").drop("__v")


def target_encode(df: DataFrame, col: str, target: str) -> DataFrame:
    """Add ``<col>_target_mean`` = mean of the target per level (no smoothing)."""
    means = df.groupBy(q(col).alias("__v")).agg(F.avg(mo.present(q(target))).alias(f"{col}_target_mean"))
    return df.join(means, df[col].eqNullSafe(means["__v"]), "left").drop("__v")
