"""Generic analysis steps (G01-G15): overview, missing values, duplicates,
constant/ID-like columns, distributions and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import freq as fq
from tablelens.functions import moments as mo
from tablelens.functions.columns import dtype_name, family, numeric_columns, q
from tablelens.functions.duplicates import repeated_rows
from tablelens.functions.scan_moments import column_statistics
from tablelens.functions.fused import agg_one_row
from tablelens.operators import profile as pr

# Fixed values that must equal the reference's rules.
ID_LIKE_RATIO = 0.98        # ID-like: distinct (null counted) / rows strictly above this
UNIQUENESS_TOP = 15         # rows of the uniqueness table
SKEW_FLAG = 1.0             # |skew| above this is reported
SKEW_TOP = 3                # ... for the three largest
IQR_K = 1.5                 # Tukey fences
Z_K = 3.0                   # z-score threshold (population std)
MIN_OUTLIER_N = 5           # columns with fewer non-null values are skipped


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and the number of columns per dtype (one row per dtype)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[dtype_name(f.dataType)] = counts.get(dtype_name(f.dataType), 0) + 1
    spark = df.sparkSession
    types = spark.createDataFrame(list(counts.items()), "dtype string, column_count long")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return types.crossJoin(n).withColumn("n_columns", F.lit(len(df.columns)))  # k rows by one row


def describe_all(df: DataFrame, freq: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Count, unique, top, freq for non-numeric columns; count and moments for numeric ones."""
    freq = fq.frequency_table(df) if freq is None else freq
    miss = pr.missing(df).select("column", "position", (F.col("n_rows") - F.col("missing_count")).alias("count"))
    cats = [c for c in df.columns if family(df.schema[c].dataType) != "numeric"]
    catf = freq.where(F.col("column").isin(cats))
    top = (fq.top_values(catf, 1).select("column", F.col("value").alias("top"), F.col("n").alias("freq")))
    uniq = fq.distinct_summary(catf).select("column", F.col("unique_count").alias("unique"))
    stats = pr.numeric_stats(df, exact=exact).select("column", "mean", "std", "min", "q25", "q50", "q75", "max")
    return (miss.join(uniq, "column", "left").join(top, "column", "left").join(stats, "column", "left"))


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with missing values, worst first (ties in column order)."""
    return pr.missing(df).where(F.col("missing_count") > 0).select(
        "column", "position", "missing_count", "missing_pct")


def missing_summary(df: DataFrame) -> DataFrame:
    """Number of columns with missing values, missing cells, worst column and its pct."""
    m = pr.missing(df)
    worst = F.struct(F.col("missing_pct"), -F.col("position"), F.col("column"))
    return m.agg(
        F.count_if(F.col("missing_count") > 0).cast("long").alias("columns_with_missing"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).cast("long").alias("total_missing_cells"),
        F.max(worst).alias("w"),
        F.coalesce(F.max("missing_pct"), F.lit(0.0)).alias("worst_pct")).select(
        "columns_with_missing", "total_missing_cells",
        F.when(F.col("w.missing_pct") > 0, F.col("w.column")).alias("worst_column"), "worst_pct")


def missing_patterns(df: DataFrame) -> DataFrame:
    """G04 (re-aimed heat map): rows per pattern of missing cells, pattern = 0/1 per column."""
    flags = [F.when(mo.gone(df, c), F.lit("1")).otherwise(F.lit("0")) for c in df.columns]
    return (df.select(F.concat(*flags).alias("pattern"))
            .groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))


def duplicate_preview(df: DataFrame, limit: int = 20) -> DataFrame:
    """All members of duplicate groups, sorted by every column, first ``limit`` rows.

    Equal rows are identical, so the preview is built from the repeated rows (found by digest, see
    ``functions.duplicates``): the first ``limit`` groups in sort order (a bounded top-k, no global sort),
    each expanded to at most ``limit`` copies, then cut to ``limit`` rows.
    """
    cols = list(df.columns)
    groups = repeated_rows(df)
    order = [F.asc_nulls_first(q(c)) for c in cols]
    first = groups.orderBy(*order).limit(limit)
    expanded = first.select(*[q(c) for c in cols],
                            F.explode(F.sequence(F.lit(1), F.least(F.col("__n"), F.lit(limit)))).alias("__k"))
    return expanded.orderBy(*order, "__k").limit(limit).select(*[q(c) for c in cols])


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Duplicate rows and pct (same job as P05)."""
    return pr.duplicates(df).select("duplicate_rows", "duplicate_pct")


def constant_and_id(df: DataFrame, freq: DataFrame | None = None,
                    exclude: tuple[str, ...] = ()) -> DataFrame:
    """Constant (distinct with null <= 1) and ID-like (> 1 and ratio > 0.98) columns."""
    ds = fq.distinct_counts(df, [c for c in df.columns if c not in exclude]) if freq is None else fq.distinct_summary(freq)
    t = ds.withColumn("n", F.greatest(F.col("n_rows"), F.lit(1)))  # rows counted by the same table
    flag = (F.when(F.col("unique_with_null") <= 1, "constant")
            .when(F.col("unique_with_null") / F.col("n") > ID_LIKE_RATIO, "id_like"))
    out = t.select("column", "position", flag.alias("flag")).where(F.col("flag").isNotNull())
    if exclude:
        out = out.where(~F.col("column").isin(list(exclude)))
    return out


def uniqueness_table(df: DataFrame, freq: DataFrame | None = None, top: int = UNIQUENESS_TOP) -> DataFrame:
    """Distinct values (null counted) and ratio (3 decimals), the ``top`` highest ratios."""
    freq = fq.frequency_table(df) if freq is None else freq
    ds = fq.distinct_summary(freq)
    t = ds.withColumn("n", F.greatest(F.col("n_rows"), F.lit(1))).select("column", "position", F.col("unique_with_null").alias("unique_count"),
                               F.round(F.col("unique_with_null") / F.col("n"), 3).alias("unique_ratio"))
    w = Window.orderBy(F.desc("unique_ratio"), F.asc("position"))  # rows = number of columns
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def skew_kurtosis(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Corrected skew and kurtosis per numeric column, 3 decimals; empty columns skipped."""
    cols = numeric_columns(df) if cols is None else cols
    s = mo.numeric_stats(df, cols, quartiles=False)
    return s.where(F.col("n") > 0).select(
        "column", "position", F.round("skew", 3).alias("skew"), F.round("kurtosis", 3).alias("kurtosis"))


def skew_finding(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns with |skew| > 1, the three largest by |skew|."""
    s = skew_kurtosis(df, cols).where(F.abs("skew") > SKEW_FLAG)
    w = Window.orderBy(F.desc(F.abs("skew")), F.asc("position"))  # rows = number of columns
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SKEW_TOP)


def _long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), mo.present(q(c)).alias("x")) for c in cols]
    return df.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull())


def histogram(df: DataFrame, bins: int = 10, cols: list[str] | None = None) -> DataFrame:
    """Equal-width histogram per numeric column, all ``bins`` bins with zero counts kept.

    Pass 1: min/max per column (fused agg, one row). Pass 2: the long form is
    joined to that one-row-per-column range table (size = number of columns)
    and counted per (column, bin) with map-side partial aggregation.
    """
    cols = numeric_columns(df) if cols is None else cols
    one = df.agg(*[e for i, c in enumerate(cols) for e in
                   (F.min(mo.present(q(c))).alias(f"lo{i}"), F.max(mo.present(q(c))).alias(f"hi{i}"))])
    ranges = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                 F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(cols)])))
    ranges = ranges.where(F.col("lo").isNotNull())
    width = (F.col("hi") - F.col("lo")) / bins
    binned = (_long_numeric(df, cols).join(F.broadcast(ranges), "column")
              .select("column", F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
                  F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int").alias("bin")))
    counts = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = ranges.select("column", "position", "lo", "hi",
                         F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, ["column", "bin"], "left").select(
        "column", "position", "bin",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("lower"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return out


def top_values(df: DataFrame, k: int = 10, freq: DataFrame | None = None) -> DataFrame:
    """Top-10 values per non-numeric column."""
    return pr.top_values(df, k=k, freq=freq)


def fences(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Pass 1 of the outlier steps: one row with q1/median/q3, mean, population std and n per
    column (moments in one scan, quantiles in their own)."""
    cols = numeric_columns(df) if cols is None else cols
    st = column_statistics(df, cols)
    mom = df.sparkSession.createDataFrame([tuple(v for s in st for v in (s["mean"], s["std_pop"], s["n"]))], ", ".join(
        f"m{i} double, s{i} double, n{i} long" for i in range(len(cols))))
    return mom.crossJoin(mo.quantile_row(df, cols, (0.25, 0.5, 0.75), exact=exact))  # one row by one row


def outlier_table(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """G13-G15 in two passes over the data.

    Pass 1 (``fences``) gives one row of quartiles, mean, population std and n
    per column; it is read on the driver (one row) and the fences become
    literals of pass 2, a single codegen aggregate: IQR outliers (strict), z
    outliers (|x - mean| > 3 std_pop; none when std is 0) and the whiskers
    (min/max inside the fences).
    """
    cols = numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    schema = ("column string, position int, n long, q1 double, median double, q3 double, lower double, "
              "upper double, iqr_outliers long, iqr_outlier_pct double, z_score_outliers long, mean double, "
              "std_pop double, whisker_low double, whisker_high double")
    if not cols:
        return spark.createDataFrame([], schema)
    f1 = fences(df, cols, exact).first()  # one row
    groups, meta = [], []
    for i, c in enumerate(cols):
        qs = f1[f"q{i}"]
        n, m, s = f1[f"n{i}"], f1[f"m{i}"], f1[f"s{i}"]
        if not n or qs is None or qs[0] is None:
            continue
        q1, med, q3 = qs
        iqr = q3 - q1
        lo, hi = q1 - IQR_K * iqr, q3 + IQR_K * iqr
        x = mo.present(q(c))
        z = (F.abs(x - F.lit(m)) > F.lit(Z_K * s)) if (s is not None and s > 0) else F.lit(False)
        groups.append([F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"io{i}"),
                       F.count_if(z).alias(f"zo{i}"),
                       F.min(F.when(x >= F.lit(lo), x)).alias(f"wl{i}"),
                       F.max(F.when(x <= F.lit(hi), x)).alias(f"wh{i}")])
        meta.append((i, c, n, q1, med, q3, lo, hi, m, s))
    if not groups:
        return spark.createDataFrame([], schema)
    two = agg_one_row(df, groups, 4)
    rows = [F.struct(
        F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(n).cast("long").alias("n"),
        F.lit(q1).cast("double").alias("q1"), F.lit(med).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"), F.lit(lo).cast("double").alias("lower"),
        F.lit(hi).cast("double").alias("upper"), F.col(f"io{i}").cast("long").alias("iqr_outliers"),
        F.round(F.lit(100.0) * F.col(f"io{i}") / F.lit(n), 2).alias("iqr_outlier_pct"),
        F.col(f"zo{i}").cast("long").alias("z_score_outliers"), F.lit(m).cast("double").alias("mean"),
        F.lit(s).cast("double").alias("std_pop"), F.col(f"wl{i}").alias("whisker_low"),
        F.col(f"wh{i}").alias("whisker_high"))
        for (i, c, n, q1, med, q3, lo, hi, m, s) in meta]
    return two.select(F.inline(F.array(*rows))).where(F.col("n") >= MIN_OUTLIER_N)
