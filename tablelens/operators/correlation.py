"""Association steps (G16-G20) and the contingency machinery shared with C04.

* Pearson: one scan that keeps a mergeable Gramian per task (``functions.gram``);
  zero variance and non-finite moments give null, NaN cells are missing.
* Spearman: average ranks from distinct values. Each column is reduced to
  ``(value, count)``; values are placed in equal-count buckets by an
  approximate-quantile sketch so the running count is a window over one
  bucket (bounded), and bucket offsets come from a table of ``buckets`` rows.
* Contingency tables: one grouped count over all column pairs, map-side
  combined. Chi-square uses  chi2 = sum_{O>0} O^2 / E - n , so cells with zero
  count never have to be materialised; the Yates correction (2 x 2 only) is
  the closed form  n^3 * max(0, |O - E| - 0.5)^2 / (r1 r2 c1 c2).
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import as_text, q
from tablelens.functions.dist import chi2_pvalue
from tablelens.functions.gram import gram
from tablelens.functions.moments import complete, present


def _value(x: float) -> float | None:
    return None if np.isnan(x) else float(x)


def pearson_pairs(df: DataFrame, cols: list[str], complete_rows: bool = True) -> DataFrame:
    """Long form ``(col_a, pos_a, col_b, pos_b, r, n)`` for every ordered pair incl. the diagonal.

    ``complete_rows`` drops rows with a missing cell (null or NaN) in any chosen column first (the
    correlation step); otherwise each pair uses the rows where both are present. r is null where a
    column has no spread or a moment is not finite. One scan (see ``functions.gram``).
    """
    g = gram(df, cols, complete_rows=complete_rows)
    r = g.correlation()
    rows = [(a, i, b, j, (1.0 if not np.isnan(r[i, i]) else None) if i == j else _value(r[i, j]), int(g.n[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, pos_a int, col_b string, pos_b int, r double, n long")


def pairs_with_target(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``(column, position, r, n)``: Pearson of each feature with the target on the rows where
    both are present. Only feature x target pairs are aggregated."""
    g = gram(df, features, [target])
    r = g.correlation()
    rows = [(c, i, _value(r[i, 0]), int(g.n[i, 0])) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, r double, n long")


BUCKET_VALUES = 200_000     # distinct values per rank bucket (one window task each)


def average_ranks(df: DataFrame, col: str, buckets: int | None = None, accuracy: int | None = None,
                  ndv: int | None = None) -> DataFrame:
    """``(value, avg_rank)`` for the non-null values of one column (ties get the mean rank).

    Distributed prefix sums: distinct values with counts, bucketed by an
    approximate-quantile sketch; a window runs inside each bucket only. The
    bucket count comes from a HyperLogLog estimate of the distinct values
    (about ``BUCKET_VALUES`` per bucket, at least 8), so no bucket grows with
    the data; the offsets table has one row per bucket.
    """
    x = present(q(col))
    vt = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    if buckets is None:
        if ndv is None:
            ndv = df.agg(F.approx_count_distinct(x)).first()[0] or 0  # one number
        buckets = max(8, -(-ndv // BUCKET_VALUES))
    accuracy = accuracy or max(10000, 8 * buckets)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = vt.agg(F.percentile_approx("v", probs, accuracy).alias("bounds"))
    tagged = vt.crossJoin(F.broadcast(bounds)).select(  # one-row side
        "v", "cnt", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("bucket"))
    w_in = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("cum_in", F.sum("cnt").over(w_in))
    totals = tagged.groupBy("bucket").agg(F.sum("cnt").alias("tot"))
    w_b = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    offsets = totals.withColumn("offset", F.coalesce(F.sum("tot").over(w_b), F.lit(0))).select("bucket", "offset")
    ranked = tagged.join(F.broadcast(offsets), "bucket")  # offsets has <= buckets rows
    return ranked.select("v", (F.col("offset") + F.col("cum_in") - F.col("cnt")
                               + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))


def spearman_pairs(df: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """Spearman matrix on complete rows: Pearson on average ranks."""
    data = complete(df.select(*[present(q(c)).alias(c) for c in cols]))
    est = data.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()  # one row
    ranked = data
    for i, c in enumerate(cols):
        rk = average_ranks(data, c, buckets, ndv=est[f"d{i}"] or 0).withColumnRenamed("v", f"__v_{c}").withColumnRenamed(
            "avg_rank", f"__r_{c}")
        ranked = ranked.join(rk, ranked[c] == rk[f"__v_{c}"])
    ranked = ranked.select(*[F.col(f"__r_{c}").alias(c) for c in cols])
    return pearson_pairs(ranked, cols, complete_rows=True)


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """Arg max |r| off the diagonal, signed value; first pair in column order on ties."""
    off = pairs.where((F.col("pos_a") < F.col("pos_b")) & F.col("r").isNotNull())
    key = F.struct(F.abs("r").alias("a"), (-F.col("pos_a")).alias("pa"), (-F.col("pos_b")).alias("pb"))
    best = off.agg(F.max_by(F.struct("col_a", "col_b", "r"), key).alias("b"))
    return best.where(F.col("b").isNotNull()).select(
        F.col("b.col_a").alias("col_a"), F.col("b.col_b").alias("col_b"), F.round("b.r", 3).alias("r"))


def vif_from_pairs(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """VIF_i = [R^-1]_ii, the inverse of the k x k correlation matrix (driver, k small)."""
    spark = pairs.sparkSession
    k = len(cols)
    mat = np.eye(k)
    for row in pairs.select("pos_a", "pos_b", "r").collect():  # k*k rows
        if row["r"] is not None:
            mat[row["pos_a"], row["pos_b"]] = row["r"]
        elif row["pos_a"] != row["pos_b"]:
            mat[row["pos_a"], row["pos_b"]] = 0.0
    try:
        inv = np.linalg.inv(mat)
        vif = [float(inv[i, i]) for i in range(k)]
    except np.linalg.LinAlgError:
        vif = [float("inf")] * k
    return spark.createDataFrame([(c, i, v) for i, (c, v) in enumerate(zip(cols, vif))],
                                 "column string, position int, vif double")


def contingency_stats(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per pair of columns: n, rows r, columns k, chi2 (Yates on 2 x 2), dof, Cramer's V.

    Nulls are dropped per pair (as a cross-tabulation does).
    """
    cells = [F.struct(F.lit(i).alias("pair"), as_text(df, a).alias("va"), as_text(df, b).alias("vb"))
             for i, (a, b) in enumerate(pairs)]
    obs = (df.select(F.inline(F.array(*cells)))
           .where(F.col("va").isNotNull() & F.col("vb").isNotNull())
           .groupBy("pair", "va", "vb").agg(F.count(F.lit(1)).alias("o")))
    rowm = obs.groupBy("pair", "va").agg(F.sum("o").alias("ri"))
    colm = obs.groupBy("pair", "vb").agg(F.sum("o").alias("cj"))
    tot = rowm.groupBy("pair").agg(F.sum("ri").alias("n"), F.count(F.lit(1)).alias("r"),
                                   F.min("ri").alias("r_min"), F.max("ri").alias("r_max"))
    ctot = colm.groupBy("pair").agg(F.count(F.lit(1)).alias("k"), F.min("cj").alias("c_min"),
                                    F.max("cj").alias("c_max"))
    cell = (obs.join(rowm, ["pair", "va"]).join(colm, ["pair", "vb"]).join(tot.select("pair", "n"), "pair")
            .withColumn("e", F.col("ri").cast("double") * F.col("cj") / F.col("n")))
    per = cell.groupBy("pair").agg(F.sum(F.col("o").cast("double") * F.col("o") / F.col("e")).alias("s"),
                                   F.max(F.abs(F.col("o") - F.col("e"))).alias("dev"))
    out = per.join(tot, "pair").join(ctot, "pair")
    n = F.col("n").cast("double")
    # margins as doubles: the product of four longs leaves the long range from about 110,000 rows
    yates = (F.pow(n, 3) * F.pow(F.greatest(F.lit(0.0), F.col("dev") - 0.5), 2)
             / (F.col("r_min").cast("double") * F.col("r_max") * F.col("c_min") * F.col("c_max")))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(
        F.greatest(F.lit(0.0), F.col("s") - n))
    names = F.create_map(*[x for i, (a, b) in enumerate(pairs)
                           for x in (F.lit(i), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    res = out.select("pair", names[F.col("pair")]["a"].alias("col_a"), names[F.col("pair")]["b"].alias("col_b"),
                     F.col("n").cast("long").alias("n"), F.col("r").cast("long").alias("r"),
                     F.col("k").cast("long").alias("k"), chi2.alias("chi2"),
                     ((F.col("r") - 1) * (F.col("k") - 1)).cast("long").alias("dof"))
    denom = F.greatest(F.least(F.col("r") - 1, F.col("k") - 1), F.lit(1))
    return res.withColumn("cramers_v", F.when(F.col("n") > 0, F.sqrt(F.col("chi2") / F.col("n") / denom))
                          .otherwise(F.lit(0.0)))


def cramers_v_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cramer's V for every ordered pair of categorical columns, 1.0 on the diagonal."""
    pairs = list(itertools.combinations(cols, 2))
    spark = df.sparkSession
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, cramers_v double")
    if not pairs:
        return diag
    st = contingency_stats(df, pairs).select("col_a", "col_b", "cramers_v")
    mirrored = st.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "cramers_v")
    return diag.unionByName(st).unionByName(mirrored)


def chi_square_tests(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Chi-square of each feature against the target; tables smaller than 2 x 2 skipped."""
    if not features:
        return df.sparkSession.createDataFrame(
            [], "column string, chi2 double, dof long, p_value double")
    st = contingency_stats(df, [(f, target) for f in features])
    st = st.where((F.col("r") >= 2) & (F.col("k") >= 2))
    return st.select(F.col("col_a").alias("column"), "chi2", "dof",
                     chi2_pvalue(F.col("chi2"), F.col("dof")).alias("p_value"))
