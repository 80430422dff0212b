"""Registered association and target-aware queries."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tablelens.operators import correlation as co
from tablelens.operators import target as tg
from tablelens.plans import fixtures as fx
from tablelens.plans.catalog import register
from tablelens.plans.q_profile import DL, LX
from tablelens.plans.sqlgen import qn

LN = fx.LN_COLUMNS
LN_SQL_COMPLETE = "lc AS (SELECT {} FROM lx WHERE {})".format(
    ", ".join(LN), " AND ".join(f"{c} IS NOT NULL" for c in LN))


def lx_num(spark, sf):
    return fx.lineitem_x(spark, sf).select(*LN)


def _pearson_sql(src: str, cols: list[str], rank: bool = False) -> str:
    parts = []
    for (i, a), (j, b) in itertools.product(enumerate(cols), repeat=2):
        if i == j:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"CASE WHEN stddev_samp({qn(a)}) > 0 THEN 1.0 END AS r FROM {src}")
        else:
            parts.append(f"SELECT '{a}', '{b}', round(corr({qn(a)}, {qn(b)}), 6) FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("g16_pearson", f"WITH {LX}, {LN_SQL_COMPLETE}\n" + _pearson_sql("lc", LN))
def g16_pearson(spark, sf):
    p = co.pearson_pairs(lx_num(spark, sf), LN)
    return p.select("col_a", "col_b", F.round("r", 6).alias("r"))


def _rank_cte(src: str, cols: list[str]) -> str:
    return "rk AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {qn(c)}) + (count(*) OVER (PARTITION BY {qn(c)}) - 1) / 2.0 AS {qn(c)}"
        for c in cols) + f" FROM {src})"


@register("g17_spearman", f"WITH {LX}, {LN_SQL_COMPLETE}, {_rank_cte('lc', LN)}\n" + _pearson_sql("rk", LN))
def g17_spearman(spark, sf):
    p = co.spearman_pairs(lx_num(spark, sf), LN)
    return p.select("col_a", "col_b", F.round("r", 6).alias("r"))


@register("g18_strongest_pair", f"WITH {LX}, {LN_SQL_COMPLETE},\n" + "p AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS pa, {j} AS pb, corr({qn(a)}, {qn(b)}) AS r FROM lc"
    for (i, a), (j, b) in itertools.combinations(enumerate(LN), 2)) + ")\n"
          "SELECT col_a, col_b, round(r, 3) AS r FROM p ORDER BY abs(r) DESC, pa, pb LIMIT 1")
def g18_strongest_pair(spark, sf):
    return co.strongest_pair(co.pearson_pairs(lx_num(spark, sf), LN))


_VIF2 = ["l_quantity", "l_extendedprice"]


@register("g19_vif", f"WITH {LX}, c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lx "
          "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)\n"
          "SELECT 'l_quantity' AS \"column\", round(1 / (1 - r * r), 6) AS vif FROM c UNION ALL "
          "SELECT 'l_extendedprice', round(1 / (1 - r * r), 6) FROM c")
def g19_vif(spark, sf):
    df = fx.lineitem_x(spark, sf).select(*_VIF2)
    v = co.vif_from_pairs(co.pearson_pairs(df, _VIF2), _VIF2)
    return v.select("column", F.round("vif", 6).alias("vif"))


@register("g19_vif_all")
def g19_vif_all(spark, sf):
    v = co.vif_from_pairs(co.pearson_pairs(lx_num(spark, sf), LN), LN)
    return v.withColumn("high_vif", F.col("vif") > 10)


DL_CATS = ["lang", "source", "quality", "toxic"]


def _contingency_sql(src: str, pairs: list[tuple[str, str]]) -> str:
    obs = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({qn(a)} AS VARCHAR) AS va, CAST({qn(b)} AS VARCHAR) AS vb, "
        f"count(*) AS o FROM {src} WHERE {qn(a)} IS NOT NULL AND {qn(b)} IS NOT NULL GROUP BY 3, 4"
        for a, b in pairs)
    return (f"obs AS ({obs}),\n"
            "rm AS (SELECT col_a, col_b, va, sum(o) AS ri FROM obs GROUP BY ALL),\n"
            "cm AS (SELECT col_a, col_b, vb, sum(o) AS cj FROM obs GROUP BY ALL),\n"
            "tt AS (SELECT col_a, col_b, sum(o) AS n, count(DISTINCT va) AS r, count(DISTINCT vb) AS k "
            "FROM obs GROUP BY ALL),\n"
            "cells AS (SELECT rm.col_a, rm.col_b, rm.va, cm.vb, ri * cj / n AS e, coalesce(obs.o, 0) AS o, r, k, n "
            "FROM rm JOIN cm ON rm.col_a = cm.col_a AND rm.col_b = cm.col_b "
            "JOIN tt ON rm.col_a = tt.col_a AND rm.col_b = tt.col_b "
            "LEFT JOIN obs ON obs.col_a = rm.col_a AND obs.col_b = rm.col_b AND obs.va = rm.va AND obs.vb = cm.vb),\n"
            "chi AS (SELECT col_a, col_b, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k, "
            "sum(pow(abs(o - e) - CASE WHEN r = 2 AND k = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2 "
            "FROM cells GROUP BY col_a, col_b)\n")


_G20_PAIRS = list(itertools.combinations(DL_CATS, 2))


@register("g20_cramers_v", f"WITH {DL}, " + _contingency_sql("dl", _G20_PAIRS) +
          "SELECT col_a, col_b, round(sqrt(chi2 / n / greatest(least(r - 1, k - 1), 1)), 6) AS cramers_v FROM chi "
          "UNION ALL SELECT col_b, col_a, round(sqrt(chi2 / n / greatest(least(r - 1, k - 1), 1)), 6) FROM chi "
          "UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in DL_CATS))
def g20_cramers_v(spark, sf):
    m = co.cramers_v_matrix(fx.documents_labels(spark, sf), DL_CATS)
    return m.select("col_a", "col_b", F.round("cramers_v", 6).alias("cramers_v"))


@register("c01_class_balance", f"WITH {DL}\nSELECT CAST(quality AS VARCHAR) AS class, count(*) AS count, "
          "round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM dl GROUP BY 1")
def c01_class_balance(spark, sf):
    return tg.class_balance(fx.documents_labels(spark, sf), "quality")


@register("c02_imbalance", f"WITH {DL}, cb AS (SELECT coalesce(CAST(quality AS VARCHAR), 'None') AS c, "
          "count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM dl GROUP BY 1)\n"
          "SELECT arg_min(c, (-n, c)) AS majority_class, arg_min(c, (n, c)) AS minority_class, "
          "max(n) AS majority_count, min(n) AS minority_count, min(pct) AS minority_pct, count(*) AS n_classes, "
          "round(max(n) / min(n), 2) AS imbalance_ratio, CASE WHEN round(max(n) / min(n), 2) >= 10 THEN 'severe' "
          "WHEN round(max(n) / min(n), 2) >= 3 THEN 'moderate' ELSE 'none' END AS severity FROM cb")
def c02_imbalance(spark, sf):
    return tg.imbalance(fx.documents_labels(spark, sf), "quality")


DL_NUM = ["doc_id", "n_chars", "toxic"]


def _anova_sql(src: str, target: str, feats: list[str]) -> str:
    g = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {i} AS position, CAST({qn(target)} AS VARCHAR) AS y, count(*) AS n, "
        f"avg(CAST({qn(c)} AS DOUBLE)) AS m, var_samp(CAST({qn(c)} AS DOUBLE)) AS v FROM {src} "
        f"WHERE {qn(c)} IS NOT NULL AND {qn(target)} IS NOT NULL GROUP BY 3" for i, c in enumerate(feats))
    return (f"g0 AS ({g}),\n"
            "g AS (SELECT * FROM g0 WHERE n > 1 AND feature IN (SELECT feature FROM g0 GROUP BY 1 HAVING count(*) >= 2)),\n"
            "t AS (SELECT feature, position, sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g GROUP BY ALL),\n"
            "a AS (SELECT g.feature, t.position, t.nn, t.k, sum(g.n * pow(g.m - t.gm, 2)) AS ssb, "
            "sum((g.n - 1) * g.v) AS ssw FROM g JOIN t ON g.feature = t.feature GROUP BY ALL),\n"
            "f AS (SELECT feature AS \"column\", position, CASE WHEN ssw > 0 THEN (ssb / (k - 1)) / (ssw / (nn - k)) END AS f "
            "FROM a WHERE k >= 2)\n")


@register("c03_anova_f", f"WITH {DL}, " + _anova_sql("dl", "quality", DL_NUM) +
          "SELECT \"column\", position, round(f, 3) AS f_stat FROM f WHERE f IS NOT NULL")
def c03_anova_f(spark, sf):
    return tg.anova(fx.documents_labels(spark, sf), "quality", DL_NUM).select("column", "position", "f_stat")


@register("c03_anova")
def c03_anova(spark, sf):
    return tg.anova(fx.documents_labels(spark, sf), "quality", DL_NUM)


_C04_FEATS = ["lang", "source", "toxic"]


@register("c04_chi_square_stat", f"WITH {DL}, " + _contingency_sql("dl", [(c, "quality") for c in _C04_FEATS]) +
          "SELECT col_a AS \"column\", round(chi2, 3) AS chi2, CAST((r - 1) * (k - 1) AS BIGINT) AS dof FROM chi "
          "WHERE r >= 2 AND k >= 2")
def c04_chi_square_stat(spark, sf):
    t = co.chi_square_tests(fx.documents_labels(spark, sf), "quality", _C04_FEATS)
    return t.select("column", F.round("chi2", 3).alias("chi2"), "dof")


@register("c04_chi_square")
def c04_chi_square(spark, sf):
    return tg.chi_square(fx.documents_labels(spark, sf), "quality", _C04_FEATS)


def _mi_sql(src: str, target: str, feats: list[str], bin_target: bool, bins: int = 10) -> str:
    probs = "[" + ", ".join(str(i / bins) for i in range(1, bins)) + "]"
    meds = ", ".join(f"median(CAST({qn(c)} AS DOUBLE)) AS m{i}" for i, c in enumerate(feats))
    filled = ", ".join(f"coalesce(CAST({qn(c)} AS DOUBLE), m{i}) AS {qn(c)}" for i, c in enumerate(feats))
    edges = ", ".join(f"quantile_cont({qn(c)}, {probs}) AS e{i}" for i, c in enumerate(feats))
    y = f"CAST({qn(target)} AS VARCHAR)"
    if bin_target:
        edges += f", quantile_cont(CAST({qn(target)} AS DOUBLE), {probs}) AS ey"
        y = f"CAST(len(list_filter(ey, lambda e: e < CAST({qn(target)} AS DOUBLE))) AS VARCHAR)"
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, len(list_filter(e{i}, lambda e: e < {qn(c)})) AS b, {y} AS y FROM fl, ed"
        for i, c in enumerate(feats))
    return (f"base AS (SELECT * FROM {src} WHERE {qn(target)} IS NOT NULL),\n"
            f"md AS (SELECT {meds} FROM base),\n"
            f"fl AS (SELECT {filled}, {qn(target)} FROM base, md),\n"
            f"ed AS (SELECT {edges} FROM fl),\n"
            f"lg AS ({long}),\n"
            "j AS (SELECT feature, b, y, count(*) AS nby FROM lg GROUP BY ALL),\n"
            "pb AS (SELECT feature, b, sum(nby) AS nb FROM j GROUP BY ALL),\n"
            "py AS (SELECT feature, y, sum(nby) AS ny FROM j GROUP BY ALL),\n"
            "nn AS (SELECT feature, sum(nby) AS n FROM j GROUP BY ALL)\n"
            "SELECT j.feature AS \"column\", round(greatest(0.0, sum((nby / n) * ln(nby * n / (nb * ny)))), 6) AS mutual_info "
            "FROM j JOIN pb USING (feature, b) JOIN py USING (feature, y) JOIN nn USING (feature) GROUP BY 1")


@register("c05_mutual_info", f"WITH {DL}, " + _mi_sql("dl", "quality", DL_NUM, False))
def c05_mutual_info(spark, sf):
    m = tg.binned_mi(fx.documents_labels(spark, sf), "quality", DL_NUM)
    return m.select("column", F.round("mutual_info", 6).alias("mutual_info"))


@register("c06_boxplot_by_class", f"WITH {DL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(quality AS VARCHAR) AS class, count(*) AS n, round(min(CAST({c} AS DOUBLE)), 6) AS min, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, round(max(CAST({c} AS DOUBLE)), 6) AS max "
    f"FROM dl WHERE {c} IS NOT NULL AND quality IS NOT NULL GROUP BY 2" for c in DL_NUM))
def c06_boxplot_by_class(spark, sf):
    df = fx.documents_labels(spark, sf)
    top = [r["column"] for r in tg.top_anova_features(tg.anova(df, "quality", DL_NUM)).collect()]  # <= 3 names
    b = tg.boxplot_by_class(df, "quality", top)
    return b.select("column", "class", "n", *[F.round(c, 6).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@register("c07_significant_features")
def c07_significant_features(spark, sf):
    df = fx.documents_labels(spark, sf)
    return tg.significant_features(tg.anova(df, "quality", DL_NUM),
                                   tg.chi_square(df, "quality", _C04_FEATS),
                                   tg.binned_mi(df, "quality", DL_NUM))


@register("r01_target_transform", "SELECT 'value' AS target, round(CASE WHEN count(value) < 3 THEN 0.0 "
          "WHEN var_pop(value) = 0 THEN 0.0 ELSE skewness(value) END, 3) AS skew, min(value) AS min, "
          "CASE WHEN abs(skewness(value)) <= 1 THEN NULL WHEN min(value) > 0 THEN 'log' WHEN min(value) >= 0 "
          "THEN 'Yeo-Johnson, or Box-Cox on values moved above zero' ELSE 'Yeo-Johnson' END "
          "AS suggested_transform FROM events")
def r01_target_transform(spark, sf):
    return tg.target_transform(fx.read_table(spark, sf, "events"), "value")


R_FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
R_TOP_SQL = ("tc AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, round(corr({c}, l_extendedprice), 4) AS r, "
    f"count(*) FILTER (WHERE {c} IS NOT NULL) AS n FROM lx" for i, c in enumerate(R_FEATS)) + "),\n"
             "top AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, position) AS rank FROM tc "
             "WHERE n > 5 AND r IS NOT NULL QUALIFY rank <= 3)\n")


@register("r02_top_correlated", f"WITH {LX}, " + R_TOP_SQL + "SELECT \"column\", r, rank FROM top")
def r02_top_correlated(spark, sf):
    t = tg.top_correlated(fx.lineitem_x(spark, sf), "l_extendedprice", R_FEATS)
    return t.select("column", "r", F.col("rank").cast("long").alias("rank"))


def _top_features(spark, sf):
    t = tg.top_correlated(fx.lineitem_x(spark, sf), "l_extendedprice", R_FEATS)
    return [r["column"] for r in t.orderBy("rank").collect()]  # <= 3 names


def _scatter_sql() -> str:
    parts = []
    for c in R_FEATS:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(CASE WHEN mx.hx{c} = mx.lx{c} THEN 0 ELSE least(floor(({c} - mx.lx{c}) / ((mx.hx{c} - mx.lx{c}) / 20)), 19) END AS INTEGER) AS bin_x, "
            f"CAST(CASE WHEN mx.hy = mx.ly THEN 0 ELSE least(floor((l_extendedprice - mx.ly) / ((mx.hy - mx.ly) / 20)), 19) END AS INTEGER) AS bin_y "
            f"FROM lx, mx WHERE '{c}' IN (SELECT \"column\" FROM top)")
    rng = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lx{c}, max(CAST({c} AS DOUBLE)) AS hx{c}" for c in R_FEATS)
    return (f"WITH {LX}, " + R_TOP_SQL + f", mx AS (SELECT {rng}, min(l_extendedprice) AS ly, max(l_extendedprice) AS hy FROM lx),\n"
            "s AS (" + "\nUNION ALL\n".join(parts) + ")\n"
            "SELECT \"column\", bin_x, bin_y, count(*) AS count FROM s WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY ALL")


@register("r03_scatter_bins", _scatter_sql())
def r03_scatter_bins(spark, sf):
    return tg.scatter_bins(fx.lineitem_x(spark, sf), "l_extendedprice", _top_features(spark, sf))


R04_FEATS = ["l_quantity", "l_discount", "l_tax"]


@register("r04_mutual_info", f"WITH {LX}, " + _mi_sql("lx", "l_extendedprice", R04_FEATS, True))
def r04_mutual_info(spark, sf):
    m = tg.binned_mi(fx.lineitem_x(spark, sf), "l_extendedprice", R04_FEATS, bin_target=True)
    return m.select("column", F.round("mutual_info", 6).alias("mutual_info"))


@register("r05_breusch_pagan_lm", "WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem),\n"
          "c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),\n"
          "u AS (SELECT x, pow(y - (a + b * x), 2) AS u FROM d, c)\n"
          "SELECT 'l_extendedprice' AS target, count(*) AS n, round(count(*) * regr_r2(u, x), 4) AS lm FROM u")
def r05_breusch_pagan_lm(spark, sf):
    b = tg.breusch_pagan(fx.read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return b.select("target", "n", F.round("lm", 4).alias("lm"))


@register("r05_breusch_pagan")
def r05_breusch_pagan(spark, sf):
    return tg.breusch_pagan(fx.lineitem_x(spark, sf), "l_extendedprice", _top_features(spark, sf))


LK = f"lk AS ({fx.LK_SQL})"
LK_NUMERIC = ["l_rowkey", "l_quantity", "l_discount", "l_tax", "price_final", "label_copy"]


@register("l01_id_like_features", f"WITH {LK}\n" + "SELECT \"column\", position FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, (count(DISTINCT {qn(c)}) + max(CASE WHEN {qn(c)} IS NULL THEN 1 ELSE 0 END)) "
    f"/ greatest(count(*), 1) AS ratio, count(DISTINCT {qn(c)}) + max(CASE WHEN {qn(c)} IS NULL THEN 1 ELSE 0 END) AS u FROM lk"
    for i, c in enumerate(fx.LK_COLUMNS) if c != "l_extendedprice") + ") WHERE u > 1 AND ratio > 0.98")
def l01_id_like_features(spark, sf):
    return tg.id_like_features(fx.lineitem_leak(spark, sf), "l_extendedprice")


@register("l02_suspicious_names", f"WITH {LK}, cols AS (SELECT column_name AS c, row_number() OVER () - 1 AS p "
          "FROM (DESCRIBE SELECT * FROM lk))\n"
          "SELECT c AS \"column\", CAST(p AS INTEGER) AS position FROM cols WHERE c <> 'l_extendedprice' AND (" +
          " OR ".join(f"contains(lower(c), '{h}')" for h in tg.LEAK_NAME_HINTS) + ")")
def l02_suspicious_names(spark, sf):
    return tg.suspicious_names(fx.lineitem_leak(spark, sf), "l_extendedprice")


L_CORR_SQL = ("hc AS (SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {fx.LK_COLUMNS.index(c)} AS position, corr(CAST({qn(c)} AS DOUBLE), l_extendedprice) AS r, "
    f"count(*) FILTER (WHERE {qn(c)} IS NOT NULL AND l_extendedprice IS NOT NULL) AS n FROM lk" for c in LK_NUMERIC) +
              ") WHERE n > 5 AND abs(r) > 0.95)\n")


@register("l03_high_correlation", f"WITH {LK}, " + L_CORR_SQL +
          "SELECT \"column\", position, round(r, 4) AS correlation, abs(r) > 0.999 AS near_duplicate FROM hc")
def l03_high_correlation(spark, sf):
    return tg.high_correlation(fx.lineitem_leak(spark, sf), "l_extendedprice")


@register("l04_near_duplicate_numeric", f"WITH {LK}, " + L_CORR_SQL +
          "SELECT \"column\" FROM hc WHERE abs(r) > 0.999")
def l04_near_duplicate_numeric(spark, sf):
    return tg.high_correlation(fx.lineitem_leak(spark, sf), "l_extendedprice").where("near_duplicate").select("column")


_L05 = ["l_returnflag", "price_text"]


@register("l05_text_match", f"WITH {LK}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN CAST({qn(c)} AS VARCHAR) IS NOT DISTINCT FROM CAST(l_extendedprice AS VARCHAR) "
    f"THEN 1.0 ELSE 0.0 END) AS match_rate, avg(CASE WHEN CAST({qn(c)} AS VARCHAR) IS NOT DISTINCT FROM "
    f"CAST(l_extendedprice AS VARCHAR) THEN 1.0 ELSE 0.0 END) > 0.98 AS near_duplicate FROM lk" for c in _L05))
def l05_text_match(spark, sf):
    t = tg.text_match(fx.lineitem_leak(spark, sf), "l_extendedprice")
    return t.select("column", F.round("match_rate", 6).alias("match_rate"), "near_duplicate")


@register("l06_id_like_correlated", f"WITH {LK}, " + L_CORR_SQL.rstrip("\n") + ",\n" + "ids AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\" FROM lk HAVING count(DISTINCT {qn(c)}) + max(CASE WHEN {qn(c)} IS NULL THEN 1 ELSE 0 END) > 1 "
    f"AND (count(DISTINCT {qn(c)}) + max(CASE WHEN {qn(c)} IS NULL THEN 1 ELSE 0 END)) / greatest(count(*), 1) > 0.98"
    for c in fx.LK_COLUMNS if c != "l_extendedprice") + ")\n"
          "SELECT \"column\" FROM ids INTERSECT SELECT \"column\" FROM hc")
def l06_id_like_correlated(spark, sf):
    return tg.id_like_correlated(fx.lineitem_leak(spark, sf), "l_extendedprice")
