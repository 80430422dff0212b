"""Registered generic-step queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import generic as ge
from tablelens.plans import fixtures as fx
from tablelens.plans.catalog import register
from tablelens.plans.q_profile import LX, LX_FAMILIES
from tablelens.plans.sqlgen import d, freq_sql, profile_cte, qn

OX_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'x' AS o_const FROM orders"
OX_FAMILIES = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
               ("o_const", "string")]
OX = f"ox AS ({OX_SQL})"
EV_NUMERIC = ["event_id", "user_id", "value"]


def orders_x(spark, sf):
    return fx.read_table(spark, sf, "orders").withColumn("o_const", F.lit("x"))


def events(spark, sf):
    return fx.read_table(spark, sf, "events")


@register("g01_overview", """SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE lower(data_type) END AS dtype, count(*) AS column_count,
  (SELECT count(*) FROM lineitem) AS n_rows,
  (SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS n_columns
FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")
def g01_overview(spark, sf):
    out = ge.overview(fx.read_table(spark, sf, "lineitem"))
    return out.withColumn("n_columns", F.col("n_columns").cast("long"))


def _describe_sql() -> str:
    parts = []
    stats = ("mean", "std", "min", "q25", "q50", "q75", "max")
    for c, fam in LX_FAMILIES:
        if fam == "numeric":
            x = f"CAST({qn(c)} AS DOUBLE)"
            parts.append(
                f"SELECT '{c}' AS \"column\", count({qn(c)}) AS count, CAST(NULL AS BIGINT) AS \"unique\", "
                f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, (avg({x})) AS mean, "
                f"(stddev_samp({x})) AS std, (min({x})) AS min, "
                f"(quantile_cont({x}, 0.25)) AS q25, (quantile_cont({x}, 0.5)) AS q50, "
                f"(quantile_cont({x}, 0.75)) AS q75, (max({x})) AS max FROM lx")
        else:
            nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in stats)
            parts.append(
                f"SELECT '{c}', (SELECT count({qn(c)}) FROM lx), (SELECT count(DISTINCT {qn(c)}) FROM lx), "
                f"value, n, {nulls} FROM (SELECT CAST({qn(c)} AS VARCHAR) AS value, count(*) AS n FROM lx "
                f"WHERE {qn(c)} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 1)")
    return f"WITH {LX}\n" + "\nUNION ALL\n".join(parts)


@register("g02_describe_all", _describe_sql())
def g02_describe_all(spark, sf):
    out = ge.describe_all(fx.lineitem_x(spark, sf))
    return out.select("column", "count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max")


@register("g03_missing_table", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          "SELECT \"column\", position, missing_count, missing_pct FROM p WHERE missing_count > 0")
def g03_missing_table(spark, sf):
    return ge.missing_table(fx.lineitem_x(spark, sf))


@register("g03_missing_summary", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          "SELECT count(*) FILTER (WHERE missing_count > 0) AS columns_with_missing, "
          "CAST(sum(missing_count) AS BIGINT) AS total_missing_cells, "
          "CASE WHEN max(missing_pct) > 0 THEN arg_max(\"column\", (missing_pct, -position)) END AS worst_column, "
          "max(missing_pct) AS worst_pct FROM p")
def g03_missing_summary(spark, sf):
    return ge.missing_summary(fx.lineitem_x(spark, sf))


@register("g04_missing_patterns", f"WITH {LX}\nSELECT " + " || ".join(
    f"CASE WHEN {qn(c)} IS NULL THEN '1' ELSE '0' END" for c, _ in LX_FAMILIES) +
          " AS pattern, count(*) AS n FROM lx GROUP BY 1")
def g04_missing_patterns(spark, sf):
    return ge.missing_patterns(fx.lineitem_x(spark, sf))


@register("g05_duplicate_preview", f"WITH ld AS ({fx.LD_SQL}),\n"
          "g AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM ld "
          "GROUP BY l_returnflag, l_linestatus, l_linenumber HAVING count(*) > 1)\n"
          "SELECT l_returnflag, l_linestatus, l_linenumber FROM (SELECT g.*, k FROM g, range(1, 21) t(k) "
          "WHERE k <= n ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, "
          "l_linenumber NULLS FIRST, k LIMIT 20)")
def g05_duplicate_preview(spark, sf):
    return ge.duplicate_preview(fx.lineitem_dup(spark, sf))


@register("g06_duplicate_summary", f"WITH ld AS ({fx.LD_SQL}), g AS (SELECT count(*) AS n FROM ld "
          "GROUP BY l_returnflag, l_linestatus, l_linenumber)\n"
          "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, "
          f"{d('round(100.0 * sum(n - 1) / sum(n), 2)')} AS duplicate_pct FROM g")
def g06_duplicate_summary(spark, sf):
    return ge.duplicate_summary(fx.lineitem_dup(spark, sf))


@register("g07_constant_and_id", f"WITH {OX}, p AS ({profile_cte('ox', OX_FAMILIES)})\n"
          "SELECT \"column\", position, CASE WHEN unique_with_null <= 1 THEN 'constant' ELSE 'id_like' END AS flag "
          "FROM p WHERE unique_with_null <= 1 OR unique_with_null / greatest(n_rows, 1) > 0.98")
def g07_constant_and_id(spark, sf):
    return ge.constant_and_id(orders_x(spark, sf))


@register("g08_uniqueness_table", f"WITH {OX}, p AS ({profile_cte('ox', OX_FAMILIES)})\n"
          "SELECT * FROM (SELECT \"column\", position, unique_with_null AS unique_count, "
          "round(unique_with_null / greatest(n_rows, 1), 3) AS unique_ratio, "
          "row_number() OVER (ORDER BY round(unique_with_null / greatest(n_rows, 1), 3) DESC, position) AS rank "
          "FROM p) WHERE rank <= 15")
def g08_uniqueness_table(spark, sf):
    out = ge.uniqueness_table(orders_x(spark, sf))
    return out.withColumn("rank", F.col("rank").cast("long"))


def _skew_sql(src: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, "
        f"round(CASE WHEN count({qn(c)}) < 3 THEN NULL WHEN var_pop({qn(c)}) = 0 THEN 0.0 ELSE skewness({qn(c)}) END, 3) AS skew, "
        f"round(CASE WHEN count({qn(c)}) < 4 THEN NULL WHEN var_pop({qn(c)}) = 0 THEN 0.0 ELSE kurtosis({qn(c)}) END, 3) AS kurtosis "
        f"FROM {src} HAVING count({qn(c)}) > 0" for i, c in enumerate(cols))


@register("g09_skew_kurtosis", f"WITH {LX}\n" + _skew_sql("lx", fx.LX_NUMERIC))
def g09_skew_kurtosis(spark, sf):
    return ge.skew_kurtosis(fx.lineitem_x(spark, sf))


def _hist_sql(src: str, cols: list[str], bins: int = 10) -> str:
    r = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, min(CAST({qn(c)} AS DOUBLE)) AS lo, "
        f"max(CAST({qn(c)} AS DOUBLE)) AS hi FROM {src}" for i, c in enumerate(cols))
    x = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST({qn(c)} AS DOUBLE) AS x FROM {src} WHERE {qn(c)} IS NOT NULL"
        for c in cols)
    return (f"r AS ({r}),\nx AS ({x}),\n"
            f"b AS (SELECT x.\"column\", CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin "
            f"FROM x JOIN r ON x.\"column\" = r.\"column\"),\n"
            f"c AS (SELECT \"column\", bin, count(*) AS cnt FROM b GROUP BY ALL),\n"
            f"g AS (SELECT r.*, CAST(t.bin AS INTEGER) AS bin FROM r, range(0, {bins}) t(bin) WHERE lo IS NOT NULL)\n"
            f"SELECT g.\"column\", g.position, g.bin, round(lo + (hi - lo) * g.bin / {bins}, 6) AS lower, "
            f"round(lo + (hi - lo) * (g.bin + 1) / {bins}, 6) AS upper, coalesce(cnt, 0) AS count "
            f"FROM g LEFT JOIN c ON g.\"column\" = c.\"column\" AND g.bin = c.bin")


@register("g10_histogram", f"WITH {LX},\n" + _hist_sql("lx", fx.LX_NUMERIC))
def g10_histogram(spark, sf):
    h = ge.histogram(fx.lineitem_x(spark, sf), bins=10)
    return h.select("column", "position", "bin", F.round("lower", 6).alias("lower"),
                    F.round("upper", 6).alias("upper"), "count")


_TOP_CATS = ["l_returnflag", "l_linestatus", "l_shipdate", "l_const"]


@register("g11_top10_values", f"WITH {LX}, f AS ({freq_sql('lx', _TOP_CATS)})\n"
          "SELECT \"column\", rank, value, count FROM (SELECT \"column\", value, n AS count, "
          "row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value ASC) AS rank FROM f) "
          "WHERE rank <= 10")
def g11_top10_values(spark, sf):
    t = ge.top_values(fx.lineitem_x(spark, sf), k=10)
    return t.select("column", F.col("rank").cast("long").alias("rank"), "value", "count")


@register("g12_skew_finding", f"WITH s AS ({_skew_sql('events', EV_NUMERIC)})\n"
          "SELECT * FROM (SELECT \"column\", position, skew, kurtosis, "
          "row_number() OVER (ORDER BY abs(skew) DESC, position) AS rank FROM s WHERE abs(skew) > 1) WHERE rank <= 3")
def g12_skew_finding(spark, sf):
    out = ge.skew_finding(events(spark, sf), EV_NUMERIC)
    return out.withColumn("rank", F.col("rank").cast("long"))


def _outlier_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({qn(c)} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, count({x}) AS n, quantile_cont({x}, 0.25) AS q1, "
            f"quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3, avg({x}) AS mean, "
            f"stddev_pop({x}) AS std_pop FROM {src}")
    f = "\nUNION ALL\n".join(parts)
    xs = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST({qn(c)} AS DOUBLE) AS x FROM {src} WHERE {qn(c)} IS NOT NULL"
        for c in cols)
    return (f"f0 AS ({f}),\nf AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM f0),\n"
            f"x AS ({xs}),\n"
            "o AS (SELECT f.\"column\", count(*) FILTER (WHERE x < lower OR x > upper) AS iqr_outliers, "
            "count(*) FILTER (WHERE std_pop > 0 AND abs(x - mean) > 3 * std_pop) AS z_score_outliers, "
            "min(x) FILTER (WHERE x >= lower) AS whisker_low, max(x) FILTER (WHERE x <= upper) AS whisker_high "
            "FROM f JOIN x ON f.\"column\" = x.\"column\" GROUP BY f.\"column\")\n")


@register("g13_iqr_outliers", "WITH " + _outlier_sql("events", EV_NUMERIC) +
          "SELECT f.\"column\", position, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, "
          "round(upper, 6) AS upper, iqr_outliers, round(100.0 * iqr_outliers / n, 2) AS iqr_outlier_pct "
          "FROM f JOIN o ON f.\"column\" = o.\"column\" WHERE n >= 5")
def g13_iqr_outliers(spark, sf):
    t = ge.outlier_table(events(spark, sf), EV_NUMERIC)
    return t.select("column", "position", "n", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lower", "upper")],
                    "iqr_outliers", "iqr_outlier_pct")


@register("g14_zscore_outliers", "WITH " + _outlier_sql("events", EV_NUMERIC) +
          "SELECT f.\"column\", round(mean, 6) AS mean, round(std_pop, 6) AS std_pop, z_score_outliers "
          "FROM f JOIN o ON f.\"column\" = o.\"column\" WHERE n >= 5")
def g14_zscore_outliers(spark, sf):
    t = ge.outlier_table(events(spark, sf), EV_NUMERIC)
    return t.select("column", F.round("mean", 6).alias("mean"), F.round("std_pop", 6).alias("std_pop"),
                    "z_score_outliers")


@register("g15_boxplot", "WITH " + _outlier_sql("events", EV_NUMERIC) +
          "SELECT f.\"column\", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
          "round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high "
          "FROM f JOIN o ON f.\"column\" = o.\"column\" WHERE n >= 5")
def g15_boxplot(spark, sf):
    t = ge.outlier_table(events(spark, sf), EV_NUMERIC)
    return t.select("column", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])
