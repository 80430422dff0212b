"""Registered source, sink and findings queries."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from tablelens.operators import generic as ge
from tablelens.operators import profile as pr
from tablelens.operators import target as tg
from tablelens.plans import analyze as an
from tablelens.plans import findings as fi
from tablelens.plans import fixtures as fx
from tablelens.plans.catalog import register
from tablelens.plans.q_generic import EV_NUMERIC, events
from tablelens.plans.q_profile import LX
from tablelens.session import checkpoint_dir
from tablelens.sources import load as ld
from tablelens.sources import sinks


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("s01_file_type", "SELECT CASE lower(regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1)) "
          + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ld.EXTENSIONS.items())
          + " END AS file_type, count(*) AS n FROM pages GROUP BY 1")
def s01_file_type(spark, sf):
    pages = fx.read_table(spark, sf, "pages")
    return pages.groupBy(ld.file_type_expr(F.col("url")).alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


_CHECK_SQL = ("SELECT count(*) AS n_rows, round(sum(l_quantity), 4) AS sum_qty, "
              "round(sum(l_extendedprice), 4) AS sum_price, count(DISTINCT l_returnflag) AS n_flags FROM lineitem")


def _checksum(df):
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
                  F.round(F.sum("l_extendedprice"), 4).alias("sum_price"),
                  F.count_distinct("l_returnflag").alias("n_flags"))


@register("s02_csv_roundtrip", _CHECK_SQL)
def s02_csv_roundtrip(spark, sf):
    path = _scratch(spark, "lineitem-csv") + ".csv"
    fx.read_table(spark, sf, "lineitem").write.option("header", True).csv(path)
    info = ld.load_dataset(spark, path, sample_threshold=None)
    return _checksum(info.df)


@register("s03_tsv_sniffed_roundtrip", _CHECK_SQL.replace("SELECT ", "SELECT '|' AS delimiter, ", 1))
def s03_tsv_sniffed_roundtrip(spark, sf):
    path = _scratch(spark, "lineitem-pipe") + ".csv"
    fx.read_table(spark, sf, "lineitem").write.option("header", True).option("sep", "|").csv(path)
    delim = ld.sniff_delimiter(spark, path)
    return _checksum(ld.read_csv(spark, path, sep=delim)).select(F.lit(delim).alias("delimiter"), "*")


@register("s02_csv_line_breaks", "SELECT count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, "
          "CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS n_breaks, "
          "CAST(sum(length(text) - length(replace(text, '\"', ''))) AS BIGINT) AS n_quotes "
          "FROM documents")
def s02_csv_line_breaks(spark, sf):
    """Document texts, with their line breaks and quotes, survive a CSV export."""
    path = _scratch(spark, "documents") + ".csv"
    d = fx.read_table(spark, sf, "documents").select("doc_id", "text", "source")
    (d.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    t = F.col("text")
    return ld.load_dataset(spark, path).df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(t)).alias("n_chars"),
        F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("n_breaks"),
        F.sum(F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))).alias("n_quotes"))


@register("s05_malformed_skip", "SELECT count(*) AS n_rows FROM orders")
def s05_malformed_skip(spark, sf):
    """Orders as CSV plus one line per order with an extra field: the long lines are skipped."""
    path = _scratch(spark, "orders-bad") + ".csv"
    o = fx.read_table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")])
    long = o.withColumn("o_totalprice", F.concat("o_totalprice", F.lit(",extra")))
    # without a quote character the writer leaves the comma as it is; every part file has its header
    o.unionByName(long).write.option("header", True).option("quote", "\u0000").csv(path)
    return ld.read_csv(spark, path, sep=",").agg(F.count(F.lit(1)).alias("n_rows"))


@register("s07_json_lines_roundtrip", "SELECT count(*) AS n_rows, round(sum(o_totalprice), 4) AS total FROM orders")
def s07_json_lines_roundtrip(spark, sf):
    path = _scratch(spark, "orders-json") + ".jsonl"
    fx.read_table(spark, sf, "orders").write.json(path)
    info = ld.load_dataset(spark, path, sample_threshold=None)
    return info.df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@register("s08_parquet_count", "SELECT count(*) AS n_rows FROM lineitem")
def s08_parquet_count(spark, sf):
    info = ld.load_dataset(spark, os.path.join(sf, "lineitem.parquet"), sample_threshold=None)
    return info.df.agg(F.count(F.lit(1)).alias("n_rows"))


@register("s10_exact_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)) LIMIT 1000")
def s10_exact_sample(spark, sf):
    return ld.exact_sample(fx.read_table(spark, sf, "orders"), 1000, key="o_orderkey").select("o_orderkey")


@register("s11_preview", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders "
          "ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def s11_preview(spark, sf):
    p = ld.preview(fx.read_table(spark, sf, "orders"), ["o_orderkey"], offset=100, limit=50)
    return p.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


@register("k01_profile_store")
def k01_profile_store(spark, sf):
    path = _scratch(spark, "profiles")
    prof = pr.semantic_types(pr.column_profile(fx.lineitem_x(spark, sf)))
    sinks.store_profile(prof.select("column", "position", "dtype", "semantic_type", "missing_pct", "unique_count"),
                        path, "lineitem_x")
    return spark.read.parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("columns"))


@register("k02_findings_store")
def k02_findings_store(spark, sf):
    path = _scratch(spark, "findings")
    f = fi.missing_findings(ge.missing_summary(fx.lineitem_x(spark, sf)))
    sinks.append_findings(f, path, "run-1")
    sinks.append_findings(f, path, "run-2")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"))


def _a01_sql() -> str:
    from tablelens.plans.q_profile import LX_FAMILIES
    from tablelens.plans.sqlgen import profile_cte
    miss = (f"ms AS (SELECT count(*) FILTER (WHERE missing_count > 0) AS c, sum(missing_count) AS cells, "
            f"arg_max(\"column\", (missing_pct, -position)) AS worst, max(missing_pct) AS pct FROM p)")
    return (f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)}), {miss}\n"
            "SELECT 'missing_values' AS step, CASE WHEN pct >= 50 THEN 'critical' WHEN pct >= 15 THEN 'warning' ELSE 'info' END "
            "AS severity, 0 AS bullet, printf('Incomplete columns: %d; empty cells: %s.', c, "
            "format('{:,}', CAST(cells AS BIGINT))) AS text FROM ms UNION ALL "
            "SELECT 'missing_values', CASE WHEN pct >= 50 THEN 'critical' WHEN pct >= 15 THEN 'warning' ELSE 'info' END, 1, "
            "printf('Most gaps: ''%s'', %.1f%% of its cells.', worst, pct) FROM ms")


@register("a01_missing_findings", _a01_sql())
def a01_missing_findings(spark, sf):
    return fi.missing_findings(ge.missing_summary(fx.lineitem_x(spark, sf)))


def _a02_sql() -> str:
    from tablelens.plans.q_assoc import L_CORR_SQL
    from tablelens.plans.q_generic import _outlier_sql
    from tablelens.plans.q_profile import DL, LX_FAMILIES
    from tablelens.plans.sqlgen import profile_cte

    def bucket(v, w, c):
        return f"CASE WHEN {v} >= {c} THEN 'critical' WHEN {v} >= {w} THEN 'warning' ELSE 'info' END"

    tm = ("tm AS (" + " UNION ALL ".join(
        f"SELECT avg(CASE WHEN CAST({c} AS VARCHAR) IS NOT DISTINCT FROM CAST(l_extendedprice AS VARCHAR) "
        f"THEN 1.0 ELSE 0.0 END) AS rate FROM lk" for c in ("l_returnflag", "price_text")) + ")")
    return (f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)}),\n"
            f"ld AS ({fx.LD_SQL}), g AS (SELECT count(*) AS n FROM ld GROUP BY l_returnflag, l_linestatus, l_linenumber),\n"
            + _outlier_sql("events", EV_NUMERIC).rstrip("\n") + ",\n"
            f"{DL}, cb AS (SELECT count(*) AS n FROM dl GROUP BY quality),\n"
            f"lk AS ({fx.LK_SQL}), " + L_CORR_SQL.rstrip("\n") + f", {tm}\n"
            f"SELECT 'missing_values' AS step, {bucket('v', 15, 50)} AS severity FROM (SELECT max(missing_pct) AS v FROM p)\n"
            f"UNION ALL SELECT 'duplicates', {bucket('v', 5, 20)} FROM (SELECT round(100.0 * sum(n - 1) / sum(n), 2) AS v FROM g)\n"
            f"UNION ALL SELECT 'outliers', {bucket('v', 5, 15)} FROM (SELECT max(round(100.0 * iqr_outliers / n, 2)) AS v "
            "FROM f JOIN o ON f.\"column\" = o.\"column\" WHERE n >= 5)\n"
            f"UNION ALL SELECT 'class_balance', {bucket('v', 3, 10)} FROM (SELECT round(max(n) / min(n), 2) AS v FROM cb)\n"
            "UNION ALL SELECT 'leakage_checks', CASE WHEN (SELECT count(*) FROM hc WHERE abs(r) > 0.999) + "
            "(SELECT count(*) FROM tm WHERE rate > 0.98) > 0 THEN 'critical' WHEN (SELECT count(*) FROM hc) > 0 "
            "THEN 'warning' ELSE 'info' END")


@register("a02_severity", _a02_sql())
def a02_severity(spark, sf):
    parts = [fi.missing_findings(ge.missing_summary(fx.lineitem_x(spark, sf))),
             fi.duplicate_findings(ge.duplicate_summary(fx.lineitem_dup(spark, sf))),
             fi.outlier_findings(ge.outlier_table(events(spark, sf), EV_NUMERIC)),
             fi.class_balance_findings(tg.imbalance(fx.documents_labels(spark, sf), "quality"), "quality")]
    lk = fx.lineitem_leak(spark, sf)
    parts.append(fi.leakage_findings(tg.near_duplicates(lk, "l_extendedprice"), tg.high_correlation(lk, "l_extendedprice"),
                                     tg.id_like_correlated(lk, "l_extendedprice"), tg.suspicious_names(lk, "l_extendedprice")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("step", "severity").distinct()


@register("a03_plan")
def a03_plan(spark, sf):
    prof = pr.semantic_types(pr.column_profile(fx.documents_labels(spark, sf), stats=False))
    t = pr.propose_target(prof).first()  # one row
    plan = an.build_plan(t["problem_type"])
    return spark.createDataFrame([(i, s, t["target_column"], t["problem_type"]) for i, s in enumerate(plan)],
                                 "step_order int, step string, target string, problem_type string")


@register("a05_run_report")
def a05_run_report(spark, sf):
    rep = an.analyze(fx.documents_labels(spark, sf), target="quality", key="doc_id")
    return rep.findings


@register("s04_delimiter_inference", "SELECT '|' AS delimiter, count(*) AS n_rows FROM orders")
def s04_delimiter_inference(spark, sf):
    """Orders written with '|' as the separator; the sniffed delimiter reads every row back."""
    path = _scratch(spark, "orders-pipe") + ".csv"
    fx.read_table(spark, sf, "orders").write.option("header", True).option("sep", "|").csv(path)
    delim = ld.sniff_delimiter(spark, path)
    return ld.read_csv(spark, path, sep=delim).agg(F.lit(delim).alias("delimiter"), F.count(F.lit(1)).alias("n_rows"))


@register("s06_json_array_roundtrip", "SELECT count(*) AS n_rows, round(sum(o_totalprice), 4) AS total FROM orders")
def s06_json_array_roundtrip(spark, sf):
    """Orders written as one JSON array per task, a record a line; the loader sees the bracket and cuts
    the arrays into their elements, split by split."""
    path = _scratch(spark, "orders-array") + ".json"
    o = fx.read_table(spark, sf, "orders")

    def array_lines(batches):
        """A task's records as the lines of one array."""
        mark = "["
        for rows in batches:
            yield rows.assign(value=[f"{mark if i == 0 else ','} {r}" for i, r in enumerate(rows["value"])])
            mark = "," if len(rows) else mark
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    o.select(F.to_json(F.struct(*o.columns)).alias("value")).mapInPandas(array_lines, "value string").write.text(path)
    info = ld.load_dataset(spark, path, sample_threshold=None)
    return info.df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@register("s09_row_count", "SELECT count(*) AS total_rows FROM lineitem")
def s09_row_count(spark, sf):
    info = ld.load_dataset(spark, os.path.join(sf, "lineitem.parquet"), sample_threshold=None)
    return info.df.agg(F.count(F.lit(1)).alias("total_rows"))


@register("a04_plan_edit")
def a04_plan_edit(spark, sf):
    """The proposed plan for documents x labels, edited to its generic steps in reverse order."""
    plan = a03_plan(spark, sf).orderBy("step_order").collect()  # <= 13 steps
    edited = an.edit_plan([r["step"] for r in plan if r["step"] in an.GENERIC_STEPS][::-1])
    return spark.createDataFrame(list(enumerate(edited)), "step_order int, step string")


@register("a05_run_report_series")
def a05_run_report_series(spark, sf):
    """A full run on the daily events series (time-series plan)."""
    from tablelens.plans.q_series import ed
    rep = an.analyze(ed(spark, sf), target="y", problem_type="time_series")
    return rep.findings


@register("a05_run_report_clustering")
def a05_run_report_clustering(spark, sf):
    """A full run without a target on the first embedding dimensions (clustering plan)."""
    rep = an.analyze(fx.embeddings_wide(spark, sf).drop("vec_id", "label"))
    return rep.findings


@register("s13_input_validation")
def s13_input_validation(spark, sf):
    """An empty export of orders (header only) and a non-JSON file are both rejected with
    one error type; the orders export with rows loads."""
    out = []
    empty = _scratch(spark, "orders-empty") + ".csv"
    fx.read_table(spark, sf, "orders").where(F.lit(False)).write.option("header", True).csv(empty)
    full = _scratch(spark, "orders-full") + ".csv"
    fx.read_table(spark, sf, "orders").write.option("header", True).csv(full)
    bad = _scratch(spark, "orders-bad") + ".json"
    fx.read_table(spark, sf, "orders").select(F.concat(F.lit("not json "), F.col("o_orderkey").cast("string"))
                                              .alias("value")).write.text(bad)
    for name, path in (("empty_csv", empty), ("full_csv", full), ("garbage_json", bad)):
        try:
            info = ld.load_dataset(spark, path, sample_threshold=None)
            out.append((name, "loaded", int(info.total_rows)))
        except ld.LoadError as exc:
            out.append((name, "rejected: " + type(exc).__name__, 0))
    return spark.createDataFrame(out, "input string, outcome string, rows long")
