"""Registered profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import profile as pr
from tablelens.plans import fixtures as fx
from tablelens.plans.catalog import register
from tablelens.plans.sqlgen import (PROBLEM_CASE, d, freq_sql, numeric_stats_sql, profile_cte,
                                    qn, semantic_case)

LX_FAMILIES = [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
               ("l_linenumber", "numeric"), ("l_quantity", "numeric"),
               ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
               ("l_returnflag", "string"), ("l_linestatus", "string"),
               ("l_shipdate", "datetime"), ("l_const", "string")]
LX = f"lx AS ({fx.LX_SQL})"

# Quality fixture: missing, duplicate rows and a constant column together.
LQ_SQL = """SELECT l_returnflag,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus END AS l_linestatus,
  l_linenumber, 'x' AS l_const FROM lineitem"""
LQ_FAMILIES = [("l_returnflag", "string"), ("l_linestatus", "string"),
               ("l_linenumber", "numeric"), ("l_const", "string")]
LQ = f"lq AS ({LQ_SQL})"


def lineitem_quality(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    return li.select("l_returnflag",
                     F.when(F.col("l_linenumber") == 1, F.lit(None))
                     .otherwise(F.col("l_linestatus")).alias("l_linestatus"),
                     "l_linenumber", F.lit("x").alias("l_const"))


DL_FAMILIES = [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"),
               ("n_chars", "numeric"), ("quality", "numeric"), ("toxic", "numeric")]
DL = f"dl AS ({fx.DL_SQL})"


def _profile(df, exact=True):
    """Semantic types need distinct counts and types only: no numeric statistics."""
    return pr.semantic_types(pr.column_profile(df, exact=exact, stats=False))


@register("p01_missing", f"WITH {LX}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, count(*) AS n_rows, "
    f"count(*) - count({qn(c)}) AS missing_count, "
    f"{d(f'CASE WHEN count(*) > 0 THEN round(100.0 * (count(*) - count({qn(c)})) / count(*), 2) ELSE 0 END')} AS missing_pct FROM lx"
    for i, (c, _) in enumerate(LX_FAMILIES)))
def p01_missing(spark, sf):
    return pr.missing(fx.lineitem_x(spark, sf))


@register("p02_distinct", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          "SELECT \"column\", unique_count, unique_with_null FROM p")
def p02_distinct(spark, sf):
    return pr.distinct_counts(fx.lineitem_x(spark, sf)).select("column", "unique_count", "unique_with_null")


@register("p03_numeric_stats", f"WITH {LX}\n" + numeric_stats_sql("lx", fx.LX_NUMERIC, None))
def p03_numeric_stats(spark, sf):
    s = pr.numeric_stats(fx.lineitem_x(spark, sf))
    return s.select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurtosis")


_TOP_CATS = ["l_returnflag", "l_linestatus", "l_shipdate", "l_const"]


@register("p04_top_values", f"WITH {LX}, f AS ({freq_sql('lx', _TOP_CATS)})\n"
          "SELECT \"column\", rank, value, count FROM (SELECT \"column\", value, n AS count, "
          "row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value ASC) AS rank FROM f) "
          "WHERE rank <= 5")
def p04_top_values(spark, sf):
    t = pr.top_values(fx.lineitem_x(spark, sf), k=5)
    return t.select("column", F.col("rank").cast("long").alias("rank"), "value", "count")


@register("p05_duplicates", f"WITH ld AS ({fx.LD_SQL}), g AS (SELECT count(*) AS n FROM ld GROUP BY l_returnflag, l_linestatus, l_linenumber)\n"
          "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, "
          f"{d('round(100.0 * sum(n - 1) / sum(n), 2)')} AS duplicate_pct FROM g")
def p05_duplicates(spark, sf):
    return pr.duplicates(fx.lineitem_dup(spark, sf))


@register("p06_constant_columns", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          "SELECT \"column\", position FROM p WHERE unique_with_null <= 1")
def p06_constant_columns(spark, sf):
    return pr.constant_columns(fx.lineitem_x(spark, sf))


def _quality_sql(src_cte: str, src: str, fams) -> str:
    n_cols = len(fams)
    cols = ", ".join(qn(c) for c, _ in fams)
    return (f"WITH {src_cte}, p AS ({profile_cte(src, fams)}),\n"
            f"g AS (SELECT count(*) AS n FROM {src} GROUP BY {cols}),\n"
            f"dup AS (SELECT sum(n) AS n_rows, sum(n - 1) AS dups, "
            f"CASE WHEN sum(n) > 0 THEN round(100.0 * sum(n - 1) / sum(n), 2) ELSE 0 END AS dup_pct FROM g),\n"
            f"agg AS (SELECT sum(missing_count) AS missing_cells, "
            f"sum(CASE WHEN unique_with_null <= 1 THEN 1 ELSE 0 END) AS constant_count FROM p),\n"
            f"s AS (SELECT {d(f'100.0 * (1 - missing_cells / greatest(1, n_rows * {n_cols}))')} AS completeness, "
            f"{d('greatest(0.0, 100.0 - dup_pct)')} AS uniqueness, "
            f"{d(f'100.0 * (1 - constant_count / {n_cols})')} AS consistency FROM dup, agg)\n")


def _clamp(x: str) -> str:
    return d(f"round(greatest(0.0, least(100.0, {x})), 1)")


@register("p07_quality_score", _quality_sql(LQ, "lq", LQ_FAMILIES) +
          f"SELECT {_clamp('0.5 * completeness + 0.3 * uniqueness + 0.2 * consistency')} AS overall, "
          f"{_clamp('completeness')} AS completeness, {_clamp('uniqueness')} AS uniqueness, "
          f"{_clamp('consistency')} AS consistency FROM s")
def p07_quality_score(spark, sf):
    return pr.quality_score(lineitem_quality(spark, sf))


@register("p08_quality_issues", _quality_sql(LQ, "lq", LQ_FAMILIES) +
          "SELECT 0 AS kind, position, printf('''%s'': %s%% of the cells are empty.', \"column\", "
          "CAST(round(missing_pct, 1) AS VARCHAR)) AS issue FROM p WHERE missing_pct > 20\n"
          "UNION ALL SELECT 1, 0, printf('%s%% of the rows repeat an earlier one.', "
          f"CAST({d('round(dup_pct, 1)')} AS VARCHAR)) FROM dup WHERE dup_pct > 5\n"
          "UNION ALL SELECT 2, position, printf('''%s'' never changes.', "
          "\"column\") FROM p WHERE unique_with_null <= 1")
def p08_quality_issues(spark, sf):
    return pr.quality_issues(lineitem_quality(spark, sf))


_WIDTHS = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8,
           "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_shipdate": 8}


def _bytes_sql() -> str:
    terms = []
    for c, _ in LX_FAMILIES:
        if c in _WIDTHS:
            terms.append(f"sum(CASE WHEN {qn(c)} IS NOT NULL THEN {_WIDTHS[c]} ELSE 0 END)")
        else:
            terms.append(f"coalesce(sum(strlen({qn(c)})), 0)")
    return (f"WITH {LX}\nSELECT count(*) AS n_rows, CAST({' + '.join(terms)} AS BIGINT) AS data_bytes FROM lx")


@register("p09_table_bytes", _bytes_sql())
def p09_table_bytes(spark, sf):
    return pr.table_bytes(fx.lineitem_x(spark, sf))


@register("p10_semantic_types", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          f"SELECT \"column\", {semantic_case()} AS semantic_type FROM p")
def p10_semantic_types(spark, sf):
    return _profile(fx.lineitem_x(spark, sf)).select("column", "semantic_type")


def _target_sql(whole_word: bool) -> str:
    hints = ["target", "label", "class", "outcome", "y", "price", "survived", "churn", "fraud", "default"]
    if whole_word:
        cond = " OR ".join(f"regexp_matches(lower(\"column\"), '(^|[^a-z0-9]){h}([^a-z0-9]|$)')" for h in hints)
    else:
        cond = " OR ".join(f"contains(lower(\"column\"), '{h}')" for h in hints)
    return (f"WITH {DL}, p0 AS ({profile_cte('dl', DL_FAMILIES)}),\n"
            f"p1 AS (SELECT *, {semantic_case()} AS semantic_type FROM p0),\n"
            f"p AS (SELECT *, {PROBLEM_CASE} AS problem_type FROM p1),\n"
            f"h AS (SELECT \"column\", problem_type FROM p WHERE {cond} ORDER BY position LIMIT 1),\n"
            "c AS (SELECT \"column\", problem_type FROM p WHERE semantic_type IN ('categorical', 'boolean') "
            "AND unique_count BETWEEN 2 AND 20 ORDER BY position DESC LIMIT 1)\n"
            "SELECT coalesce((SELECT \"column\" FROM h), (SELECT \"column\" FROM c)) AS target_column, "
            "coalesce((SELECT problem_type FROM h), (SELECT problem_type FROM c), 'clustering') AS problem_type, "
            "CASE WHEN (SELECT \"column\" FROM h) IS NOT NULL THEN 'name_hint' "
            "WHEN (SELECT \"column\" FROM c) IS NOT NULL THEN 'low_cardinality' ELSE 'none' END AS reason")


@register("p11_target_proposal", _target_sql(False))
def p11_target_proposal(spark, sf):
    return pr.propose_target(_profile(fx.documents_labels(spark, sf)))


@register("p11_target_proposal_whole_word", _target_sql(True))
def p11_target_proposal_whole_word(spark, sf):
    return pr.propose_target(_profile(fx.documents_labels(spark, sf)), whole_word=True)


@register("p12_problem_types", f"WITH {DL}, p0 AS ({profile_cte('dl', DL_FAMILIES)}),\n"
          f"p1 AS (SELECT *, {semantic_case()} AS semantic_type FROM p0)\n"
          f"SELECT \"column\", {PROBLEM_CASE} AS problem_type FROM p1")
def p12_problem_types(spark, sf):
    return pr.problem_types(_profile(fx.documents_labels(spark, sf))).select("column", "problem_type")


@register("p13_column_kind", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          "SELECT \"column\", CASE WHEN family = 'boolean' THEN 'Yes/no' WHEN family = 'datetime' THEN 'Date' "
          "WHEN family = 'numeric' THEN 'Number' ELSE 'Text' END AS kind FROM p")
def p13_column_kind(spark, sf):
    prof = pr.column_kind(pr.column_profile(fx.lineitem_x(spark, sf), stats=False))
    return prof.select("column", "kind")


@register("p14_search_sort", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          "SELECT \"column\", row_number() OVER (ORDER BY missing_pct DESC, position) AS display_order "
          "FROM p WHERE contains(lower(\"column\"), 'l_')")
def p14_search_sort(spark, sf):
    prof = pr.column_profile(fx.lineitem_x(spark, sf), stats=False)
    out = pr.search_sort(prof, "L_", "missing")
    return out.select("column", F.col("display_order").cast("long").alias("display_order"))


@register("p15_badges", f"WITH {LX}, p AS ({profile_cte('lx', LX_FAMILIES)})\n"
          "SELECT \"column\", unique_count <= 1 AS is_constant, "
          "n_rows > 1 AND unique_count >= n_rows AS all_unique FROM p")
def p15_badges(spark, sf):
    return pr.badges(pr.column_profile(fx.lineitem_x(spark, sf), stats=False)).select("column", "is_constant", "all_unique")


def _glyph(c: str) -> str:
    return f"round(CASE WHEN max - min = 0 THEN 50.0 ELSE ({c} - min) / (max - min) * 100 END, 6)"


@register("p16_range_glyph", f"WITH {LX}, s AS ({numeric_stats_sql('lx', fx.LX_NUMERIC, digits=None)})\n"
          f"SELECT \"column\", {_glyph('q25')} AS pos_q1, {_glyph('q50')} AS pos_median, "
          f"{_glyph('q75')} AS pos_q3 FROM s")
def p16_range_glyph(spark, sf):
    g = pr.range_glyph(pr.numeric_stats(fx.lineitem_x(spark, sf)))
    return g.select("column", *[F.round(c, 6).alias(c) for c in ("pos_q1", "pos_median", "pos_q3")])


@register("p17_tones", _quality_sql(LQ, "lq", LQ_FAMILIES) +
          f", sc AS (SELECT {_clamp('0.5 * completeness + 0.3 * uniqueness + 0.2 * consistency')} AS overall FROM s)\n"
          "SELECT \"column\", CASE WHEN missing_count = 0 THEN 'none' WHEN missing_pct >= 50 THEN 'critical' "
          "WHEN missing_pct >= 20 THEN 'warning' ELSE 'neutral' END AS missing_tone, "
          "(SELECT CASE WHEN overall >= 80 THEN 'success' WHEN overall >= 60 THEN 'warning' ELSE 'critical' END FROM sc) "
          "AS score_tone FROM p")
def p17_tones(spark, sf):
    df = lineitem_quality(spark, sf)
    score = pr.quality_score(df).select(pr.score_tone("overall").alias("score_tone"))
    miss = pr.missing(df).select("column", pr.missing_tone().alias("missing_tone"))
    return miss.crossJoin(score)  # per-column rows by one row


@register("p18_context_records")
def p18_context_records(spark, sf):
    return pr.context_records(pr.semantic_types(pr.column_profile(fx.lineitem_x(spark, sf))))


def flagship(spark, sf):
    """P01 joined to P03 over lineitem with planted nulls: one row per column."""
    df = fx.lineitem_x(spark, sf)
    miss = pr.missing(df).select("column", "position", "n_rows", "missing_count", "missing_pct")
    stats = pr.numeric_stats(df).drop("position")
    return miss.join(stats, "column", "left").select(
        "column", "position", "n_rows", "missing_count", "missing_pct", "n",
        *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max",
                                           "skew", "kurtosis")])
