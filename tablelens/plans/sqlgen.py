"""Oracle SQL text builders (DuckDB dialect) shared by the registered queries.

These only produce SQL strings for the independent DuckDB check; Spark never
runs them.
"""

from __future__ import annotations


def d(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def qn(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def profile_cte(src: str, cols: list[tuple[str, str]]) -> str:
    """Per-column rows: column, position, family, n_rows, missing_count, missing_pct,
    unique_count, unique_with_null.  ``cols`` is [(name, family)]."""
    parts = []
    for i, (c, fam) in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, '{fam}' AS family, "
            f"count(*) AS n_rows, count(*) - count({qn(c)}) AS missing_count, "
            f"{d(f'CASE WHEN count(*) > 0 THEN round(100.0 * (count(*) - count({qn(c)})) / count(*), 2) ELSE 0 END')} AS missing_pct, "
            f"count(DISTINCT {qn(c)}) AS unique_count, "
            f"count(DISTINCT {qn(c)}) + max(CASE WHEN {qn(c)} IS NULL THEN 1 ELSE 0 END) AS unique_with_null "
            f"FROM {src}")
    return "\nUNION ALL\n".join(parts)


def semantic_case(n: str = "greatest(n_rows, 1)") -> str:
    return (f"CASE WHEN unique_with_null <= 1 THEN 'constant' "
            f"WHEN family = 'datetime' THEN 'datetime' "
            f"WHEN family = 'boolean' OR (unique_count = 2 AND family <> 'numeric') THEN 'boolean' "
            f"WHEN {n} > 1 AND unique_count >= {n} * 0.98 THEN 'id_like' "
            f"WHEN family = 'numeric' THEN 'numeric' "
            f"WHEN unique_count / {n} > 0.5 THEN 'text' ELSE 'categorical' END")


PROBLEM_CASE = ("CASE WHEN semantic_type = 'boolean' OR unique_count = 2 THEN 'binary_classification' "
                "WHEN semantic_type = 'categorical' AND unique_count <= 20 THEN 'multiclass_classification' "
                "ELSE 'regression' END")


def numeric_stats_sql(src: str, cols: list[str], digits: int | None = 6) -> str:
    parts = []
    for c in cols:
        x = f"CAST({qn(c)} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS n, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max, "
            f"round(CASE WHEN count({x}) < 3 THEN NULL WHEN var_pop({x}) = 0 THEN 0.0 ELSE skewness({x}) END, 6) AS skew, "
            f"round(CASE WHEN count({x}) < 4 THEN NULL WHEN var_pop({x}) = 0 THEN 0.0 ELSE kurtosis({x}) END, 6) AS kurtosis "
            f"FROM {src}")
    out = "\nUNION ALL\n".join(parts)
    if digits is None:
        out = out.replace("round(", "(").replace(", 6) AS", ") AS")
    return out


def freq_sql(src: str, cols: list[str], non_null: bool = True) -> str:
    """(column, value, n) rows of the frequency table."""
    parts = []
    for c in cols:
        where = f" WHERE {qn(c)} IS NOT NULL" if non_null else ""
        parts.append(f"SELECT '{c}' AS \"column\", CAST({qn(c)} AS VARCHAR) AS value, count(*) AS n "
                     f"FROM {src}{where} GROUP BY 2")
    return "\nUNION ALL\n".join(parts)
