"""Registered clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import cluster as cl
from tablelens.plans import fixtures as fx
from tablelens.plans.catalog import register
from tablelens.plans.q_profile import LX

LN = fx.LN_COLUMNS
EMB = fx.EMB_FEATURES


@register("u01_scale_report", f"WITH {LX}, s AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, round(stddev_samp({c}), 3) AS std FROM lx" for i, c in enumerate(LN)) +
          ")\nSELECT \"column\", position, std, (SELECT max(std) / greatest(min(std), 1e-9) > 10 FROM s WHERE std > 0) "
          "AS scales_differ FROM s")
def u01_scale_report(spark, sf):
    return cl.scale_report(fx.lineitem_x(spark, sf), LN)


def _std_sql(src: str, cols: list[str]) -> str:
    st = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(cols))
    z = ", ".join(f"round(({c} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END, 6) AS {c}" for i, c in enumerate(cols))
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f"c AS (SELECT {', '.join(cols)} FROM {src} WHERE {where}), st AS (SELECT {st} FROM c)\n"
            f"SELECT {z} FROM c, st")


@register("u02_standardize", f"WITH {LX}, " + _std_sql("lx", LN))
def u02_standardize(spark, sf):
    z = cl.standardize(fx.lineitem_x(spark, sf), LN)
    return z.select(*[F.round(c, 6).alias(c) for c in LN])


_PCA2 = ["l_quantity", "l_extendedprice"]


@register("u03_pca_variance_2", f"WITH {LX}, r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lx "
          "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)\n"
          "SELECT 1 AS component, round((1 + r) / 2, 6) AS variance_ratio FROM r UNION ALL "
          "SELECT 2, round((1 - r) / 2, 6) FROM r")
def u03_pca_variance_2(spark, sf):
    p = cl.pca_variance(fx.lineitem_x(spark, sf), _PCA2)
    return p.select("component", F.round("variance_ratio", 6).alias("variance_ratio"))


@register("u03_pca_variance")
def u03_pca_variance(spark, sf):
    return cl.pca_variance(fx.lineitem_x(spark, sf), LN)


@register("u04_pca_projection")
def u04_pca_projection(spark, sf):
    return cl.pca_projection(fx.lineitem_x(spark, sf), LN)


def _hopkins_sql() -> str:
    k = len(EMB)
    st = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(EMB))
    z = ", ".join(f"({c} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END AS {c}" for i, c in enumerate(EMB))
    rg = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(EMB))
    uni = ", ".join(f"lo{j} + (hi{j} - lo{j}) * (CAST('0x' || substr(md5('42:u:' || CAST(i AS VARCHAR) || ':{j}'), 1, 8) "
                    f"AS UBIGINT) / 4294967296.0) AS u{j}" for j in range(k))
    du = " + ".join(f"pow(z.{c} - uni.u{j}, 2)" for j, c in enumerate(EMB))
    dw = " + ".join(f"pow(z.{c} - smp.{c}, 2)" for c in EMB)
    where = " AND ".join(f"{c} IS NOT NULL" for c in EMB)
    return (f"WITH e AS ({fx.EMB_SQL}), c AS (SELECT * FROM e WHERE {where}), st AS (SELECT {st} FROM c),\n"
            f"z AS (SELECT vec_id, {z} FROM c, st),\n"
            f"smp AS (SELECT * FROM z ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), {', '.join(EMB)} "
            f"LIMIT least(50, (SELECT count(*) FROM z))),\n"
            f"rg AS (SELECT {rg} FROM z),\n"
            f"uni AS (SELECT i, {uni} FROM rg, range(0, (SELECT count(*) FROM smp)) t(i)),\n"
            f"ud AS (SELECT uni.i, min(sqrt({du})) AS u FROM uni, z GROUP BY uni.i),\n"
            f"wd0 AS (SELECT smp.vec_id, sqrt({dw}) AS d FROM smp, z),\n"
            "wd AS (SELECT vec_id, count(*) FILTER (WHERE d = 0) AS zc, min(d) FILTER (WHERE d > 0) AS w FROM wd0 GROUP BY 1),\n"
            "t AS (SELECT (SELECT sum(u) FROM ud) AS su, (SELECT coalesce(sum(w), 0) FROM wd WHERE zc < 2) AS sw)\n"
            "SELECT round(CASE WHEN su + sw > 0 THEN su / (su + sw) ELSE 0.5 END, 4) AS hopkins_statistic, "
            "CAST((SELECT count(*) FROM smp) AS INTEGER) AS sample_size FROM t")


@register("u05_hopkins", _hopkins_sql())
def u05_hopkins(spark, sf):
    return cl.hopkins(fx.embeddings_wide(spark, sf), EMB, key="vec_id")


_SCANS: dict[tuple[str, str], list] = {}


def _scan(spark, sf):
    """One k-means scan an application and folder: its at most 7 result rows serve U06, U07 and U08."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _SCANS:
        _SCANS[at] = cl.kmeans_scan(fx.embeddings_wide(spark, sf), EMB).collect()
    return spark.createDataFrame(_SCANS[at], "k int, inertia double, silhouette double, suggested boolean")


@register("u06_kmeans_scan")
def u06_kmeans_scan(spark, sf):
    return _scan(spark, sf)


@register("u07_silhouette")
def u07_silhouette(spark, sf):
    return _scan(spark, sf).select("k", "silhouette")


@register("u08_suggested_k")
def u08_suggested_k(spark, sf):
    return _scan(spark, sf).where("suggested").select(F.col("k").alias("suggested_k"))
