"""Test-table bindings: derived frames built the same way in Spark and in SQL.

The provided tables have no nulls, duplicates or constant columns, so the
bindings derive them with deterministic expressions. Each binding has a Spark
builder and the identical SQL text (a CTE body) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.sources.tables import read_table

# lineitem with planted nulls (l_quantity ~1/15, l_tax ~1/6, l_linestatus ~1/4) and a constant.
LX_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
              "l_shipdate", "l_const"]
LX_NUMERIC = LX_COLUMNS[:8]
LX_CATEGORICAL = ["l_returnflag", "l_linestatus", "l_shipdate", "l_const"]

LX_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount,
  CASE WHEN l_linenumber >= 6 THEN NULL ELSE l_tax END AS l_tax,
  l_returnflag,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus END AS l_linestatus,
  l_shipdate, 'x' AS l_const
FROM lineitem"""


def lineitem_x(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") >= 6, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag",
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        "l_shipdate", F.lit("x").alias("l_const"))


# lineitem projected to three low-cardinality columns: many exact duplicate rows.
LD_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]
LD_SQL = "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem"


def lineitem_dup(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(*LD_COLUMNS)


# The four numeric lineitem measures used by correlation, regression and clustering steps.
LN_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_num(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(*LN_COLUMNS)


# documents joined to labels: a binary target with numeric and categorical features.
DL_SQL = """SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def documents_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id")


# lineitem with leak-like columns derived from the target l_extendedprice.
LK_SQL = """SELECT l_orderkey * 8 + l_linenumber AS l_rowkey, l_quantity, l_discount, l_tax,
  l_returnflag, l_extendedprice * 2 AS price_final, l_extendedprice AS label_copy,
  CAST(l_extendedprice AS VARCHAR) AS price_text, l_extendedprice
FROM lineitem"""
LK_COLUMNS = ["l_rowkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "price_final",
              "label_copy", "price_text", "l_extendedprice"]


def lineitem_leak(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("l_rowkey"),
                     "l_quantity", "l_discount", "l_tax", "l_returnflag",
                     (F.col("l_extendedprice") * 2).alias("price_final"),
                     F.col("l_extendedprice").alias("label_copy"),
                     F.col("l_extendedprice").cast("string").alias("price_text"), "l_extendedprice")


# Events rolled up to days: count and mean value per day.
EVENTS_DAILY_SQL = """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, count(*) AS n_events,
  avg(value) AS value
FROM events GROUP BY 1"""


def events_daily(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    return (ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
            .agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("value")))


# Orders rolled up to months: total price per month start.
ORDERS_MONTHLY_SQL = """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts,
  sum(o_totalprice) AS value
FROM orders GROUP BY 1"""


def orders_monthly(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return (o.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts"))
            .agg(F.sum("o_totalprice").alias("value")))


# All embedding dimensions (doubles) with the id and label.
EMB_DIM = 64
EMB_FEATURES = [f"e{i}" for i in range(EMB_DIM)]
EMB_SQL = ("SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMB_DIM))
           + ", label FROM embeddings")


def embeddings_wide(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_DIM)], "label")
