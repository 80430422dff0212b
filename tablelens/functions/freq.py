"""Frequency table (shape 2 of the design).

``(column, position, value, n)`` for every column and every value, nulls kept
as a null value. It answers distinct counts, constant columns, top-k values,
modes, ID-like checks and class counts from one aggregate with map-side
partial aggregation: a hot value that holds a third of the rows is combined
inside each task before the shuffle, so no task sees it row by row.

Top-k per column uses ``row_number() <= k`` over a window partitioned by
column; Spark plans that as a partial ``WindowGroupLimit`` before the
exchange, so at most k rows per column and task are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tablelens.functions.columns import INTEGRAL_TYPES, as_text, q


def _slots(df: DataFrame, name: str):
    """(value, lval, dval): exactly one slot holds the cell, typed where the type allows."""
    dtype = df.schema[name].dataType
    c = q(name)
    none_s, none_l, none_d = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double")
    if isinstance(dtype, INTEGRAL_TYPES):
        return none_s, c.cast("long"), none_d
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return none_s, none_l, F.nanvl(c.cast("double"), none_d) + F.lit(0.0)   # NaN is missing; folds -0.0 into 0.0
    return as_text(df, name), none_l, none_d


def unpivot_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form ``(column, position, value)`` with the text rendering of each cell."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                      as_text(df, c).alias("value"))
             for i, c in enumerate(cols)]
    return df.select(F.inline(F.array(*cells)))


def _counted_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(position, value, lval, dval, n)``: the rows of each typed cell."""
    cells = [F.struct(F.lit(i).alias("position"), *[x.alias(n) for x, n in zip(_slots(df, c), ("value", "lval", "dval"))]) for i, c in enumerate(cols)]
    return df.select(F.inline(F.array(*cells))).groupBy("position", "value", "lval", "dval").agg(F.count(F.lit(1)).alias("n"))


def frequency_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Counts of each distinct value per column (nulls included as a null value).

    One scan: each row expands into a typed cell per column (``lval`` long, ``dval`` double, ``value``
    text for everything else), counted per task before the shuffle (Spark's hash aggregate, which goes
    on sorted and spilled when a task's distinct cells outgrow its memory). Numbers are hashed as numbers;
    ``value`` gets the text rendering only after aggregation. Result: ``(column, position, value, n)``.
    """
    cols = list(df.columns) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, position int, value string, n long")
    grouped = _counted_cells(df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    return grouped.select(names[F.col("position")].alias("column"), "position",
                          F.coalesce("value", F.col("lval").cast("string"), F.col("dval").cast("string")).alias("value"), "n")


def _summary(present, *keys: str):
    return lambda cells: cells.groupBy(*keys).agg(
        F.count(present).alias("unique_count"), F.count(F.lit(1)).alias("unique_with_null"),
        F.coalesce(F.sum(F.when(present.isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_count"),
        F.sum("n").cast("long").alias("n_rows"))


def distinct_summary(freq: DataFrame) -> DataFrame:
    """Per column: distinct without nulls, distinct with null counted, null count."""
    return _summary(F.col("value"), "column", "position")(freq)


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``distinct_summary`` of the named columns, ``position`` in the table: no value is rendered as text for it."""
    if not cols:
        return distinct_summary(frequency_table(df, cols))
    present = F.when(F.col("value").isNotNull() | F.col("lval").isNotNull() | F.col("dval").isNotNull(), 1)
    found = _summary(present, "position")(_counted_cells(df, cols))
    names, places = F.array(*[F.lit(c) for c in cols]), F.array(*[F.lit(df.columns.index(c)) for c in cols])
    return found.select(names[F.col("position")].alias("column"), places[F.col("position")].alias("position"),
                        "unique_count", "unique_with_null", "null_count", "n_rows")


def approx_distinct(df: DataFrame, cols: list[str], rsd: float = 0.02) -> DataFrame:
    """HyperLogLog++ distinct estimate per column, one fused agg (bounded memory)."""
    one = df.agg(*[F.approx_count_distinct(q(c), rsd).alias(f"d{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                     F.col(f"d{i}").alias("approx_unique"))
            for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """Top-k non-null values per column by count, ties by value text ascending."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (freq.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))
