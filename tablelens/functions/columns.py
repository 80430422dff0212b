"""Column families and value normalisation.

The analysis code branches on five families only: numeric, boolean,
datetime, string, and "other" (nested values, which are profiled through
their JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


def dtype_name(dtype: T.DataType) -> str:
    return dtype.simpleString()


def numeric_columns(df: DataFrame, limit: int | None = None,
                    exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that get numeric statistics (booleans excluded), in schema order."""
    cols = [f.name for f in df.schema.fields
            if family(f.dataType) == "numeric" and f.name not in exclude]
    return cols[:limit] if limit is not None else cols


def categorical_columns(df: DataFrame, limit: int | None = None,
                        exclude: tuple[str, ...] = ()) -> list[str]:
    """Every non-numeric column (strings, booleans, dates, nested), in schema order."""
    cols = [f.name for f in df.schema.fields
            if family(f.dataType) != "numeric" and f.name not in exclude]
    return cols[:limit] if limit is not None else cols


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOAT_TYPES)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere: turn it into null once, at load."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs) if changed else df


def q(name: str) -> Column:
    """Column reference that survives dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    """Text rendering used as the value of the frequency table.

    Numbers are compared as numbers elsewhere; here only identity matters, so
    negative zero is folded into zero and nested values go through JSON.
    """
    dtype = df.schema[name].dataType
    c = q(name)
    if isinstance(dtype, FLOAT_TYPES):
        return (F.nanvl(c, F.lit(None).cast(dtype)) + F.lit(0.0)).cast("string")
    if isinstance(dtype, NESTED_TYPES):
        return F.to_json(c) if not isinstance(dtype, T.ArrayType) else F.to_json(F.struct(c.alias("v")))
    return c.cast("string")
