"""Fused per-column aggregate (shape 1 of the design).

All per-column moments of many columns come out of a single ``agg`` over a
single scan. Partial aggregation runs map-side, so the shuffle carries one
small buffer per task, not rows. The one-row result is unpivoted into one row
per column with ``inline(array(struct ...))``.

Corrected moments follow the pandas definitions:
  G1 = g1 * sqrt(n (n - 1)) / (n - 2)                     (n >= 3)
  G2 = (n - 1) / ((n - 2)(n - 3)) * ((n + 1) g2 + 6)      (n >= 4)
with 0.0 for a constant column (pandas returns 0, Spark returns null).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import is_float, q
from tablelens.functions.fused import agg_one_row
from tablelens.functions.ranks import order_statistics

QUANTILES = (0.25, 0.5, 0.75)


def finite(x: Column) -> Column:
    """A statistic that is infinite or NaN is dropped (null), as the profile does."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def sample_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(x) == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.var_pop(x) == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def quantiles(x: Column, probs: Iterable[float] = QUANTILES, accuracy: int = 100000) -> Column:
    """Approximate quantiles (the bounded sketch ``percentile_approx``) as an array column."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return F.percentile_approx(x.cast("double"), arr, accuracy).cast("array<double>")


def present(x: Column) -> Column:
    """The value as a double; NaN counts as missing."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def gone(df: DataFrame, name: str) -> Column:
    """The cell is missing: null, or NaN in a float column."""
    return q(name).isNull() | F.isnan(q(name)) if is_float(df, name) else q(name).isNull()


def complete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The rows without a null in the columns (of a frame whose NaN are null already, see ``present``).

    One condition a column: the single condition of ``dropna`` names them all, and Catalyst doubles the
    constraints it infers from it with every renamed column (64 columns don't end).
    """
    cols = list(df.columns) if cols is None else cols
    return df.where(functools.reduce(lambda a, b: a & b, [q(c).isNotNull() for c in cols], F.lit(True)))


def numeric_stats(df: DataFrame, cols: list[str], exact: bool = True, quartiles: bool = True) -> DataFrame:
    """One row per numeric column: n, mean, std, min, q25, q50, q75, max, skew, kurtosis.

    Moments come from one scan (``functions.scan_moments``), quantiles from ``exact_quantiles``, the
    same bounded method at every size (``exact=False``: one ``percentile_approx``);
    ``quartiles=False`` leaves those out (null). Statistics that are not finite are null.
    """
    from tablelens.functions.scan_moments import column_statistics
    spark = df.sparkSession
    schema = ("column string, position int, n long, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double, skew double, kurtosis double")
    if not cols:
        return spark.createDataFrame([], schema)
    if not quartiles:
        qv = {c: [None] * 3 for c in cols}
    elif exact:
        qv = exact_quantiles(df, cols)
    else:
        got = df.agg(*[quantiles(present(q(c))).alias(f"qa{i}") for i, c in enumerate(cols)]).first()
        qv = {c: got[f"qa{i}"] or [None] * 3 for i, c in enumerate(cols)}
    rows = []
    for i, (c, s) in enumerate(zip(cols, column_statistics(df, cols))):
        q3 = [x if x is not None and math.isfinite(x) else None for x in qv[c]]
        rows.append((c, i, s["n"], s["mean"], s["std"], s["min"], *q3, s["max"], s["skew"], s["kurtosis"]))
    return spark.createDataFrame(rows, schema)


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: position, rows, missing count (null or NaN) — one fused agg."""
    cols = list(df.columns) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, position int, n_rows long, missing_count long")
    groups = [[F.count(F.lit(1)).alias("\u0001rows")]]
    for i, c in enumerate(cols):
        groups.append([F.count_if(gone(df, c)).alias(f"m{i}")])
    one = agg_one_row(df, groups, 1)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                     F.col("`\u0001rows`").alias("n_rows"),
                     F.col(f"m{i}").cast("long").alias("missing_count"))
            for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def exact_quantiles(df: DataFrame, cols: list[str] | dict[str, Column], probs: Iterable[float] = QUANTILES,
                    max_bracket: int = 200_000, max_rounds: int = 20, nearest: bool = False) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles per column, with bounded memory at any scale.

    ``cols``: column names, or expressions by name. The interpolated quantile at p needs the order
    statistics of rank floor((n-1)p) and ceil((n-1)p); those of all columns and probabilities are
    found together in two or three passes (see ``functions.ranks``). Equals ``percentile``;
    ``nearest`` takes the order statistic nearest to the position instead. Null and NaN don't count.
    """
    probs = [float(p) for p in probs]
    if not cols:
        return {}

    def place(n: int, p: float) -> float:
        return float(round((n - 1) * p)) if nearest else (n - 1) * p

    def ranks(n: int) -> list[int]:
        return [f(place(n, p)) for p in probs for f in (math.floor, math.ceil)]

    exprs = {c: present(x) for c, x in (cols.items() if isinstance(cols, dict) else ((c, q(c)) for c in cols))}
    out: dict[str, list[float | None]] = {}
    for c, (n, at) in order_statistics(df, exprs, ranks, max_bracket, max_rounds).items():
        out[c] = [None] * len(probs)
        for j, p in enumerate(probs if n else []):
            pos = place(n, p)
            lo, hi = math.floor(pos), math.ceil(pos)
            x, y = at[lo][0], at[hi][0]
            out[c][j] = x if x == y else (hi - pos) * x + (pos - lo) * y
    return out


def quantile_row(df: DataFrame, cols: list[str], probs: Iterable[float] = QUANTILES, exact: bool = True,
                 prefix: str = "q") -> DataFrame:
    """One row with an array column ``<prefix><i>`` of quantiles per column."""
    probs = [float(p) for p in probs]
    if exact:
        qv = exact_quantiles(df, cols, probs)
        return df.sparkSession.createDataFrame([tuple(qv[c] for c in cols)],
                                               ", ".join(f"`{prefix}{i}` array<double>" for i in range(len(cols))))
    return df.agg(*[quantiles(present(q(c)), probs).alias(f"{prefix}{i}") for i, c in enumerate(cols)])
