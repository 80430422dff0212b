"""Deterministic md5 orders and exact "k lowest per group" selection.

``md5(seed || ':' || key)`` gives the same order in Spark and in DuckDB, so
splits and samples have exact oracles.

Selecting exactly the k rows with the smallest hash in every group must not
sort a whole group in one task (a group can hold a third of the rows). The
first 8 hex digits of md5 are uniform on [0, 1), so for a group of n rows the
k-th smallest value lies, with overwhelming probability, within a few
sqrt(p (1 - p) / n) of p = k / n. ``lowest_k`` therefore:

1. counts each group (map-side combined) and derives a bracket [lo, hi];
2. counts rows below and inside the bracket per group and *verifies*
   below <= k <= below + inside, widening the bracket of any group that fails;
3. keeps every row below the bracket and, among the bracket rows only
   (about 16 sqrt(n) per group), the first k - below by the full hash.

The result is exact; the only sorted sets are the brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import checkpoint_dir

SEED = 42
#: groups whose limits (one row each) may be broadcast after they have been counted
BROADCAST_GROUPS = 100_000


def md5_key(seed: int | str, key: Column) -> Column:
    """Hex digest of ``seed:key``; a null key counts as the empty text, so no row is lost."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def unit_hash(hexkey: Column) -> Column:
    """First 32 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(hexkey, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def lowest_k(df: DataFrame, key: Column, k_of_n, group_cols: list[str] | None = None,
             sigmas: float = 8.0, max_rounds: int = 6) -> DataFrame:
    """Rows whose ``key`` (hex digest) is among the ``k`` smallest of their group.

    ``k_of_n`` maps the group size column ``n`` to the wanted count column ``k``
    (a function Column -> Column), e.g. ``lambda n: F.round(n * 0.2)``.
    Returns ``df`` restricted to the chosen rows (columns unchanged).
    """
    flagged = flag_lowest_k(df, key, k_of_n, group_cols, sigmas, max_rounds)
    return flagged.where(F.col("__sel")).drop("__sel")


def flag_lowest_k(df: DataFrame, key: Column, k_of_n, group_cols: list[str] | None = None,
                  sigmas: float = 8.0, max_rounds: int = 6) -> DataFrame:
    """``df`` plus a boolean ``__sel``: true for the ``k`` smallest keys of each group.

    Both sides of a split come from this one frame (no anti-join). A null group is a
    group. Rows with equal keys are told apart by a running number, counted per
    distinct key of the bracket, so a key that repeats often is cut at the right
    count. The limits of the groups (one row per group) are broadcast when they are
    few (``BROADCAST_GROUPS``), so the table itself isn't shuffled.
    """
    groups = list(group_cols or [])
    gcols = [f"__g{i}" for i in range(max(1, len(groups)))]
    keys = [F.col(f"`{c}`") for c in groups] or [F.lit(0)]
    data = df.withColumn("__h", key).withColumn("__u", unit_hash(F.col("__h")))
    for g, c in zip(gcols, keys):
        data = data.withColumn(g, c)

    def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        r = right
        for g in gcols:
            r = r.withColumnRenamed(g, g + "r")
        on = None
        for g in gcols:
            e = left[g].eqNullSafe(r[g + "r"])
            on = e if on is None else on & e
        return left.join(r, on, how).drop(*[g + "r" for g in gcols])

    sizes = data.groupBy(*gcols).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__k", k_of_n(F.col("__n")).cast("long"))
    few = sizes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    small = F.broadcast if few else (lambda x: x)
    width = float(sigmas)
    for _ in range(max_rounds):
        p = F.col("__k") / F.col("__n")
        half = F.lit(width) * F.sqrt(p * (1 - p) / F.col("__n")) + F.lit(2.0) / F.col("__n") + F.lit(1e-9)
        br = sizes.withColumn("__lo", F.when(F.col("__k") <= 0, F.lit(-1.0)).otherwise(p - half)) \
                  .withColumn("__hi", F.when(F.col("__k") >= F.col("__n"), F.lit(2.0)).otherwise(p + half))
        tagged = matched(data, small(br))
        within = (F.col("__u") >= F.col("__lo")) & (F.col("__u") <= F.col("__hi"))
        check = tagged.groupBy(*gcols).agg(F.count_if(F.col("__u") < F.col("__lo")).alias("__below"),
                                           F.count_if(within).alias("__in"), F.first("__k").alias("__kk"))
        bad = check.where((F.col("__below") > F.col("__kk")) |
                          (F.col("__below") + F.col("__in") < F.col("__kk"))).limit(1).count()
        if bad == 0:
            break
        width *= 4.0
    else:
        raise RuntimeError("no bracket found for the k smallest keys of a group")
    # the key at which the group's count is reached, and how many rows of that key are taken
    counted = tagged.where(within).groupBy(*gcols, "__h").agg(F.count(F.lit(1)).alias("__m"))
    w = Window.partitionBy(*gcols).orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)  # distinct keys of a bracket
    upto = matched(counted, check.select(*gcols, "__below", "__kk")).withColumn("__upto", F.col("__below") + F.sum("__m").over(w))
    cut = upto.where((F.col("__upto") >= F.col("__kk")) & (F.col("__upto") - F.col("__m") < F.col("__kk"))).select(
        *gcols, F.col("__h").alias("__cut"), (F.col("__kk") - F.col("__upto") + F.col("__m")).alias("__take"), F.col("__m").alias("__same"))
    limits = matched(br.select(*gcols, "__lo"), cut, "left")     # no cut: the count is reached below the bracket
    out = matched(data, small(limits))
    sure = (F.col("__u") < F.col("__lo")) | (F.col("__h") < F.coalesce(F.col("__cut"), F.lit("")))
    whole = F.coalesce((F.col("__h") == F.col("__cut")) & (F.col("__take") >= F.col("__same")), F.lit(False))
    split = F.coalesce((F.col("__h") == F.col("__cut")) & (F.col("__take") < F.col("__same")), F.lit(False))
    plain = out.where(~split).select(*df.columns, (sure | whole).alias("__sel"))
    if cut.where(F.col("__take") < F.col("__same")).limit(1).count() == 0:
        return plain
    # rows of a key that is only taken in part: numbered by running counts over tasks, never sorted together
    spark = df.sparkSession
    checkpoint_dir(spark)
    part = out.where(split).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = part.withColumn("__p", F.shiftright("__id", 33))
    per = part.groupBy(*gcols, "__p").agg(F.count(F.lit(1)).alias("__c"))
    wp = Window.partitionBy(*gcols).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    per = per.withColumn("__before", F.coalesce(F.sum("__c").over(wp), F.lit(0))).withColumnRenamed("__p", "__q").drop("__c")
    nth = matched(part, per).where(F.col("__p") == F.col("__q")).withColumn(
        "__nth", F.col("__before") + F.row_number().over(Window.partitionBy(*gcols, "__p").orderBy("__id")))
    return plain.unionByName(nth.select(*df.columns, (F.col("__nth") <= F.col("__take")).alias("__sel")))


def split_by_value(df: DataFrame, order: Column, k: int, tiebreak: list[str] | None = None,
                   accuracy: int = 100000) -> tuple[DataFrame, DataFrame]:
    """(first k rows, the rest) by ``order`` then ``tiebreak``; null order values come last."""
    cols = df.columns
    flagged = _flag_first_k(df, order, k, tiebreak, accuracy)
    return flagged.where("__sel").select(*cols), flagged.where("NOT __sel").select(*cols)


def lowest_k_by_value(df: DataFrame, order: Column, k: int, accuracy: int = 100000, max_rounds: int = 6,
                      tiebreak: list[str] | None = None) -> DataFrame:
    """The ``k`` rows with the smallest ``order`` value, nulls last (ties by ``tiebreak`` columns, else by
    a hash of the whole row)."""
    return _flag_first_k(df, order, k, tiebreak, accuracy, max_rounds).where("__sel").select(*df.columns)


def _flag_first_k(df: DataFrame, order: Column, k: int, tiebreak: list[str] | None, accuracy: int,
                  max_rounds: int = 20) -> DataFrame:
    """``df`` plus ``__sel``: exactly ``k`` rows, those first in (order, tiebreak).

    The value at which the count is reached, and the rows below it, come from ``order_statistics``: rows
    below it are taken, rows above it not. Only rows of that one value are left, however many; they go
    by their tiebreak, of which the md5-bracketed ``flag_lowest_k`` (no tiebreak) or
    a second value cut (a single numeric tiebreak) takes the rest. So no task sorts a hot value.
    """
    cols = df.columns
    n = df.count()
    if k <= 0 or k >= n:
        return df.withColumn("__sel", F.lit(k >= n))
    from tablelens.functions.ranks import order_statistics
    data = df.withColumn("__o", F.nanvl(order.cast("double"), F.lit(None).cast("double")))
    n_known, at = order_statistics(data, {"o": F.col("__o")}, lambda m: [k - 1] if k < m else [], max_rounds=max_rounds)["o"]
    if k >= n_known:
        known = data.where("__o IS NOT NULL")
        rest = _flag_ties(data.where("__o IS NULL"), cols, k - n_known, tiebreak, accuracy)
        return known.select(*cols, F.lit(True).alias("__sel")).unionByName(rest)
    value, below = at[k - 1]
    ties = _flag_ties(data.where(F.col("__o") == F.lit(value)), cols, k - below, tiebreak, accuracy)
    sure = data.where(F.col("__o").isNull() | (F.col("__o") != F.lit(value)))
    return sure.select(*cols, F.coalesce(F.col("__o") < F.lit(value), F.lit(False)).alias("__sel")).unionByName(ties)


def _flag_ties(rows: DataFrame, cols: list[str], k: int, tiebreak: list[str] | None, accuracy: int) -> DataFrame:
    """``cols`` plus ``__sel`` for the first ``k`` rows of one order value."""
    if tiebreak and len(tiebreak) >= 1 and dict(rows.dtypes)[tiebreak[0]] in ("tinyint", "smallint", "int", "bigint", "double", "float"):
        base = rows.select(*cols)
        return _flag_first_k(base, F.col(f"`{tiebreak[0]}`"), k, tiebreak[1:] or None, accuracy)
    key = F.struct(*[F.col(f"`{c}`") for c in (tiebreak or cols)])
    return flag_lowest_k(rows.select(*cols), F.md5(F.to_json(key)), lambda m: F.least(m, F.lit(int(max(0, k)))))
