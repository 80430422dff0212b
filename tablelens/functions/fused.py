"""Wide fused aggregates that stay inside whole-stage codegen.

Spark turns off whole-stage codegen for an aggregate whose buffer has more
than ``spark.sql.codegen.maxFields`` (100 by default) fields, and an
interpreted aggregate is several times slower. Central-moment aggregates use
3-5 buffer fields each, so a "one agg for every column" easily crosses the
limit. ``agg_one_row`` packs the expression groups into batches under the
limit; every batch is one aggregate over a column-pruned scan, and the
one-row results are cross-joined (one row by one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

DEFAULT_FIELDS = 90


def agg_one_row(df: DataFrame, groups: list[list[Column]], weights: list[int] | int,
                max_fields: int = DEFAULT_FIELDS) -> DataFrame:
    """One-row DataFrame holding every aggregate of ``groups`` (aliases must be unique).

    ``weights`` estimates the buffer fields of each group (or one number for all).
    A group is never split.
    """
    if isinstance(weights, int):
        weights = [weights] * len(groups)
    batches: list[list[Column]] = []
    current: list[Column] = []
    used = 0
    for g, w in zip(groups, weights):
        if current and used + w > max_fields:
            batches.append(current)
            current, used = [], 0
        current.extend(g)
        used += w
    if current:
        batches.append(current)
    out = df.agg(*batches[0])
    for b in batches[1:]:
        out = out.crossJoin(df.agg(*b))  # one row by one row
    return out
