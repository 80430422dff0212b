"""Equal rows in two phases: 128-bit digests first, values only where digests meet.

Equal rows have equal digests, so a row whose digest occurs once is unique and its values never leave
their task: only (digest, count) is shuffled, combined inside each task. Rows whose digest is shared
are then grouped by value, which makes the answer exact also where different rows collide. The shared
digests are broadcast after a count; more than ``BROADCAST_DIGESTS`` are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import FLOAT_TYPES, q
from tablelens.session import written

#: shared digests (16 bytes each) that may be broadcast
BROADCAST_DIGESTS = 500_000


def comparable(df: DataFrame, name: str) -> Column:
    """The column as grouping compares it: maps by their JSON text."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.to_json(F.struct(q(name).alias("v"))).alias(name)
    return q(name)


def digest(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of the whole row; -0.0 hashes as 0.0, as grouping compares them."""
    cells = []
    for f in df.schema.fields:
        x = comparable(df, f.name)
        cells += [x.isNull(), x + F.lit(0.0) if isinstance(f.dataType, FLOAT_TYPES) else x]
    return F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)


def repeated_rows(df: DataFrame) -> DataFrame:
    """The distinct rows that occur more than once, with their number in a last column ``__n``."""
    names = [comparable(df, c) for c in df.columns]
    first, second = digest(df)
    marked = df.select(*names, first.alias("__d1"), second.alias("__d2"))
    # the digests are taken straight from the table: its values are not part of this shuffle
    shared = written(df.select(first.alias("__d1"), second.alias("__d2")).groupBy("__d1", "__d2").agg(F.count(F.lit(1)).alias("__c"))
                     .where("__c > 1").select("__d1", "__d2"))
    few = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    met = marked.join(F.broadcast(shared) if few else shared, ["__d1", "__d2"], "left_semi")
    return met.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
