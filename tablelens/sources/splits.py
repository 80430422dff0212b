"""Records that a byte split may cut: quoted line breaks in delimited text, elements of one large JSON array.

Spark's text source hands out *pieces* (the text up to each separator) split by bytes, so no file is read by
one task. Whether a piece starts inside a quoted string depends on all before it. Hence two passes:

1. Each split is read for both possible entries (outside, inside) and returns a map: entry -> (exit, change
   of depth). With two states a map is constant, the identity or the exchange, so the maps compose over a
   file's splits by window functions on one row a split: the entry of a split is the last constant before
   it, exchanged as often as there were exchanges since; depths add up.
2. Each split is read from its known entry and written: records that lie within it as rows, and as
   fragments what is open at its end and what closes that at the head of the next splits (at most two a
   split). Fragments of one record are then put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.session import written

#: splits in another state than a file's first one that may be broadcast after a count; more are joined by a shuffle
BROADCAST_SPLITS = 100_000

#: (piece, inside, depth) -> (inside, depth, a record ends with the piece)
Step = Callable[[str, bool, int], tuple[bool, int, bool]]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, place, value): the pieces, in the order of the file within a split (file, block)."""
    value = F.when(F.col("value").startswith("﻿"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), value.alias("value"))


def _stretches(batches: Iterable[pa.RecordBatch], names: list[str], before: tuple | None = None) -> Iterator[tuple[tuple, bool, list[str]]]:
    """(key, the split starts here, values) for consecutive pieces of one split; ``before``: the key of the pieces before."""
    for b in batches:
        rows = b.to_pydict()
        keys, start = list(zip(*[rows[n] for n in names])), 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                yield keys[start], keys[start] != before, rows["value"][start:at]
                before, start = keys[start], at


def _goes_on(b: pa.RecordBatch, key: tuple | None) -> bool:
    """Whether all pieces of the batch belong to the split ``key`` (a split's pieces lie together)."""
    ends = (0, b.num_rows - 1)
    return key is not None and b.num_rows > 0 and all((b["file"][i].as_py(), b["block"][i].as_py()) == key[:2] for i in ends)


def entries(parts: DataFrame, separator: str, step: Step, neutral: Callable[[str], bool],
            marks: str | None = None) -> DataFrame:
    """(file, block, inside, depth, first): the state in which each split starts; ``first`` is a file's first record.

    Pieces that are ``neutral`` change no state; with ``marks`` given, all pieces without this text are.
    """
    schema = "file string, block long, out_to boolean, out_depth long, in_to boolean, in_depth long, first string"

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        key, opening = None, None
        for b in batches:
            if marks and opening is None and _goes_on(b, key) and not pc.any(pc.match_substring(b["value"], marks)).as_py():
                continue
            for key_, new, values in _stretches([b], ["file", "block"], key):
                key, block = key_, key_[1]
                if new:
                    found.append([*key, False, 0, True, 0, None])
                    opening = [] if block == 0 else None
                    state = (False, 0)
                row = found[-1]
                for v in values:
                    if opening is not None:
                        opening.append(v + separator)
                        *state, ends = step(v, *state)
                        if ends:
                            row[6], opening = "".join(opening), None
                    if not neutral(v):
                        row[2], row[3], _ = step(v, row[2], row[3])
                        row[4], row[5], _ = step(v, row[4], row[5])
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate(types)], [c.split()[0] for c in schema.split(", ")])

    table = written(parts.select("file", "block", "value").mapInArrow(maps, schema))         # one row a split
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("swaps", F.sum((F.col("out_to") & ~F.col("in_to")).cast("int")).over(upto))
    fixed = F.when(F.col("out_to") == F.col("in_to"), F.struct(F.col("out_to").cast("int").alias("to"), "swaps"))
    table = table.withColumn("last", F.last(fixed, ignorenulls=True).over(past)).withColumn("before", F.coalesce(F.max("swaps").over(past), F.lit(0)))
    table = table.withColumn("inside", (F.coalesce("last.to", F.lit(0)) + F.col("before") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1)
    change = F.when(F.col("inside"), F.col("in_depth")).otherwise(F.col("out_depth"))
    return table.withColumn("change", change).select("file", "block", "inside", F.coalesce(F.sum("change").over(past), F.lit(0)).alias("depth"), "first")


def records(parts: DataFrame, starts: DataFrame, separator: str, step: Step, between: Callable[[bool, int], bool], usual: tuple[bool, int],
            parse: Callable[[str, bool], list[tuple]], columns: list[str],
            plain: Callable[[pa.Array], list[pa.Array] | None] | None = None) -> DataFrame:
    """The string columns that ``parse(text of whole records, it begins a file)`` makes of all records.

    ``between(inside, depth)`` says that a split in this state starts with a new record; ``usual`` is the
    state of most splits, which isn't sent along. ``plain`` gives the columns of pieces that are whole records
    each, as ``parse`` would, or None where it can't.
    """
    odd = starts.where(((F.col("inside") != usual[0]) | (F.col("depth") != usual[1])) & (F.col("block") > 0)).drop("first")
    if odd.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        known = parts.join(F.broadcast(odd), ["file", "block"], "left")                     # keeps the order of the pieces
    else:
        known = parts.join(odd, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "place")
    first = F.col("block") == 0
    known = known.select("file", "block", F.when(first, False).otherwise(F.coalesce("inside", F.lit(usual[0]))).alias("inside"),
                         F.when(first, 0).otherwise(F.coalesce("depth", F.lit(usual[1]))).alias("depth"), "value")
    names = [f"c{i}" for i in range(len(columns))] + ["file", "block", "kind", "text"]
    schema = ", ".join(f"`{n}` string" for n in names[:-3]) + ", block long, kind int, text string"

    def batch(rows: list[tuple] = (), torn: list[tuple] = ()) -> pa.RecordBatch:
        cells = [pa.array([r[j] for r in rows] + [None] * len(torn), pa.string()) for j in range(len(columns))]
        gone = [None] * len(rows)
        cells += [pa.array(gone + [t[j] for t in torn], t_) for j, t_ in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays(cells, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, head, begins = None, [], False, False

        def rest() -> list[tuple]:
            return [(*key, 0 if head else 1, "".join(open_))] if open_ else []

        last, state = None, usual
        for b in batches:
            if plain and not (open_ or head or begins) and tuple(state) == usual and _goes_on(b, key):
                cells = plain(b["value"])
                if cells is not None:
                    gone = [pa.nulls(len(cells[0]), t) for t in (pa.string(), pa.int64(), pa.int32(), pa.string())]
                    yield pa.RecordBatch.from_arrays(cells + gone, names)
                    continue
            for (file, block, inside, depth), new, values in _stretches([b], ["file", "block", "inside", "depth"], last):
                last = (file, block, inside, depth)
                if new:
                    if key is not None and open_:
                        yield batch(torn=rest())
                    key, state, open_, begins = (file, block), (inside, depth), [], block == 0
                    head = block > 0 and not between(inside, depth)
                whole = []
                for v in values:
                    open_.append(v + separator)
                    *state, ends = step(v, *state)
                    if ends:
                        if head:
                            yield batch(torn=rest())
                            head = False
                        else:
                            whole += open_
                        open_ = []
                if whole:
                    yield batch(rows=parse("".join(whole), begins))
                    begins = False
        if key is not None and open_:
            yield batch(torn=rest())

    table = written(known.mapInArrow(cut, schema))
    # a rest (kind 1) opens a record, the heads (kind 0) of later splits up to the next rest go on with it
    order = Window.partitionBy("file").orderBy("block", "kind")
    torn = table.where("kind IS NOT NULL").select("file", "block", "kind", "text").withColumn("record", F.sum("kind").over(order))
    texts = (torn.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("f"))
             .select((F.col("f")[0]["block"] == 0).alias("begins"), F.array_join(F.transform("f", lambda f: f["text"]), "").alias("text"), "file"))
    begun = starts.where("block = 0 AND first IS NOT NULL").select("file", F.lit(True).alias("has_first"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, begins in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield batch(rows=parse(text, begins))

    # only a file whose first record fills its first split begins with a torn one
    mended = texts.join(begun, "file", "left").select("text", (F.col("begins") & F.col("has_first").isNull()).alias("begins")).mapInArrow(mend, schema)
    return table.where("kind IS NULL").unionByName(mended).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
