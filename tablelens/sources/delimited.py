"""Delimited text (S02, S03, S05): quoted line breaks, rows with too many or too few fields, inferred types.

A quote opens a quoted field only at the field's start; two quotes inside it are one; line breaks and
separators inside it belong to the value. Blank lines are skipped, rows with more fields than
the header are skipped, shorter rows end in nulls, empty fields are null. Every file of a folder starts
with the header. Files are read split by split (see ``splits``); the fields are written once as text, and
the types are inferred from all rows.
"""

from __future__ import annotations

import csv
import io
import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.columns import q
from tablelens.sources import splits

#: text forms of the inferred types (besides that Spark must be able to read them)
_INTEGER, _NUMBER = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity|NaN)\s*$"
_DATE, _TIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"


def inside_after(line: str, sep: str, inside: bool) -> bool:
    """Whether the end of the line lies inside a quoted field, given whether its start does."""
    at = 0
    while True:
        if inside:
            end = line.find('"', at)
            if end < 0:
                return True
            if line[end + 1:end + 2] == '"':
                at = end + 2
                continue
            at, inside = end + 1, False
        elif line[at:at + 1] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def fields(text: str, sep: str) -> list[list[str]]:
    """The fields of all records of a text, blank lines left out."""
    csv.field_size_limit(sys.maxsize)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    return [r for r in rows if len(r) > 1 or (r and r[0].strip())]


def column_names(header: list[str]) -> list[str]:
    """Unique names: an empty one by its place, a repeated one with a number."""
    out: list[str] = []
    for i, name in enumerate(header):
        base = name if name.strip() else f"Unnamed: {i}"
        n, new = 0, base
        while new.lower() in {o.lower() for o in out}:
            n, new = n + 1, f"{base}.{n + 1}"
        out.append(new)
    return out


def _typed(df: DataFrame) -> DataFrame:
    """Columns cast to the narrowest of int, long, double, date, timestamp, boolean that holds all their values."""
    # one bit a value: the first of the nested kinds (int, bigint, double) or the one other kind that its text form allows
    kinds = {"double": (_NUMBER, 4), "date": (_DATE, 8), "timestamp": (_TIME, 16),
             "boolean": (r"(?i)^(true|false)$", 32)}
    holds = {"int": 1, "bigint": 3, "double": 7, "date": 8, "timestamp": 16, "boolean": 32}

    def bit(x: Column) -> Column:
        whole = F.when(x.try_cast("int").isNotNull(), 1).when(x.try_cast("bigint").isNotNull(), 2).when(
            x.try_cast("double").isNotNull(), 4).otherwise(64)
        out = F.when(x.isNull(), 0).when(x.rlike(_INTEGER), whole)
        for kind in ("double", "date", "timestamp", "boolean"):
            form, b = kinds[kind]
            out = out.when(x.rlike(form) & x.try_cast(kind).isNotNull(), b)
        return out.otherwise(64)

    got = df.agg(*[F.bit_or(bit(q(c))).alias(f"b{i}") for i, c in enumerate(df.columns)]).first()    # one row
    out = []
    for i, c in enumerate(df.columns):
        kind = next((k for k, bits in holds.items() if got[f"b{i}"] and not got[f"b{i}"] & ~bits), None)
        out.append((q(c).try_cast(kind) if kind else q(c)).alias(c))
    return df.select(*out)


def read_delimited(spark: SparkSession, path: str, sep: str, infer: bool = True) -> DataFrame:
    """The table of a file or folder of delimited text with a header; a table without columns where there is no header."""
    def step(line: str, inside: bool, depth: int) -> tuple[bool, int, bool]:
        if '"' in line:
            inside = inside_after(line, sep, inside)
        return inside, 0, not inside

    parts = splits.pieces(spark, path, "\n")
    starts = splits.entries(parts, "\n", step, lambda line: '"' not in line, marks='"')
    header = starts.where("block = 0").agg(F.min_by("first", "file")).first()[0]
    head = fields(header, sep) if header else []
    if not head:
        text = "\n".join(r["value"] for r in parts.orderBy("file", "block", "place").limit(100).select("value").collect())
        head = fields(text, sep)[:1]
    if not head:
        return spark.createDataFrame([], "")
    names = column_names(head[0])
    width = len(names)

    def parse(text: str, begins: bool) -> list[tuple]:
        rows = fields(text, sep)[1 if begins else 0:]
        return [tuple(v or None for v in r) + (None,) * (width - len(r)) for r in rows if len(r) <= width]

    def plain(lines: pa.Array) -> list[pa.Array] | None:
        if pc.any(pc.match_substring_regex(lines, '["\r\n]')).as_py():
            return None
        cells = pc.split_pattern(lines, sep)
        many = pc.list_value_length(cells)
        if width < 2 or pc.min(many).as_py() < width:
            return None                                                      # blank or short lines
        flat = pc.list_flatten(cells.filter(pc.equal(many, width)))
        flat = pc.if_else(pc.equal(flat, ""), pa.scalar(None, pa.string()), flat)
        at = pa.array(range(0, len(flat), width), pa.int64())
        return [flat.take(pc.add(at, j)) for j in range(width)]

    strings = splits.records(parts, starts, "\n", step, lambda inside, depth: not inside, (False, 0), parse, names, plain)
    return _typed(strings) if infer else strings
