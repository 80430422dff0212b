"""Loading user tables.

One read path: the file type comes from the name, the reader is a Spark
source with options, NaN becomes null once, and large tables can be sampled
to an exact size by md5 order without a driver-side merge.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import nan_to_null
from tablelens.functions.sampling import SEED, lowest_k, md5_key
from tablelens.sources.delimited import read_delimited
from tablelens.sources.json_array import read_json_array

# Fixed values that must equal the reference's rules.
# File extension -> file type (case-insensitive):
EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".xlsx": "excel", ".xls": "excel", ".json": "json",
              ".jsonl": "json_lines", ".ndjson": "json_lines", ".parquet": "parquet"}
DELIMITER_CANDIDATES = [",", ";", "\t", "|"]
SNIFF_BYTES = 64 * 1024
SAMPLE_THRESHOLD = 1_000_000
SAMPLE_SIZE = 100_000
PREVIEW_ROWS = 500


class LoadError(ValueError):
    """Any problem reading a user file: unknown type, empty data, parse failure."""


def file_type(name: str) -> str:
    """The file type from the file name; unknown extensions raise with the sorted list."""
    ext = os.path.splitext(name)[1].lower()
    if ext not in EXTENSIONS:
        raise LoadError(f"Unsupported file type '{ext or name}'. Supported: {', '.join(sorted(EXTENSIONS))}")
    return EXTENSIONS[ext]


def file_type_expr(name: Column) -> Column:
    """S01 as an expression over a column of names (null for unsupported names)."""
    path = F.regexp_replace(name, r"[?#].*$", "")
    low = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    m = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return m[low]


def sniff_delimiter(spark: SparkSession, path: str, default: str = ",") -> str:
    """The candidate whose count per line is the same non-zero number on most lines
    of the first 64 KiB (one bounded read of the file head)."""
    size, kept = 0, []
    for row in spark.read.text(path, wholetext=False).toLocalIterator():  # stops after SNIFF_BYTES
        size += len(row[0].encode("utf-8")) + 1
        if size > SNIFF_BYTES:
            break
        kept.append(row[0])
    kept = [ln for ln in kept if ln.strip()]
    best, best_score = default, 0
    for cand in DELIMITER_CANDIDATES:
        counts = [ln.count(cand) for ln in kept]
        nonzero = [c for c in counts if c > 0]
        if not nonzero:
            continue
        mode = max(set(nonzero), key=lambda c: (nonzero.count(c), c))
        score = sum(1 for c in counts if c == mode)
        if score > best_score:
            best, best_score = cand, score
    return best


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8",
             skip_bad_lines: bool = True) -> DataFrame:
    """Header, inferred types, quoted line breaks; rows with too many fields are skipped,
    too-short rows are kept with nulls (see ``delimited``)."""
    sep = sep or sniff_delimiter(spark, path)
    if encoding.upper().replace("-", "") == "UTF8" and skip_bad_lines:
        return read_delimited(spark, path, sep)
    # other encodings: Spark's own reader, where a line break always ends a record
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"')
    inferred = reader.option("inferSchema", True).csv(path)
    if not skip_bad_lines:
        return inferred
    extra = "extra"
    while extra.lower() in {c.lower() for c in inferred.columns}:
        extra += "_"
    schema = T.StructType(inferred.schema.fields + [T.StructField(extra, T.StringType(), True)])
    full = reader.schema(schema).option("mode", "PERMISSIVE").csv(path)
    return full.where(F.col(extra).isNull()).drop(extra)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that begin with a bracket are JSON arrays, cut into their elements by many tasks; else JSON Lines."""
    first = spark.read.option("lineSep", "}").text(path).where(F.trim("value") != "").limit(1).collect()  # text up to one brace
    array = bool(first) and first[0][0].lstrip("\ufeff \t\r\n").startswith("[")
    table = read_json_array(spark, path) if array else spark.read.json(path)
    if "_corrupt_record" in table.columns:
        raise LoadError(f"Could not parse {os.path.basename(path)} as JSON or JSON Lines")
    return table


@dataclass
class LoadInfo:
    df: DataFrame
    total_rows: int
    is_sampled: bool
    sample_size: int | None


def load_dataset(spark: SparkSession, path: str, sample_threshold: int | None = None,
                 sample_size: int = SAMPLE_SIZE, seed: int = SEED, sep: str | None = None,
                 encoding: str = "UTF-8") -> LoadInfo:
    """Read by type, NaN to null, reject empty data; all rows unless a ``sample_threshold``
    (``SAMPLE_THRESHOLD`` is the usual one) asks for an exact-size sample of larger tables."""
    kind = file_type(path)
    try:
        if kind in ("csv", "tsv"):
            df = read_csv(spark, path, sep=sep or ("\t" if kind == "tsv" else None), encoding=encoding)
        elif kind == "json":
            df = read_json(spark, path)
        elif kind == "json_lines":
            df = spark.read.json(path)
        elif kind == "parquet":
            df = spark.read.parquet(path)
        else:
            raise LoadError("Excel files are not supported by this reader; convert to CSV or Parquet")
    except LoadError:
        raise
    except Exception as exc:  # noqa: BLE001 - every parse failure becomes one error type
        raise LoadError(f"Could not read {os.path.basename(path)}: {exc}") from exc
    if not df.columns:
        raise LoadError("The file has no columns")
    df = nan_to_null(df)
    total = df.count()
    if total == 0:
        raise LoadError("The file has no data rows")
    if sample_threshold is not None and total > sample_threshold:
        return LoadInfo(exact_sample(df, sample_size, seed), total, True, sample_size)
    return LoadInfo(df, total, False, None)


def row_key(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def exact_sample(df: DataFrame, size: int, seed: int = SEED, key: str | None = None) -> DataFrame:
    """Exactly ``size`` rows, the smallest ``md5(seed:key)`` (key = the row's JSON when
    no key column is named). Distributed, no driver merge (see ``lowest_k``)."""
    k = md5_key(seed, F.col(f"`{key}`") if key else row_key(df))
    return lowest_k(df, k, lambda n: F.least(n, F.lit(int(size))))


def preview(df: DataFrame, order_by: list[str], offset: int = 0, limit: int = PREVIEW_ROWS) -> DataFrame:
    """A page of the first 500 rows in key order; offset >= 0, limit clamped to 1..500."""
    offset = max(0, int(offset))
    limit = max(1, min(PREVIEW_ROWS, int(limit)))
    first = nan_to_null(df).orderBy(*order_by).limit(PREVIEW_ROWS)
    return first.offset(offset).limit(limit)
