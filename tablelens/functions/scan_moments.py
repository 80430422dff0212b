"""Count, mean, central moments, minimum and maximum of many columns from one scan.

A batch is centred on a value near each column's mean, so its power sums don't cancel; batches
and tasks merge by the pairwise update of central moments. A task sends one row a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tablelens.functions.columns import q
from tablelens.functions.gram import _centred
from tablelens.functions.moments import present


@dataclass
class Moments:
    """n, mean, sums of the 2nd to 4th powers of deviations, smallest and largest value, plain sum of one or many columns.

    The plain sum gives the mean that is returned: exact for whole numbers, as ``avg`` is.
    """

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    m3: np.ndarray
    m4: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    total: np.ndarray

    def merged(self, o: Moments) -> Moments:
        with np.errstate(all="ignore"):
            n = self.n + o.n
            some = np.maximum(n, 1)
            d = np.where((self.n > 0) & (o.n > 0), o.mean - self.mean, 0.0)
            a, b, x = self.n, o.n, self.n * o.n / some
            mean = np.where(a > 0, np.where(b > 0, self.mean + d * b / some, self.mean), o.mean)
            m2 = self.m2 + o.m2 + d * d * x
            m3 = self.m3 + o.m3 + d ** 3 * x * (a - b) / some + 3 * d * (a * o.m2 - b * self.m2) / some
            m4 = (self.m4 + o.m4 + d ** 4 * x * (a * a - a * b + b * b) / some ** 2
                  + 6 * d * d * (a * a * o.m2 + b * b * self.m2) / some ** 2 + 4 * d * (a * o.m3 - b * self.m3) / some)
            return Moments(n, mean, m2, m3, m4, np.fmin(self.lo, o.lo), np.fmax(self.hi, o.hi), self.total + o.total)


_FIELDS = ("n", "mean", "m2", "m3", "m4", "lo", "hi", "total")


def moments_of(x: np.ndarray) -> Moments:
    """The moments of each column of a matrix with NaN for missing cells."""
    here = ~np.isnan(x)
    z, centre = _centred(x, here)
    with np.errstate(all="ignore"):
        n = here.sum(0).astype(float)
        d = z.sum(0) / np.maximum(n, 1)
        z = np.where(here, z - d, 0.0)
        z2 = z * z
        empty = n == 0
        lo, hi = np.where(here, x, np.inf).min(0, initial=np.inf), np.where(here, x, -np.inf).max(0, initial=-np.inf)
        return Moments(n, centre + d, z2.sum(0), (z2 * z).sum(0), (z2 * z2).sum(0), np.where(empty, np.nan, lo), np.where(empty, np.nan, hi), np.where(here, x, 0.0).sum(0))


def scan_moments(df: DataFrame, cols: list[str]) -> Moments:
    """The moments of the columns; null and NaN are missing."""
    data = df.select(*[present(q(c)).alias(f"c{i}") for i, c in enumerate(cols)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = moments_of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float))
                total = part if total is None else total.merged(part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cols), dtype=np.int32)), *[pa.array(getattr(total, f)) for f in _FIELDS]], ["i", *_FIELDS])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [Moments(*[np.array([r[f]]) for f in _FIELDS]) for r in rows.to_dict("records")]
        total = parts[0]
        for m in parts[1:]:
            total = total.merged(m)
        return pd.DataFrame({"i": rows["i"].iloc[:1], **{f: getattr(total, f) for f in _FIELDS}})

    schema = "i int, " + ", ".join(f"{f} double" for f in _FIELDS)
    found = {r["i"]: r for r in data.mapInArrow(scan, schema).groupBy("i").applyInPandas(merge, schema).collect()}     # one row a column
    none = {**{f: 0.0 for f in _FIELDS}, "lo": np.nan, "hi": np.nan}
    return Moments(*[np.array([(found[i] if i in found else none)[f] for i in range(len(cols))], float) for f in _FIELDS])


def column_statistics(df: DataFrame, cols: list[str]) -> list[dict]:
    """Per column: n, mean, std (ddof 1), std_pop, min, max, skew (G1) and kurtosis (G2); None where undefined.

    Skew and kurtosis are 0 for a constant column, and need 3 and 4 values.
    """
    m, out = scan_moments(df, cols), []

    def value(x) -> float | None:
        return float(x) if np.isfinite(x) else None

    for i in range(len(cols)):
        n, m2, m3, m4 = int(m.n[i]), m.m2[i], m.m3[i], m.m4[i]
        skew = kurtosis = None
        with np.errstate(all="ignore"):
            if n >= 3:
                skew = 0.0 if m2 == 0 else value(np.sqrt(n) * m3 / m2 ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2))
            if n >= 4:
                kurtosis = 0.0 if m2 == 0 else value((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / m2 ** 2 - 3) + 6))
            out.append({"n": n, "mean": value(m.total[i] / n) if n else None, "std": value(np.sqrt(m2 / (n - 1))) if n > 1 else None,
                        "std_pop": value(np.sqrt(m2 / n)) if n else None, "min": value(m.lo[i]), "max": value(m.hi[i]), "skew": skew, "kurtosis": kurtosis})
    return out
