"""Embedding whitening by the exact characteristic polynomial (12).

Entries become integers, floor(scale * x). Over the distinct integer vectors (n of them,
per-dimension sums S) Spark adds up the exact integer scatter M = n * sum(x x') - S S',
which is n^2 times their covariance. What follows has the size of M, not of the data:

* the characteristic polynomial of M modulo primes below 2^31, each by reduction to Hessenberg
  form (one Spark row a prime), put together by Chinese remainders; the number of primes follows
  from a bound on the coefficients, so the integer polynomial is exact;
* M is symmetric and non-negative, so all roots are real and Descartes' sign count of the
  polynomial shifted by a is exactly the number of roots above a. Bisection on that count isolates each
  root, sign changes narrow it to ``BITS`` bits of the trace;
* components span the null space of M - root: inverse iteration in fixed-point arithmetic
  of ``2 * BITS`` fraction bits. Roots that agree to ``BITS`` bits are one eigenvalue, with an
  orthonormal basis of its space.

Whitened values are (n x - S) v / sqrt(root): n cancels against the covariance's divisor.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
dropped; repeated rows are one vector of the fit and each get a result; vectors of
different lengths raise. Eigenvalues that are exactly zero have no component, so a table with
no or one distinct vector gives rows without components. Other columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import fresh, register, table, written
from tablelens.llm.integers import matrix, usable, whole

BITS = 256
SCALE = 256


# ---- exact scatter

def _product(x: np.ndarray) -> np.ndarray:
    """x' x of integers, exact: in doubles or longs where a bound proves them wide enough, else in Python's integers."""
    bound = int(np.abs(x).max()) ** 2 * len(x)
    if bound < 2 ** 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if bound < 2 ** 62:
        return (x.T @ x).astype(object)
    x = x.astype(object)
    return x.T @ x


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of the rows of a column ``x`` of integer vectors; tasks send one triangle each."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, prod = 0, 0, 0
        for b in batches:
            x = matrix(b.column(0))
            if not len(x):
                continue
            if n and x.shape[1] != len(sums):
                raise ValueError("vectors of different lengths")
            n, sums, prod = n + len(x), sums + x.astype(object).sum(0), prod + _product(x)
        if not n:
            return
        d = len(sums)
        i, j = np.triu_indices(d)
        rows = [*i, *[-1] * d, -1], [*j, *range(d), -d], [*prod[i, j], *sums, n]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(rows[0], np.int32)), pa.array(np.array(rows[1], np.int32)),
                                          pa.array([Decimal(int(v)) for v in rows[2]], pa.decimal128(38, 0))], ["i", "j", "s"])

    parts = vectors.select("x").mapInArrow(partial, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    got = {(r["i"], r["j"]): int(r["s"]) for r in parts.collect()}      # (d + 1)(d + 2) / 2 rows
    widths = [-j for i, j in got if i == -1 and j < 0]
    if len(widths) > 1:
        raise ValueError("vectors of different lengths")
    if not widths:
        return 0, [], []
    d, n = widths[0], got[-1, -widths[0]]
    s = [got[-1, j] for j in range(d)]
    return n, s, [[n * got[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


# ---- characteristic polynomial

def _prime(n: int) -> bool:
    """Miller-Rabin with bases that settle every number below 2^32."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return n > 1


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``bound``."""
    out, product, n = [], 1, 2 ** 31 - 1
    while product <= bound:
        if _prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x - m) modulo p, constant first: Hessenberg form by similarity steps, then its recurrence."""
    h = np.array([[v % p for v in row] for row in m], np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        r = k + int(below[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        f = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - f[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * f % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weights, t = [int(h[k - 1, k - 1])], 1
        for i in range(1, k):
            t = t * int(h[k - i, k - i - 1]) % p
            weights.append(t * int(h[k - 1 - i, k - 1]) % p)
        lower = (np.array(weights, np.int64)[:, None] * polys[k - 1::-1] % p).sum(0) % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - lower) % p
    return [int(c) for c in polys[d]]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x - m), constant first, for a symmetric non-negative m; one Spark row a prime."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # the k-th coefficient is a sum of products of k roots: at most C(d, k) (trace / d)^k
    mean = -(-trace // d)
    primes = primes_beyond(2 * max(math.comb(d, k) * mean ** k for k in range(d + 1)))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, polynomial_mod(m, primes[i])) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["i", "c"])

    parts = min(len(primes), spark.sparkContext.defaultParallelism * 2)
    rows = spark.range(0, len(primes), 1, parts).mapInArrow(reduce, "i long, c array<long>").collect()
    value, modulus = [0] * (d + 1), 1
    for r in rows:
        p = primes[r["i"]]
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((c - v) * inverse % p) for v, c in zip(value, r["c"])]
        modulus *= p
    value = [v - modulus if 2 * v > modulus else v for v in value]
    if value[d] != 1 or value[d - 1] != -trace:
        raise ArithmeticError("the polynomial does not fit its matrix")
    return value


# ---- roots

def roots_above(coefs: list[int], a: int, shift: int) -> int:
    """How many roots (with multiplicity) of a polynomial with real roots only lie above a / 2^shift."""
    deg = len(coefs) - 1
    q = [c << (shift * (deg - i)) for i, c in enumerate(coefs)]
    for i in range(deg):
        for j in range(deg - 1, i - 1, -1):
            q[j] += a * q[j + 1]
    signs = [c > 0 for c in q if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(coefs: list[int], a: int, shift: int) -> int:
    """Sign of the polynomial at a / 2^shift."""
    value, deg = 0, len(coefs) - 1
    for i in range(deg, -1, -1):
        value = value * a + (coefs[i] << (shift * (deg - i)))
    return (value > 0) - (value < 0)


def largest_roots(coefs: list[int], k: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(low, shift, multiplicity) of the largest positive roots, falling, until ``k`` are reached: root in (low, low + 1] / 2^shift.

    The width is 2^-bits of the bound 2^(bits of the roots' sum).
    """
    zeros = next(i for i, c in enumerate(coefs) if c)
    coefs = coefs[zeros:]
    deg = len(coefs) - 1
    if not deg:
        return []
    top = (-coefs[deg - 1]).bit_length()            # all roots are at most their sum, below 2^top
    shift, out, reached = bits - top, [], 0
    if shift < 0:
        shift = 0
    while reached < min(k, deg):
        # invariant: more than ``reached`` roots above low, at most ``reached`` above high
        at, low, high = 0, 0, 1 << top
        n_low, n_high = deg, 0
        while at < shift or high - low > 1:
            if high - low == 1:
                low, high, at = low * 2, high * 2, at + 1
            mid = (low + high) // 2
            n = roots_above(coefs, mid, at)
            if n > reached:
                low, n_low = mid, n
            else:
                high, n_high = mid, n
            if n_low - n_high == 1 and n_high == reached:
                break
        if n_low - n_high == 1:                     # alone in its interval: follow the change of sign
            right = _sign(coefs, high, at) or None
            while at < shift or high - low > 1:
                if high - low == 1:
                    low, high, at = low * 2, high * 2, at + 1
                mid = (low + high) // 2
                s = _sign(coefs, mid, at)
                if s == 0 or (right is not None and s == right) or (right is None and roots_above(coefs, mid, at) == reached):
                    high, right = mid, (right if s else None)
                else:
                    low = mid
        out.append((low, shift, n_low - n_high))
        reached = n_low
    return out


# ---- components

def _unit(v, frac: int):
    return (v << frac) // math.isqrt(int((v * v).sum()))


def null_space(m: list[list[int]], root: int, shift: int, many: int, bits: int = BITS) -> list[list[int]]:
    """``many`` orthonormal vectors, scaled by 2^(2 bits), on which m - root / 2^shift nearly vanishes."""
    d, frac = len(m), max(2 * bits, shift)
    a = np.array([[v << frac for v in row] for row in m], dtype=object)
    a[np.arange(d), np.arange(d)] -= root << (frac - shift)
    lu, order = a.copy(), list(range(d))
    for k in range(d):
        r = k + int(np.argmax(np.abs(lu[k:, k])))
        if r != k:
            lu[[k, r]] = lu[[r, k]]
            order[k], order[r] = order[r], order[k]
        if lu[k, k] == 0:
            lu[k, k] = 1                            # a root met exactly: the smallest number stands for zero
        lu[k + 1:, k] = (lu[k + 1:, k] << frac) // lu[k, k]
        lu[k + 1:, k + 1:] -= (lu[k + 1:, k:k + 1] * lu[k:k + 1, k + 1:]) >> frac

    def solve(v):
        y = v[order]
        for k in range(d):
            y[k + 1:] -= (lu[k + 1:, k] * y[k]) >> frac
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << frac) // lu[k, k]
            y[:k] -= (lu[:k, k] * y[k]) >> frac
        return y

    seed = np.random.default_rng(12)
    basis = [_unit(np.array([int(v) for v in seed.integers(1, 2 ** 40, d)], dtype=object) << frac, frac) for _ in range(many)]
    for _ in range(3):
        done = []
        for v in basis:
            v = _unit(solve(v), frac)
            for _ in range(2):
                for u in done:
                    v = v - ((u * (int((u * v).sum()) >> frac)) >> frac)
                v = _unit(v, frac)
            done.append(v)
        basis = done
    size = max(abs(v) for row in m for v in row)
    for v in basis:
        if max(abs(int(x)) for x in (a * v).sum(1) >> frac) > size << (frac - bits // 2):
            raise ArithmeticError("inverse iteration did not settle")
    return [[int(x) >> (frac - 2 * bits) for x in v] for v in basis]


@dataclass
class Whitening:
    """A fit: n vectors with sums S, trace of the integer scatter, eigenvalues and unit components, largest first."""

    n: int
    sums: list[int]
    trace: int
    roots: list[float]
    root_squares: list[float]
    components: list[list[float]]

    def explained(self, i: int) -> float:
        return self.roots[i] / float(self.trace)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(whitened values, sum over dimensions of (n x - S)^2) of integer vectors; the second is exact."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        wide = top ** 2 * max(x.shape[1], 1) >= 2 ** 63
        c = self.n * x.astype(object) - np.array(self.sums, dtype=object) if wide else self.n * x - np.array(self.sums, np.int64)
        values = c.astype(np.float64) @ np.array(self.components, np.float64).reshape(-1, x.shape[1]).T
        return values / np.array(self.root_squares), [int(v) for v in (c * c).sum(1)]


def fit(vectors: DataFrame, components: int) -> Whitening:
    """The whitening of the distinct integer vectors in column ``x`` (each row counts: make them distinct first)."""
    spark = vectors.sparkSession
    n, sums, m = scatter(vectors)
    trace = sum(m[i][i] for i in range(len(m)))
    out = Whitening(n, sums, trace, [], [], [])
    if not trace:
        return out
    common = math.gcd(*(v for row in m for v in row))
    small = [[v // common for v in row] for row in m]
    for low, shift, times in largest_roots(characteristic_polynomial(spark, small), components):
        middle = 2 * low + 1
        take = min(times, components - len(out.roots))
        for v in null_space(small, middle, shift + 1, take):
            lead = max(v, key=abs)
            out.components.append([(x if lead > 0 else -x) / (1 << 2 * BITS) for x in v])
            out.roots.append(middle * common / (1 << shift + 1))
            out.root_squares.append(math.isqrt(middle * common << (2 * BITS - shift - 1)) / (1 << BITS))
    return out


def whiten(rows: DataFrame, vec_col: str = "embedding", components: int = 4, scale: int = SCALE) -> tuple[DataFrame, Whitening, float, tuple[str, str]]:
    """(rows, fit, identity error, names): usable rows with whitened array<double> and exact deviation decimal(38,0).

    The two new columns have the returned names (lengthened where the table has them). The identity error is
    the largest absolute entry of the whitened fit list's covariance minus the identity, measured on the values.
    """
    x, values = fresh(rows.columns, "x", "whitening")
    kept = rows.where(usable(F.col(vec_col))).withColumn(x, whole(F.col(vec_col), scale))
    distinct = written(kept.select(F.col(x).alias("x")).distinct())
    model = fit(distinct, components)
    spread = pa.struct([("w", pa.list_(pa.float64())), ("deviation", pa.decimal128(38, 0))])

    @F.arrow_udf("struct<w: array<double>, deviation: decimal(38,0)>")
    def applied(lists: pa.Array) -> pa.Array:
        if not len(lists):
            return pa.array([], spread)
        w, dev = model.apply(matrix(lists))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
        return pa.StructArray.from_arrays([flat, pa.array([Decimal(v) for v in dev], pa.decimal128(38, 0))], fields=list(spread))

    k = len(model.roots)
    error = 0.0
    if k:
        w = distinct.select(applied("x")["w"].alias("w")).select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    w, deviation = fresh([*kept.columns, values], "whitened", "deviation")
    out = kept.withColumn(values, applied(F.col(x))).withColumn(w, F.col(values)["w"]).withColumn(deviation, F.col(values)["deviation"])
    return out.drop(values, x), model, error, (w, deviation)


@register("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error, (w, deviation) = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(model.explained(i)) for i in range(len(model.roots))]).cast("array<double>")
    return (rows.select("vec_id", F.col(deviation).cast("long").alias("deviation"), F.posexplode(w).alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
