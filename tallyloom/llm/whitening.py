"""Embedding whitening with components from the exact characteristic polynomial.

Entries become whole numbers, so the scatter matrix is exact: tasks add up products of whole numbers
in limbs. Its characteristic polynomial is found modulo many primes, each prime in a Spark task by a
reduction to Hessenberg form, and put together by Chinese remaindering. Eigenvalues are isolated with
exact arithmetic: a polynomial with real roots only has as many of them above a point as the shifted
coefficients change their sign (Descartes). Components are null vectors by inverse iteration in long
decimals. All of that is as large as the number of dimensions, whatever the number of rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Whole entries stand in limbs of so many bits; products of two limbs of LIMB_ROWS rows add up exactly in doubles.
LIMB, LIMB_ROWS = 18, 1 << 14
#: Bits of a limb of the sums, which longs add up over 2**23 tasks; digits of the inverse iteration.
SUM_LIMB, DIGITS = 40, 150
ROOT_BITS = 220


# --- rows -------------------------------------------------------------------------------------------


def usable_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and y, the whole numbers floor(1024 c), of vectors without null or non-finite entries."""
    wide = F.transform("embedding", lambda c: c.cast("double"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < F.lit(2.0**62)))
    rows = vectors.select(F.col("vec_id").alias("vec_id"), wide.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fits, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("y"))


def _rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("y").flatten().to_numpy().reshape(-1, dims)


def limbs(table: np.ndarray) -> list[np.ndarray]:
    """table as a sum of parts[k] * 2**(LIMB * k), each part whole doubles below 2**LIMB in size."""
    parts, rest = [], table
    while True:
        if rest.size == 0 or (rest.min() >= -(1 << (LIMB - 1)) and rest.max() < 1 << (LIMB - 1)):
            return [*parts, rest.astype(np.float64)]
        low = rest & ((1 << LIMB) - 1)
        parts.append(low.astype(np.float64))
        rest = rest >> LIMB


def exact_sums(table: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of the columns and of the products of each two columns, exactly, for at most LIMB_ROWS rows."""
    parts = limbs(table)
    dims = table.shape[1]
    linear = [sum(int(p[:, i].sum()) << (LIMB * k) for k, p in enumerate(parts)) for i in range(dims)]
    square = [[0] * dims for _ in range(dims)]
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            block = (left.T @ right).tolist()
            for i in range(dims):
                row = block[i]
                for j in range(i, dims):
                    square[i][j] += int(row[j]) << (LIMB * (a + b))
    return linear, square


def _spread(value: int) -> Iterator[tuple[int, int]]:
    """The limbs of a whole number that are not zero, with the sign on each."""
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        low = value & ((1 << SUM_LIMB) - 1)
        if low:
            yield k, sign * low
        value >>= SUM_LIMB
        k += 1


class Scatter:
    """n, the column sums of y, and the exact scatter n * sum(y y') - sums sums', which is n**2 times the covariance."""

    def __init__(self, n: int, sums: list[int], square: list[list[int]]):
        self.n, self.sums = n, sums
        self.matrix = [[n * square[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(len(sums))] for i in range(len(sums))]
        self.trace = sum(self.matrix[i][i] for i in range(len(sums)))


def scatter_of(rows: DataFrame, n: int, dims: int) -> Scatter:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, square = [0] * dims, [[0] * dims for _ in range(dims)]
        for batch in batches:
            table = _rows_of(batch, dims)
            for at in range(0, len(table), LIMB_ROWS):
                one, two = exact_sums(table[at : at + LIMB_ROWS])
                linear = [a + b for a, b in zip(linear, one, strict=True)]
                square = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(square, two, strict=True)]
        flat = [*linear, *(square[i][j] for i in range(dims) for j in range(i, dims))]
        found = [(cell, k, part) for cell, value in enumerate(flat) for k, part in _spread(value)]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["cell", "limb", "part"])

    parts = rows.select("y").mapInArrow(run, "cell int, limb int, part long").groupBy("cell", "limb").agg(F.sum("part").alias("part"))
    flat = [0] * (dims + dims * (dims + 1) // 2)
    for r in parts.collect():  # bounded by the dimensions
        flat[r["cell"]] += r["part"] << (SUM_LIMB * r["limb"])
    square, at = [[0] * dims for _ in range(dims)], dims
    for i in range(dims):
        square[i][i:] = flat[at : at + dims - i]
        at += dims - i
    return Scatter(n, flat[:dims], square)


# --- characteristic polynomial ----------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2**32."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(top: int, bits: int) -> list[int]:
    """Primes from top downwards whose product has over `bits` bits."""
    found, product, p = [], 1, top
    while product.bit_length() <= bits:
        p -= 1
        if is_prime(p):
            found.append(p)
            product *= p
    return found


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo the prime p < 2**31, the leading one first."""
    a = np.array([[x % p for x in row] for row in matrix], np.int64)
    d = len(a)
    for m in range(1, d - 1):  # similar matrix of Hessenberg form
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        at = m + int(below[0])
        if at != m:
            a[[m, at]] = a[[at, m]]
            a[:, [m, at]] = a[:, [at, m]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # polys[k]: of the leading k rows and columns, lowest power first
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - int(a[k - 1, k - 1]) * polys[k - 1] % p) % p
        run = 1
        for i in range(k - 1, 0, -1):
            run = run * int(a[i, i - 1]) % p
            polys[k] = (polys[k] - int(a[i - 1, k - 1]) * run % p * polys[i - 1] % p) % p
    return polys[d, ::-1].tolist()


def coefficient_bits(trace: int, dims: int) -> int:
    """Bits of a bound on twice each coefficient: eigenvalues are not negative and add up to the trace, so
    sums of products of k of them are at most comb(d, k) (trace / d)**k."""
    return 2 + max((comb(dims, k) * (trace // dims + 1) ** k).bit_length() for k in range(dims + 1))


def characteristic_polynomial(spark: SparkSession, scatter: Scatter) -> list[int]:
    """Coefficients of det(x - scatter.matrix), the leading one first; each prime's share is a row of a Spark job."""
    matrix = scatter.matrix
    primes = primes_below(1 << 31, coefficient_bits(scatter.trace, len(matrix)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"prime": batch["prime"], "rest": [polynomial_mod(matrix, int(p)) for p in batch["prime"]]})

    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), max(1, spark.sparkContext.defaultParallelism)))
    rests = {r["prime"]: r["rest"] for r in dealt.mapInPandas(run, "prime long, rest array<long>").collect()}
    product, values = 1, [0] * (len(matrix) + 1)
    for p in primes:
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, rests[p], strict=True)]
        product *= p
    return [v if 2 * v < product else v - product for v in values]


# --- roots ------------------------------------------------------------------------------------------


def roots_above(poly: list[int], numerator: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only lie above numerator / 2**bits, with multiplicity."""
    c = [v << (bits * k) for k, v in enumerate(poly)]  # roots times 2**bits, leading coefficient first
    for stop in range(len(c) - 1, 0, -1):
        for k in range(1, stop + 1):
            c[k] += numerator * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], wanted: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots as (value, multiplicity), at least `wanted` of them if there are as many.

    Values are right to ROOT_BITS bits of the root; roots that do not part within as many count as one
    of several multiplicity.
    """
    rank = len(poly) - 1
    while rank and not poly[rank]:
        rank -= 1
    poly = poly[: rank + 1]  # without the roots at zero
    if not rank:
        return []
    top = 1
    while roots_above(poly, top, 0):
        top *= 2
    out: list[tuple[Fraction, int]] = []
    spans = [(0, top, 0, 0, rank)]  # low, high (over 2**bits), bits, roots above high, roots above low
    while spans and sum(k for _, k in out) < wanted:
        low, high, bits, above_high, above_low = spans.pop()
        many = above_low - above_high
        if not many:
            continue
        if low and (high - low) << ROOT_BITS <= low:
            out.append((Fraction(low + high, 2 << bits), many))
            continue
        if many == 1 and low:
            low, high, bits = refined(poly, low, high, bits, above_high)
            out.append((Fraction(low + high, 2 << bits), 1))
            continue
        low, high, bits = low * 2, high * 2, bits + 1
        middle = (low + high) // 2
        above = roots_above(poly, middle, bits)
        spans += [(low, middle, bits, above, above_low), (middle, high, bits, above_high, above)]
    return out


def refined(poly: list[int], low: int, high: int, bits: int, above_high: int) -> tuple[int, int, int]:
    """Halves (low, high], which holds one simple root, by signs alone down to ROOT_BITS bits of the root."""
    positive = above_high % 2 == 0  # the sign at the upper end, where above_high roots lie beyond
    while (high - low) << ROOT_BITS > low:
        low, high, bits = low * 2, high * 2, bits + 1
        middle, value = (low + high) // 2, 0
        for k, v in enumerate(poly):
            value = value * middle + (v << (bits * k))
        if value == 0:
            return middle, middle, bits
        low, high = (low, middle) if (value > 0) == positive else (middle, high)
    return low, high, bits


# --- components -------------------------------------------------------------------------------------


def null_vectors(matrix: list[list[int]], root: Fraction, many: int) -> list[list[decimal.Decimal]]:
    """`many` orthogonal unit vectors that matrix takes to root times themselves, by inverse iteration."""
    d = len(matrix)
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)) as context:
        value = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
        tiny = value.scaleb(-DIGITS + 10)
        a = [[decimal.Decimal(x) - (value if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        swaps = []
        for k in range(d):  # triangular factors in place, the largest pivot first
            at = max(range(k, d), key=lambda i: abs(a[i][k]))
            swaps.append(at)
            a[k], a[at] = a[at], a[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            for i in range(k + 1, d):
                f = a[i][k] = a[i][k] / a[k][k]
                if f:
                    row, pivot = a[i], a[k]
                    for j in range(k + 1, d):
                        row[j] -= f * pivot[j]
        found: list[list[decimal.Decimal]] = []
        for number in range(many):
            v = [decimal.Decimal(1 + (i * i + 7 * i * (number + 1)) % 101) for i in range(d)]
            for _ in range(4):
                for k, at in enumerate(swaps):
                    v[k], v[at] = v[at], v[k]
                for k in range(d):
                    v[k] -= sum(a[k][j] * v[j] for j in range(k))
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - sum(a[k][j] * v[j] for j in range(k + 1, d))) / a[k][k]
                for _ in range(2):
                    for other in found:
                        product = sum(x * y for x, y in zip(other, v, strict=True))
                        v = [y - product * x for x, y in zip(other, v, strict=True)]
                    size = context.sqrt(sum(x * x for x in v))
                    v = [x / size for x in v]
            found.append(v)
        return found


def components_of(scatter: Scatter, poly: list[int], wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors by falling eigenvalue, square roots of the covariance's eigenvalues, shares of the trace), without zeros."""
    vectors, roots, shares = [], [], []
    for root, many in largest_roots(poly, wanted):
        for v in null_vectors(scatter.matrix, root, many):
            vectors.append([float(x) for x in v])
            roots.append(_root(root / scatter.n**2))
            shares.append(float(root / scatter.trace))
    return np.array(vectors[:wanted]).reshape(-1, len(scatter.sums)), np.array(roots[:wanted]), np.array(shares[:wanted])


def _root(value: Fraction) -> float:
    up = 1 << 300
    return float(Fraction(isqrt(value.numerator * up * up // value.denominator), up))


# --- operator ---------------------------------------------------------------------------------------


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows take part whose vector has entries, none of them null, non-finite or of 2**52 and more in
    size, and has the most frequent length (of several, the longest); every repeated row counts.
    Components stop at the rank of the covariance, so fewer than `components` come where it is lower, and
    none (no rows) of an empty table or equal vectors. A deviation past the range of a long is null;
    deviation_exact has it in digits. Null vec_ids stay; only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    usable = materialize(usable_rows(vectors), "whiten-rows")
    sizes = usable.groupBy(F.size("y").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    found = None
    if sizes:
        dims, n = sizes[0]["dims"], sizes[0]["n"]
        rows = usable.where(F.size("y") == dims)
        scatter = scatter_of(rows, n, dims)
        if scatter.trace:
            found = components_of(scatter, characteristic_polynomial(spark, scatter), components)
    if found is None:
        return vectors.limit(0).select(
            F.col("vec_id").alias("vec_id"), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"),
            F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"), F.lit("").alias("deviation_exact"),
        )
    axes, roots, shares = found
    placed = materialize(projected(rows, scatter, axes, roots), "whitened")
    error = identity_error(placed, n, len(roots))
    share = F.array(*[F.lit(float(x)) for x in shares])
    return placed.select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )


def projected(rows: DataFrame, scatter: Scatter, axes: np.ndarray, roots: np.ndarray) -> DataFrame:
    """vec_id, the exact squared deviation from the mean times n**2, and the whitened coordinates of each row."""
    n, sums, dims = scatter.n, scatter.sums, len(scatter.sums)
    whole, part = [s // n for s in sums], [float(Fraction(s % n, n)) for s in sums]
    most = min(1 << 28, (1 << 33) // dims) if max(map(abs, sums)) < 1 << 56 else 0
    kind = rows.schema["vec_id"].dataType.simpleString()
    fixed = sum(s * s for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _rows_of(batch, dims)
            centred = (y - np.array(whole, np.int64)).astype(np.float64) - np.array(part)
            values = centred @ axes.T / roots
            if len(y) and np.abs(y).max() < most:
                # sum((n y - s)**2) without any product that a long does not hold
                high, low = np.array([s >> 28 for s in sums], np.int64), np.array([s & ((1 << 28) - 1) for s in sums], np.int64)
                squares, tops, ends = (y * y).sum(axis=1).tolist(), (y @ high).tolist(), (y @ low).tolist()
                exact = [n * n * a - 2 * n * ((b << 28) + c) + fixed for a, b, c in zip(squares, tops, ends, strict=True)]
            else:
                exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in y.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), pa.array([x if x < 1 << 63 else None for x in exact], pa.int64()), pa.array([str(x) for x in exact], pa.string()),
                    pa.array(list(values), pa.list_(pa.float64())),
                ],
                ["vec_id", "deviation", "deviation_exact", "whitened"],
            )

    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, deviation_exact string, whitened array<double>")


def identity_error(placed: DataFrame, n: int, k: int) -> float:
    """The largest entry, in size, of the covariance of the whitened coordinates minus the identity."""
    at = lambda i: F.col("whitened")[i]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = placed.agg(*[F.sum(at(i)).alias(f"s{i}") for i in range(k)], *[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in cells]).first()
    return max(abs(row[f"p{i}_{j}"] / n - row[f"s{i}"] / n * (row[f"s{j}"] / n) - (i == j)) for i, j in cells)
