"""Whitening of embeddings by principal components that are found exactly.

Every entry c of a vector becomes the integer x = floor(64 c) + 1,000,000.  The fit list holds each distinct
x vector once: n of them.  Their scatter M = n * sum(x x') - S S' (n * n times the covariance, S the
sums) is an integer matrix, the same whatever is taken from every x, so y = floor(64 c) is summed.  Then

1. M's characteristic polynomial: its coefficients modulo many primes, a task for some primes each, by
   reduction to Hessenberg form; Chinese remaindering gives the integers.  The bound on them is
   (1 + trace / d) ** d, as M has no negative eigenvalue.
2. Its largest roots: all are real, so Descartes' rule of signs on the polynomial moved by a counts the
   roots above a exactly, with multiplicity.  Bisection by that count isolates them, Newton steps inside
   the bracket refine them to the trace over 2 ** PRECISION.
3. A component is the null space of M - root, by inverse iteration in fixed point arithmetic of
   PRECISION + GUARD bits.  Roots that are equal to that precision share a task and get orthogonal vectors.
4. The whitened fit list's covariance is measured in one more pass.

Spark deals out the rows (sums, measuring, result), the primes and the components; the driver gets the
d x d sums, the polynomial and the components, whose size is bounded by ``WIDEST`` and by nothing else.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are
vectors of another length than most rows have (ties: the longer).  Rows with a null id or a repeated one count.
Directions without any variance can't be whitened: there are as many components as M has positive
eigenvalues, 16 at most, so no rows at all where all vectors are equal or the table is empty.  A deviation
beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import isqrt, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.shared import table, written

COMPONENTS, SCALE = 16, 64
#: The longest vectors taken: the driver holds a matrix of that many rows and columns.
WIDEST = 2048
#: Roots are known to the trace over 2 ** PRECISION; inverse iteration works with GUARD bits more.
PRECISION, GUARD = 256, 96
_LIMB = 22


def gram(y: np.ndarray) -> np.ndarray:
    """y' y of an int64 matrix as exact Python integers, by products of floats that stay below 2 ** 53."""
    total = np.zeros((y.shape[1],) * 2, object)
    if not y.size:
        return total
    most = int(max(abs(int(y.max())), abs(int(y.min())), 1))
    if most < 1 << _LIMB:
        step = max(1, (1 << 53) // (most * most))
        for at in range(0, len(y), step):
            part = y[at : at + step].astype(float)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    for at in range(0, len(y), 256):
        left, limbs = y[at : at + 256], []
        while True:  # limbs from low to high, the last one signed
            low = left & ((1 << _LIMB) - 1)
            if len(limbs) == 2:
                limbs.append(left.astype(float))
                break
            limbs.append(low.astype(float))
            left = left >> _LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << _LIMB * (i + j))
    return total


def primes(count: int) -> list[int]:
    """The largest primes below 2 ** 31, so that products of residues fit in 64 bits."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3,215,031,751
            x = pow(base, odd, p)
            if x in (1, p - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                return False
        return True

    found, p = [], (1 << 31) - 1
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 2
    return found


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo p with nothing below its first subdiagonal."""
    a = a.copy()
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1][None, :] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(1)) % p
    return a


def residues(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p, constant first, of the characteristic polynomial of ``a`` (residues modulo p)."""
    h = hessenberg(a, p)
    d = len(h)
    polynomials = np.zeros((d + 1, d + 1), np.int64)  # row k: that of the first k rows and columns
    polynomials[0, 0] = 1
    below = np.ones(0, np.int64)  # products of the subdiagonal from row i + 1 to the last one
    for k in range(1, d + 1):
        below = np.append(below * h[k - 1, k - 2] % p if k > 1 else below, 1)
        new = np.roll(polynomials[k - 1], 1)
        weights = h[:k, k - 1] * below % p
        polynomials[k] = (new - (weights[:, None] * polynomials[:k] % p).sum(0)) % p
    return polynomials[d]


def needed(d: int, trace: int) -> int:
    """How many primes below 2 ** 31 have a product over twice the bound of all coefficients."""
    return int(d * log2(1 + trace / d) / 30.9) + 2


def combined(moduli: list[int], found: list[list[int]]) -> list[int]:
    """The integers of least absolute value that have these residues."""
    whole = 1
    for p in moduli:
        whole *= p
    sums = [0] * len(found[0])
    for p, values in zip(moduli, found):
        rest = whole // p
        unit = rest * pow(rest, -1, p)
        sums = [s + v * unit for s, v in zip(sums, values)]
    return [(s + whole // 2) % whole - whole // 2 for s in sums]


class RealRooted:
    """A polynomial whose roots are all real and not negative, on a grid of 2 ** -bits: root = grid number / 2 ** bits."""

    def __init__(self, coefficients: list[int], bits: int):
        top = len(coefficients) - 1
        self.bits, self.coefficients = bits, [c << bits * (top - i) for i, c in enumerate(coefficients)]

    def above(self, z: int) -> int:
        """How many roots lie above z: the changes of sign after the polynomial is moved by z."""
        moved = list(self.coefficients)
        for i in range(len(moved) - 1):
            for j in range(len(moved) - 2, i - 1, -1):
                moved[j] += z * moved[j + 1]
        signs = [c > 0 for c in moved if c]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def value(self, z: int) -> tuple[int, int]:
        """The polynomial and its slope."""
        f = slope = 0
        for c in reversed(self.coefficients):
            slope = slope * z + f
            f = f * z + c
        return f, slope

    def largest(self, most: int, bound: int) -> list[tuple[int, int]]:
        """(grid number, multiplicity) of positive roots from the largest, until there are ``most`` or none left.

        ``bound``: a grid number that no root exceeds.
        """
        found: list[tuple[int, int]] = []
        left = [(0, bound, self.above(0), 0)]  # brackets lo < root <= hi with the counts above both; the highest last
        while left and sum(m for _, m in found) < most:
            lo, hi, above_lo, above_hi = left.pop()
            if above_lo - above_hi == 0:
                continue
            if above_lo - above_hi == 1:
                found.append((self.refined(lo, hi), 1))
            elif hi - lo <= 1:
                found.append((hi, above_lo - above_hi))
            else:
                middle = (lo + hi) // 2
                above = self.above(middle)
                left += [(lo, middle, above_lo, above), (middle, hi, above, above_hi)]
        return found

    def refined(self, lo: int, hi: int) -> int:
        """The only root in lo < root <= hi, to one step of the grid."""
        if not (at_hi := self.value(hi)[0]):
            return hi
        rising = at_hi > 0
        z = (lo + hi) // 2
        while hi - lo > 1:
            f, slope = self.value(z)
            if not f:
                return z
            if (f > 0) == rising:
                hi = z
            else:
                lo = z
            step = z - f // slope if slope else z
            if abs(step - z) <= 2:  # as good as there: let the bracket close around it
                step = z + 2 if lo == z else z - 2
            z = step if lo < step < hi else (lo + hi) // 2
        return hi


def null_space(matrix: list[list[int]], root: int, bits: int, many: int) -> list[list[float]]:
    """``many`` orthogonal unit vectors v with matrix * v = root / 2 ** bits * v, by inverse iteration in fixed point."""
    d, places = len(matrix), PRECISION + GUARD
    unit = sum(matrix[i][i] for i in range(d)) << bits
    a = np.empty((d, d), object)
    for i in range(d):
        for j in range(d):
            a[i, j] = (((matrix[i][j] << bits) - (root if i == j else 0)) << places) // unit
    order, steps = [], []
    for k in range(d):  # elimination with the largest pivot
        i = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, i]] = a[[i, k]]
        order.append(i)
        if not a[k, k]:
            a[k, k] = 1
        factors = np.array([(x << places) // a[k, k] for x in a[k + 1 :, k]], object)
        if len(factors):
            a[k + 1 :, k:] -= (factors[:, None] * a[k, k:][None, :]) >> places
        steps.append(factors)

    def solved(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for k in range(d):
            v[[k, order[k]]] = v[[order[k], k]]
            if k + 1 < d:
                v[k + 1 :] -= (steps[k] * v[k]) >> places
        for k in range(d - 1, -1, -1):
            v[k] = ((v[k] - int((a[k, k + 1 :] * v[k + 1 :]).sum() >> places if k + 1 < d else 0)) << places) // a[k, k]
        return v

    def normed(v: np.ndarray) -> np.ndarray:
        length = isqrt(int((v * v).sum())) or 1
        return np.array([(int(x) << places) // length for x in v], object)

    found: list[np.ndarray] = []
    rng = np.random.default_rng(d)
    for _ in range(many):
        v = np.array([int(x) << places - 32 for x in rng.integers(1, 1 << 31, d)], object)
        for _ in range(3):
            v = normed(solved(normed(v)))
            for _ in range(2):
                for u in found:
                    v = v - u * (int((u * v).sum()) >> places) // (1 << places)
                v = normed(v)
        found.append(v)
    out = []
    for v in found:
        first = max(range(d), key=lambda i: (abs(v[i]), -i))
        out.append([float(Fraction(int(x), 1 << places)) * (1 if v[first] > 0 else -1) for x in v])
    return out


def integers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, y array<long>) of the vectors that take part: finite, of the commonest length."""
    known = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    known = known.where(F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c)))
    lengths = known.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    d = lengths["d"] if lengths else 0
    if d > WIDEST:
        raise ValueError(f"vectors of {d} entries; {WIDEST} at most")
    return known.where(F.size("v") == d).select("key", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("y"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y and the integer scatter matrix of the fit list; each task adds up its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            y = _matrix(batch.column(0))
            if len(y):
                n, sums, products = n + len(y), sums + y.astype(object).sum(0), products + gram(y)
        if not n:
            return
        d = len(sums)
        cells = [(-1, -1, n), *[(-1, j, s) for j, s in enumerate(sums)], *[(i, j, products[i, j]) for i in range(d) for j in range(i, d)]]
        half = 1 << 62  # two parts, so that no sum leaves 38 digits
        wide = pa.decimal128(38)
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([int(c[2]) // half for c in cells], wide), pa.array([int(c[2]) % half for c in cells], wide)], names=["i", "j", "high", "low"])

    parts = fit.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    total = {(r.i, r.j): (int(r.high) << 62) + int(r.low) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    n = total.get((-1, -1), 0)
    d = sum(i == -1 for i, _ in total) - 1
    sums = [total[-1, j] for j in range(d)]
    return n, sums, [[n * total[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of a scatter matrix's characteristic polynomial; the primes are dealt out."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    moduli = primes(needed(len(matrix), trace))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix, object)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [residues((whole % moduli[i]).astype(np.int64), moduli[i]).tolist() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "values"])

    tasks = min(len(moduli), spark.sparkContext.defaultParallelism)
    found = {r.id: r["values"] for r in spark.range(0, len(moduli), 1, tasks).mapInArrow(run, "id long, values array<long>").collect()}
    return combined(moduli, [found[i] for i in range(len(moduli))])


def components(spark: SparkSession, matrix: list[list[int]], most: int = COMPONENTS) -> tuple[np.ndarray, list[Fraction]]:
    """Unit eigenvectors of a scatter matrix as rows, by falling eigenvalue, and the eigenvalues: the positive ones, ``most`` at most."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return np.zeros((0, d)), []
    bits = max(0, PRECISION - trace.bit_length())
    roots = RealRooted(characteristic(spark, matrix), bits).largest(most, trace << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [null_space(matrix, roots[i][0], bits, roots[i][1]) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["id", "vectors"])

    found = {r.id: r.vectors for r in spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "id long, vectors array<array<double>>").collect()}
    vectors = [v for i in range(len(roots)) for v in found[i]][:most]
    return np.array(vectors), [Fraction(z, 1 << bits) for z, m in roots for _ in range(m)][:most]


class Whitening:
    """n, sums, components and their scales, as fitted; sent to every task (d x 16 numbers)."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: list[Fraction], trace: int):
        self.n, self.sums, self.count = n, sums, len(values)
        self.explained = [float(v / trace) for v in values]
        # The root of an eigenvalue of the covariance is that of the scatter's over n.
        self.directions = (vectors / np.sqrt([float(v) for v in values])[:, None] * n).T if values else vectors.T

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, bool]:
        """n * y - sums, exact, and whether its squares add up within a long."""
        most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        largest = self.n * most + max(map(abs, self.sums), default=0)
        fits = largest * largest * max(1, len(self.sums)) < 1 << 63
        return (self.n * y - np.array(self.sums, np.int64), True) if fits else (y.astype(object) * self.n - np.array(self.sums, object), False)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.directions

    def deviations(self, centred: np.ndarray, fits: bool) -> pa.Array:
        squares = (centred * centred).sum(1)
        return pa.array(squares, pa.int64()) if fits else pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())


def fitted(fit: DataFrame, most: int = COMPONENTS) -> Whitening:
    """The whitening of a fit list (y array<long>, distinct)."""
    n, sums, matrix = scatter(fit)
    vectors, values = components(fit.sparkSession, matrix, most)
    return Whitening(n, sums, vectors, values, sum(matrix[i][i] for i in range(len(matrix))))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((model.count + 1,) * 2)  # the last row and column: the sums themselves
        for batch in batches:
            y = _matrix(batch.column(0))
            if len(y):
                w = np.concatenate([model.whitened(model.centred(y)[0]), np.ones((len(y), 1))], 1)
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int64()), pa.array(j.ravel(), pa.int64()), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = np.zeros((model.count + 1,) * 2)
    for r in fit.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r.i, r.j] = r.s
    mean = sums[:-1, -1] / model.n
    return float(np.abs(sums[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(model.count)).max(initial=0))


def whiten(rows: DataFrame, key: str, vector: str, most: int = COMPONENTS) -> DataFrame:
    """(key, component int, n, deviation, whitened, explained, identity_error) for each vector that takes part and each component."""
    taken = integers(rows, key, vector)
    fit = written(taken.select("y").distinct(), "fit")
    model = fitted(fit, most)
    error = identity_error(fit, model)
    kind = taken.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.count
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                if not k or not len(batch):
                    continue
                centred, fits = model.centred(_matrix(batch.column(1)))
                of = pa.array(np.repeat(np.arange(len(batch)), k))
                same = lambda value, kind: pa.array(np.tile(np.asarray(value), len(batch)), kind)
                arrays = [batch.column(0).take(of), same(range(1, k + 1), pa.int32()), same([model.n] * k, pa.int64()), model.deviations(centred, fits).take(of)]
                arrays += [pa.array(model.whitened(centred).ravel()), same(model.explained, pa.float64()), same([error] * k, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = taken.mapInArrow(run, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
