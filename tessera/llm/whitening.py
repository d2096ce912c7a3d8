"""Whitening of embeddings by a compensated covariance.

Entries become integers, so sums and deviations are exact. The covariance is taken
over distinct vectors: each block of rows is centred in double-double numbers (a
pair whose exact sum is the value), and its outer products are summed without
error: the columns are split into parts so short that a matrix product of two parts
rounds nowhere, and those products are added to a double-double matrix by error-free
sums. Tasks merge their high and low parts in a tree. The driver holds one matrix of
dimension by dimension, reduces it to tridiagonal form, solves that by divide and
conquer (LAPACK's symmetric solver), and sharpens the eigenvectors with residuals in
double-double.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

STEP = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Vectors with a larger integer entry are left out, so that differences are exact doubles and longs.
LARGEST = 1 << 40
#: Rows of a block, and bits of a part: products of two parts sum to 53 bits at most.
ROWS = 4096
BITS = 20
#: Partial results that one task merges.
FAN = 16
#: A component whose eigenvalue is this share of the largest, or less, is rounding.
NOTHING = 2.0**-70

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """a + b and the exact error of it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    """Sum of double-double numbers."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def split(x: Pair) -> list[np.ndarray]:
    """Four matrices that add up to ``x``: each of the first three holds the next ``BITS`` bits below its column's largest entry."""
    hi, lo = x
    _, top = np.frexp(np.abs(hi).max(axis=0, initial=0))
    parts = []
    for i in (1, 2, 3):
        unit = np.ldexp(1.0, top - i * BITS)
        parts.append(np.rint(hi / unit) * unit)
        hi = hi - parts[-1]
    return [*parts, hi + lo]


def inner(a: Pair, b: Pair) -> Pair:
    """Transposed a times b in double-double, for any number of rows."""
    out = (np.zeros((a[0].shape[1], b[0].shape[1])),) * 2
    for r in range(0, len(a[0]), ROWS):
        x, y = (split((m[0][r : r + ROWS], m[1][r : r + ROWS])) for m in (a, b))
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)):  # these round nowhere
            out = add(out, (x[i].T @ y[j], 0.0))
        low = x[0].T @ y[3] + x[1].T @ (y[2] + y[3]) + x[2].T @ (y[1] + y[2] + y[3]) + x[3].T @ sum(y)
        out = add(out, (low, 0.0))
    return out


@dataclass(frozen=True)
class Fit:
    """What the tasks need: some 150 bytes for each dimension and 8 for each of its components."""

    n: int
    floor: np.ndarray
    rest: list[int]
    mean: Pair
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> Pair:
        hi, lo = two_sum((x - self.floor).astype(np.float64), -self.mean[0])
        return two_sum(hi, lo - self.mean[1])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        hi, lo = self.centred(x)
        return (hi @ self.axes + lo @ self.axes) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - sums)^2, exact; None beyond a long."""
        y = x - self.floor
        wide = len(self.rest) * (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2
        if wide < 1 << 63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        each = ((self.n * y.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in each]


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The key and x, the vector in whole steps, of vectors without null or non-finite entries."""
    v = F.col(vector)
    sound = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST / STEP))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * STEP) + F.lit(SHIFT).cast("long"))
    return df.where(sound).select(F.col(key), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal lists of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""

    def run(batches):
        for b in batches:
            s = np.r_[b.num_rows, _matrix(b.column(0)).sum(axis=0)]
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(s)), pa.int32()), "s": pa.array(s, pa.int64())})

    rows = fit_list.mapInArrow(run, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    s = [int(r["s"]) for r in sorted(rows, key=lambda r: r["dim"])]
    return (s[0], s[1:]) if s else (0, [])


def _moment(fit_list: DataFrame, rows_of) -> Pair | None:
    """Sum of the outer products of ``rows_of(x)``, with the sums of its columns as a last row and column, merged over all tasks."""

    def pack(part: int, m: Pair) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "hi": pa.array([m[0].tobytes()]), "lo": pa.array([m[1].tobytes()])})

    def run(batches):
        total = None
        for b in batches:
            hi, lo = rows_of(_matrix(b.column(0)))
            own = inner(c := (np.c_[hi, np.ones(len(hi))], np.c_[lo, np.zeros(len(lo))]), c)
            total = own if total is None else add(total, own)
        if total is not None:
            yield pack(TaskContext.get().partitionId(), total)

    def merge(t: pa.Table) -> pa.Table:
        total = None
        for row in t.sort_by("part").to_pylist():
            m = tuple(np.frombuffer(row[c], np.float64) for c in ("hi", "lo"))
            total = m if total is None else add(total, m)
        return pa.Table.from_batches([pack(t["part"][0].as_py() // FAN, total)])

    shape = "part long, hi binary, lo binary"
    parts = stored(fit_list.mapInArrow(run, shape))
    top = parts.agg(F.max("part")).first()[0]
    if top is None:
        return None
    while top:
        top //= FAN
        parts = parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, shape)
    row = parts.first()
    hi, lo = (np.frombuffer(row[c], np.float64) for c in ("hi", "lo"))
    side = int(np.sqrt(len(hi)))
    return hi.reshape(side, side), lo.reshape(side, side)


def eigenpairs(c: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors of a symmetric double-double matrix, to double precision.

    Each eigenvector's largest entry is positive.
    """
    c = tuple((m + m.T) / 2 for m in c)
    _, x = np.linalg.eigh(c[0])
    none = np.zeros_like(x)
    for _ in range(12):
        cx = inner(c, (x, none))
        s = inner((x, none), cx)
        r = add((np.eye(len(x)), none), tuple(-m for m in inner((x, none), (x, none))))
        r, s = r[0] + r[1], s[0] + s[1]
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 2 * (np.linalg.norm(s - np.diag(values), 2) + np.abs(values).max() * np.linalg.norm(r, 2))
        turn = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ turn
        if np.abs(turn).max() < 2.0**-50:
            break
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    return values, x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit:
    """Fit on each distinct x of ``vectors`` once."""
    fit_list = stored(vectors.select("x").distinct())
    n, sums = _sums(fit_list)
    floor = [s // n for s in sums]
    rest = [s - n * f for s, f in zip(sums, floor)]
    high = [r / n for r in rest]
    low = [float(Fraction(r, n) - Fraction(h)) for r, h in zip(rest, high)]
    own = Fit(n, np.array(floor, np.int64), rest, (np.array(high), np.array(low)))
    if n < 2 or not sums:
        return own
    hi, lo = (m[:-1, :-1] for m in _moment(fit_list, own.centred))
    values, axes = eigenpairs((hi, lo))
    real = values > max(values[0], 0) * NOTHING
    trace = add((np.trace(hi), 0.0), (np.trace(lo), 0.0))[0]
    k = min(components, int(real.sum()))
    if not k:
        return own
    own = Fit(n, own.floor, rest, own.mean, axes[:, :k], values[:k] / n, values[:k] / trace)
    hi, lo = _moment(fit_list, lambda x: (w := own.whitened(x), np.zeros_like(w)))
    mean = (hi[:-1, -1] + lo[:-1, -1]) / n
    off = (hi[:-1, :-1] + lo[:-1, :-1]) / n - np.outer(mean, mean) - np.eye(k)
    return Fit(n, own.floor, rest, own.mean, own.axes, own.values, own.explained, float(np.abs(off).max()))


def dimension(vectors: DataFrame) -> int | None:
    """The length that most vectors have, of equally many the larger."""
    row = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else None


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> tuple[Fit, DataFrame]:
    """The fit, and the key, deviation and whitened (an array, one entry for each component) of every vector that counts.

    Vectors that are null, hold a null or non-finite entry or one of 2^40 steps or
    more are dropped, as are those of another length than most have. Repeated rows
    are whitened alike and fitted once; a null key is carried. Components whose
    eigenvalue is nothing but rounding are left out, so that fewer than two
    distinct vectors have none; of equal eigenvalues the eigenvectors are any basis.
    No rows give no rows; other columns are ignored.
    """
    vectors = integer_vectors(df, vector, key)
    d = dimension(vectors)
    vectors = vectors.where(F.size("x") == F.lit(d))
    own = fit(vectors, components)
    held = df.sparkSession.sparkContext.broadcast(own)
    k = len(own.values)

    def run(batches):
        for b in batches:
            f = held.value
            x = _matrix(b.column(1)) if b.num_rows else np.zeros((0, len(f.floor)), np.int64)
            w = f.whitened(x) if k else np.zeros((b.num_rows, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * k, k) if k else np.zeros(len(x) + 1), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.deviations(x), pa.int64()), lists], [key, "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    return own, vectors.mapInArrow(run, f"{key} {kind}, deviation long, whitened array<double>")


def whitened_rows(df: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    own, rows = whiten(df)
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, own.explained.tolist())) if len(own.values) else F.array().cast("array<double>"), "at")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(own.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(own.identity_error).alias("identity_error"))
