"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

Every entry c of a usable vector becomes the whole number floor(64 c) +
1,000,000.  The fit list holds each distinct vector of these once; its mean and
covariance V (divisor n) say how every row is whitened: centred, projected on
the unit eigenvectors of V with the greatest eigenvalues, and divided by the
roots of these.

1. The fit list is a distinct over the vectors, written once.  Its sums are
   exact, so centring is too up to one rounding.
2. A block Q of a few more columns than components is improved in rounds: a
   Chebyshev polynomial of V, by its three-term recurrence, is applied to Q.  Each
   degree is one distributed pass Xc'(Xc Q); the polynomial stays small on the
   unwanted part of the spectrum, [0, least Ritz value], and grows above it.  QR
   makes the block orthonormal again and Rayleigh-Ritz gives eigenpairs.
3. Rounds end when every wanted pair is certified: ||V v - e v|| is at most
   ``CERTIFIED`` of the greatest eigenvalue.  A fit that isn't certified after
   ``ROUNDS`` rounds is an error, not a result.

A pass sums one d x p matrix a task (p columns of the block) in a tree of fan-in
``FAN_IN``, so the driver gets at most that many matrices.  Vectors never leave
the tasks; the dimension is held to ``MOST_DIMENSIONS``.

Cases: rows whose vector is null, empty, or holds a null, a non-finite entry or
one of 2^40 and more are dropped, and so are vectors of another length than the
commonest one (of equally common ones the longest).  Repeated rows and null ids
are rows each.  Components whose eigenvalue is within rounding of 0 don't exist:
one distinct vector gives no components, hence no rows.  A deviation above 64
bits is null.  Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
DEGREE = 10
ROUNDS = 60
CERTIFIED = 1e-13
#: what rounding may leave, where the residual no longer falls
_ROUNDING = 1e-11
FAN_IN = 64
MOST_DIMENSIONS = 8192


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the usable rows with their whole-number vectors, all of one length."""
    named = only(rows, vec_id=id_col, v=vec_col).withColumn("v", F.col("v").cast("array<double>"))
    good = named.where("v is not null and size(v) > 0 and "
                       "forall(v, c -> coalesce(not isnan(c) and abs(c) < 1099511627776D, false))")
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    written = materialize(good.select("vec_id", x.alias("x")), "vectors")
    common = written.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return written.where(F.size("x") == (common["d"] if common else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows."""
    x = batch["x"]
    return x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.empty((0, 0), dtype=np.int64)


def tree_sum(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple, kind=np.float64) -> np.ndarray:
    """Sum of ``part`` over all batches of vectors: one array a task, summed in a tree."""

    def add(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=kind)
        for a in arrays:
            total += a
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=kind).reshape(shape)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(part(_matrix(b)) for b in batches if b.num_rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(read(raw) for b in batches for raw in b["total"].to_pylist())

    sums, tasks = fit.select("x").mapInArrow(first, "total binary"), fit.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(again, "total binary")
    total = np.zeros(shape, dtype=kind)
    for r in sums.collect():  # at most FAN_IN rows
        total += read(r["total"])
    return total


@dataclass
class Whitening:
    """Fitted whitening: row count and sums of the fit list, components as columns, their eigenvalues, all of the variance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is exact, the rest a fraction of one."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it has more than 63 bits."""
        if not len(x):
            return []
        off = x - self.sums // self.n
        rest = (self.sums % self.n).tolist()
        most = int(np.abs(off).max(initial=0)) + 1
        if (most * self.n) ** 2 * x.shape[1] < 1 << 63:
            return ((off * self.n - np.array(rest)) ** 2).sum(axis=1).tolist()
        exact = [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, rest)) for row in off]
        return [v if v < 1 << 63 else None for v in exact]


def chebyshev_filter(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, bound: float,
                     top: float) -> np.ndarray:
    """The block times a scaled Chebyshev polynomial of the operator: at most 1 on [0, bound] where it is 1 at ``top``."""
    centre = half = bound / 2
    sigma = start = half / (centre - top)
    before, now = block, (apply(block) - centre * block) * (start / half)
    for _ in range(degree - 1):
        following = 1 / (2 / start - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, degree: int = DEGREE, rounds: int = ROUNDS) -> Whitening | None:
    """The whitening of a written table of distinct vectors ``x`` of one length; None if it is empty."""
    head = fit.first()
    if head is None:
        return None
    d = len(head["x"])
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the block and its products are held to {MOST_DIMENSIONS}")
    counted = tree_sum(fit, lambda x: np.append(x.sum(axis=0), len(x)), (d + 1,), np.int64)
    out = Whitening(int(counted[-1]), counted[:-1], np.empty((d, 0)), np.empty(0), 0.0)
    out.trace = float(tree_sum(fit, lambda x: np.array([(out.centred(x) ** 2).sum()]), (1,))[0]) / out.n
    if out.trace <= 0:
        return out

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = out.centred(x)
            return c.T @ (c @ q)

        out.passes += 1
        return tree_sum(fit, part, q.shape) / out.n

    wanted = min(components, d, out.n - 1)
    width = min(d, max(2 * wanted, wanted + 16))
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((d, width)))[0]
    least = np.inf
    for _ in range(rounds):
        product = apply(block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        real = values[:wanted] > 1e-12 * values[0]  # the rest is within rounding of 0
        residual = np.linalg.norm(product[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0)[real].max()
        falls, least = residual < least / 2, min(least, residual)
        if residual <= CERTIFIED * values[0] or (not falls and residual <= _ROUNDING * values[0]):
            out.vectors, out.values = block[:, :wanted][:, real], values[:wanted][real]
            break
        if values[-1] > 1e-9 * values[0]:
            block = chebyshev_filter(apply, block, degree, float(values[-1]), float(values[0]))
        else:  # the block spans more than there is: the operator itself damps the rest
            block = product
        block = np.linalg.qr(block)[0]
    else:
        raise ArithmeticError(f"not certified after {rounds} rounds: residual {residual:.3g}")
    k = len(out.values)
    square = tree_sum(fit, lambda x: (lambda w: w.T @ w)(out.whitened(x)), (k, k)) / out.n
    out.identity_error = float(np.abs(square - np.eye(k)).max())
    return out


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           **options) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened array) of every usable row, and the fitted whitening."""
    vectors = usable(rows, id_col, vec_col)
    fitted = fit_whitening(materialize(vectors.select("x").distinct(), "distinct-vectors"), components, **options)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], pa.array(fitted.deviations(x), pa.int64()), pa.array(list(fitted.whitened(x)), pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "whitened"])

    out = vectors.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")
    return out.withColumnRenamed("vec_id", id_col), fitted


def report(whitened: DataFrame, fitted: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component: n, deviation, whitened, explained and identity_error."""
    shares = [float(e / fitted.trace) for e in fitted.values] if fitted else []
    explained = F.array(*[F.lit(s) for s in shares]) if shares else F.array().cast("array<double>")
    rows = whitened.select(id_col, "deviation", F.posexplode("whitened").alias("_at", "_value"))
    return rows.select(id_col, (F.col("_at") + 1).cast("int").alias("component"),
                       F.lit(fitted.n if fitted else 0).cast("long").alias("n"), "deviation", F.col("_value").alias("whitened"),
                       F.get(explained, F.col("_at")).alias("explained"),
                       F.lit(fitted.identity_error if fitted else 0.0).alias("identity_error"))
