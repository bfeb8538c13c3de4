"""Whitening of embeddings by their leading principal components, without a covariance matrix.

Entries become fixed-point integers first, so sums and squared deviations are exact. The covariance is only
ever applied: a pass over the centred vectors adds up X'(XQ) for a narrow block Q, one d x m matrix per
task. Chebyshev-filtered subspace iteration runs the three-term recurrence on those passes: with the least
Ritz value of the block as the edge, the polynomial stays small on the unwanted part of the spectrum and
grows fast beyond it. QR and a Rayleigh-Ritz step on the filtered block give new components; the same
pass that Rayleigh-Ritz needs gives the residuals ``|Vq - eq|``, and the iteration goes on until those of
all wanted components are certified to be at rounding level. Certified components are locked: later passes
take them out of the centred vectors, so small components stay exact beside very large ones.

Tasks send d x m numbers, which meet in about the root of as many tasks before the driver adds up the
rest; no vector reaches the driver. A pass costs the vectors' size in reading and no shuffle of rows.
Vectors that come again, however often, weigh as often as they come.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry go; so do vectors of
another length than the commonest (the longer of two equally common); a null id stays; rows with one id are
rows of their own; components without variance (relative to the first) can't be scaled and are left out,
so equal vectors, a single one or none give no rows; deviations beyond 63 bits are null; entries may have
any size that fits a long; the ids are carried over and all other columns left aside.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetape.llm.shared import column, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Columns of the block per wanted component: the filter's edge is the least Ritz value of the block.
BLOCK = 4
#: Residual of a certified component, relative to its eigenvalue; below ENOUGH it may also stand still.
CERTIFIED, ENOUGH = 1e-13, 1e-10
#: Filtering stops where the first component would outgrow the last wanted one by this factor.
SPREAD = 1e7
MOST_DEGREE, MOST_ROUNDS = 20, 100
#: Variance below this share of the first component's is none.
FLAT = 1e-12
#: Entries that a task holds as doubles at once.
ENTRIES = 1 << 20


@dataclass
class Whitening:
    """``vectors`` (d x k) are unit eigenvectors by falling ``values``; ``rounds`` and ``residual`` certify them."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    rounds: int
    residual: float

    @property
    def centre(self) -> np.ndarray:
        return centre(self.n, self.sums)


def centre(n: int, sums: list[int]) -> np.ndarray:
    return np.array([s / n for s in sums])


def fixed_point(rows: DataFrame, name: str = "embedding") -> DataFrame:
    """(vec_id, x): ids and integer entries of the rows with a whole vector of the common length, stored."""
    entries = column(rows, name, "array<double>")
    broken = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    whole = stored(
        rows.select(column(rows, "vec_id", "bigint").alias("vec_id"), entries.alias("v"))
        .where(F.col("v").isNotNull() & ~F.coalesce(broken, F.lit(True)))
        .select("vec_id", x.alias("x"))
    )
    common = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("x") == (common["d"] if common else 0))


def matrices(x: pa.ListArray):
    """The vectors of a column as integer matrices of bounded size."""
    rows = len(x)
    whole = x.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    step = max(1, ENTRIES // max(1, whole.shape[1]))
    for start in range(0, rows, step):
        yield whole[start : start + step]


def summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over all matrices of all tasks; None where there are no rows."""

    def total(arrays):
        found = None
        for array in arrays:
            found = array if found is None else found + array
        return [] if found is None else [pickle.dumps(found)]

    def of_vectors(batches):
        sums = total(part(m) for b in batches if b.num_rows for m in matrices(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.binary())], ["part"])

    def of_parts(batches):
        sums = total(pickle.loads(p) for b in batches for p in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.binary())], ["part"])

    parts = vectors.select("x").mapInArrow(of_vectors, "part binary")
    meet = math.isqrt(vectors.rdd.getNumPartitions()) + 1
    rows = parts.repartition(meet).mapInArrow(of_parts, "part binary").collect()
    found = total(pickle.loads(bytes(r["part"])) for r in rows)
    return pickle.loads(found[0]) if found else None


def _exact_sum(m: np.ndarray) -> np.ndarray:
    """(rows, sums...) as whole numbers of any size."""
    largest = max(int(m.max()), -int(m.min())) if m.size else 0
    sums = m.sum(axis=0) if largest * len(m) < 1 << 62 else m.astype(object).sum(axis=0)
    return np.array([len(m), *(int(s) for s in sums)], object)


def fit(vectors: DataFrame, components: int = COMPONENTS, seed: int = 0) -> Whitening | None:
    """The leading components of the vectors' covariance (divisor n); None where there are no vectors."""
    counted = summed(vectors, _exact_sum)
    if counted is None:
        return None
    n, sums = int(counted[0]), [int(s) for s in counted[1:]]
    mean, d = centre(n, sums), len(sums)
    trace = float(summed(vectors, lambda m: np.array([((m - mean) ** 2).sum()]))[0]) / n
    k = min(components, d)
    if not k or not trace:
        return Whitening(n, sums, trace, np.zeros(0), np.zeros((d, 0)), 0, 0.0)

    found, locked = [], np.zeros((d, 0))

    def applied(q: np.ndarray) -> np.ndarray:
        def part(m):
            centred = m - mean
            centred -= (centred @ locked) @ locked.T
            return centred.T @ (centred @ q)

        return summed(vectors, part) / n

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, BLOCK * k))))[0]
    residual, before = 0.0, math.inf
    for rounds in range(1, MOST_ROUNDS + 1):
        vq = applied(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        left = k - len(found)
        if (flat := values[:left] <= FLAT * max([*found[:1], values[0]])).any():
            left = int(flat.argmax())
        far = np.linalg.norm(vq[:, :left] - q[:, :left] * values[:left], axis=0) / values[:left]
        worst = float(far.max(initial=0))
        sure = far <= (ENOUGH if worst > before / 2 else CERTIFIED)
        done = left if sure.all() else int(sure.argmin())
        residual, before = max([residual, *far[:done]]), worst
        found += values[:done].tolist()
        locked, q, values = np.hstack([locked, q[:, :done]]), q[:, done:], values[done:]
        if done == left:
            return Whitening(n, sums, trace, np.array(found), locked, rounds, float(residual))
        q = chebyshev(applied, q, values, left - done)
        q = np.linalg.qr(q - locked @ (locked.T @ q))[0]
    raise RuntimeError(f"components are not certified after {MOST_ROUNDS} rounds: residual {worst:.1e}")


def chebyshev(applied: Callable[[np.ndarray], np.ndarray], q: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The block after a Chebyshev polynomial that is damped between 0 and the block's least Ritz value."""
    edge = max(float(values[-1]), FLAT * float(values[0]))
    half = edge / 2
    first, last = (math.acosh(max(1.0, (float(v) - half) / half)) for v in (values[0], values[k - 1]))
    degree = MOST_DEGREE if first == last else int(math.log(SPREAD) / (first - last))
    degree = min(max(degree, 2), MOST_DEGREE)
    # Scaled by its value at the first Ritz value, so that nothing overflows.
    sigma = half / (float(values[0]) - half)
    tau = 2 / sigma
    old, new = q, (applied(q) - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (tau - sigma)
        old, new = new, (applied(new) - half * new) * (2 * following / half) - old * (sigma * following)
        sigma = following
    return new


def deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) squared, exact; None beyond 63 bits."""
    largest = max([n * max(int(m.max()), -int(m.min())), *map(abs, sums)]) if m.size else 0
    if largest < 1 << 61:
        far = m * n - np.array(sums, np.int64)
        if max(int(far.max()), -int(far.min())) <= math.isqrt((1 << 62) // len(sums)):
            return (far * far).sum(axis=1).tolist()
    far = m.astype(object) * n - np.array(sums, object)
    return [s if s < 1 << 63 else None for s in (far * far).sum(axis=1).tolist()]


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the difference between the covariance of the whitened vectors and the identity."""
    mean, turn = model.centre, model.vectors / np.sqrt(model.values)
    middle = summed(vectors, lambda m: ((m - mean) @ turn).sum(axis=0)) / model.n

    def part(m):
        white = (m - mean) @ turn - middle
        return white.T @ white

    return float(np.abs(summed(vectors, part) / model.n - np.eye(len(model.values))).max())


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): the projections of each vector over the root of their variance."""
    n, sums, mean, turn = model.n, model.sums, model.centre, model.vectors / np.sqrt(model.values)

    def run(batches):
        for batch in batches:
            start = 0
            for m in matrices(batch.column(1)) if batch.num_rows else ():
                white = (m - mean) @ turn
                ends = pa.array(np.arange(len(m) + 1) * turn.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(m)),
                        pa.array(deviations(m, n, sums), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(white.ravel())),
                    ],
                    ["vec_id", "deviation", "whitened"],
                )
                start += len(m)

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def op11_whitening(spark, folder: str) -> DataFrame:
    vectors = fixed_point(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))
    model = fit(vectors)
    shape = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], shape)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    error = identity_error(vectors, model)
    each = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, "at").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
