"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Every task folds its centred rows, block by block, into one triangular factor; factors are stacked and
folded again in rounds until one is left. Its columns are made orthogonal by plane rotations: their
lengths are the standard deviations times the root of the number of rows, and the accumulated
rotations are the components. No covariance is formed, so small deviations keep their digits. What
reaches the driver is of the size of one vector, squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, small_batches

#: An entry c is counted as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Factors that one task folds into one.
FAN = 16
#: Sweeps until the columns are orthogonal; about ten are needed.
SWEEPS = 60
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LARGEST = float(1 << 62)


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # per dimension, exact
    components: np.ndarray  # dimensions x components, of length 1
    deviations: np.ndarray  # standard deviation along each component
    explained: np.ndarray  # share of the whole variance
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        if self.n * float(np.abs(x).max(initial=0)) + float(np.abs(self.sums).max(initial=0)) >= _LARGEST:
            raise OverflowError("n times an entry is beyond 64 bits")
        return self.n * x - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Coordinates of variance 1; 0 along a component without variance."""
        along = (centred / self.n) @ self.components
        return np.divide(along, self.deviations, out=np.zeros_like(along), where=self.deviations > 0)


def whole_numbers(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of long numbers."""
    x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if float(np.abs(x).max(initial=0)) >= _LARGEST:
        raise OverflowError("an entry is beyond 64 bits")
    return x.astype(np.int64).reshape(-1, dimensions) + SHIFT


def usable(df: DataFrame, vector: str) -> DataFrame:
    """vec_id and vector of the rows whose vector has entries, none of them null or not finite."""
    finite = F.forall("_v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    slim = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    return slim.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.coalesce(finite, F.lit(False)))


def _folded(df: DataFrame, over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(over, schema)


def _one(names: str, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names.split(), values, strict=True))])


def _totals(vectors: DataFrame) -> tuple[int, np.ndarray] | None:
    """Number of vectors and sum per dimension, of the vectors of the commonest length (of equals, the longest)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column("_v")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                x = whole_numbers(column.filter(pa.array(lengths == d)), d)
                if len(x) * float(np.abs(x).max()) >= _LARGEST:
                    raise OverflowError("a sum is beyond 64 bits")
                n, sums = found.get(d, (0, np.zeros(d, np.int64)))
                found[d] = n + len(x), sums + x.sum(axis=0)
        for d, (n, sums) in found.items():
            yield _one("d n sums", d, n, sums.tolist())

    parts = materialise(_folded(vectors, add, "d long, n long, sums array<long>"), "whitening-sums")
    best = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    split = parts.filter(F.col("d") == best["d"]).select(F.posexplode("sums").alias("at", "s"))
    sums = np.zeros(best["d"], np.int64)
    for r in split.groupBy("at").agg(F.sum("s").alias("s")).collect():  # one row a dimension
        sums[r["at"]] = r["s"]
    drop_table(parts)
    return best["n"], sums


def _stacked(held: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(held), mode="r")


def _triangle(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangular factor of all centred rows."""
    d, of = len(sums), Whitening(n, sums, np.empty((0, 0)), np.empty(0), np.empty(0))
    most = max(4 * d, 2048)

    def fold(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for block in blocks:
            held.append(block)
            rows += len(block)
            if rows >= most:
                held = [_stacked(held)]
                rows = len(held[0])
        if held:
            yield _one("factor", _stacked(held).tobytes())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(of.centred(whole_numbers(b.column("_v"), d)) / n for b in batches if b.num_rows)

    def factors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(np.frombuffer(f.as_py(), np.float64).reshape(-1, d) for b in batches for f in b.column("factor"))

    factors = materialise(_folded(vectors, rows_of, "factor binary"), "whitening-factors")
    while (many := factors.count()) > 1:
        fewer = materialise(_folded(factors.coalesce(-(-many // FAN)), factors_of, "factor binary"), "whitening-factors")
        drop_table(factors)
        factors = fewer
    last = np.frombuffer(factors.first()["factor"], np.float64).reshape(-1, d)
    drop_table(factors)
    return last


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the orthogonal columns that plane rotations make of a's, falling, and the rotations.

    Columns are paired as in a tournament, so that the pairs of a round are rotated together.
    """
    a = np.array(a, np.float64)
    scale = float(np.abs(a).max(initial=0)) or 1.0
    a /= scale
    d = a.shape[1]
    v = np.eye(d)
    seats = np.arange(d + d % 2)
    close = np.finfo(np.float64).eps * 4
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            left, right = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (left < d) & (right < d)
            p, q = left[real], right[real]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(axis=0), (aq * aq).sum(axis=0), (ap * aq).sum(axis=0)
            size = np.sqrt(alpha * beta)
            turn = (np.abs(gamma) > close * size) & (size > np.finfo(np.float64).tiny)
            if turn.any():
                worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
                zeta = (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                p, q = p[turn], q[turn]
                for m in (a, v):
                    mp, mq = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if worst <= close * d:
            break
    lengths = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order] * scale, v[:, order]


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    d, k = model.components.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whitened(model.centred(whole_numbers(batch.column("_v"), d)))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield _one("sums", total.ravel().tolist())

    parts = _folded(vectors, add, "sums array<double>").select(F.posexplode("sums").alias("at", "s"))
    total = np.zeros((k + 1) * k)
    for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect():  # (k + 1) * k rows
        total[r["at"]] = r["s"]
    total = total.reshape(k + 1, k) / model.n
    covariance = total[:k] - np.outer(total[k], total[k])
    real = model.deviations > 0
    return float(np.abs(covariance - np.eye(k))[np.ix_(real, real)].max(initial=0))


def fit(df: DataFrame, components: int = 8, vector: str = "embedding") -> Whitening | None:
    """Components of all usable vectors, numbered by falling variance; None if there are none.

    Vectors that are null, empty or hold null or non-finite entries teach nothing, nor do those of
    another length than most have. The sign of a component is that its largest coordinate is positive.
    There are no more components than dimensions. A deviation below what rounding leaves counts as 0.
    """
    vectors = usable(df, vector)
    found = _totals(vectors)
    if found is None:
        return None
    n, sums = found
    vectors = vectors.filter(F.size("_v") == len(sums))
    lengths, axes = jacobi(_triangle(vectors, n, sums))
    lengths = np.where(lengths > np.finfo(np.float64).eps * len(lengths) * lengths[0], lengths, 0.0)
    total = float((lengths**2).sum())
    axes = axes[:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)
    explained = lengths[:components] ** 2 / total if total else np.zeros(axes.shape[1])
    model = Whitening(n, sums, axes, lengths[:components] / np.sqrt(n), explained)
    model.identity_error = _identity_error(vectors, model)
    return model


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", model: Whitening | None = None) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    model: one that fit() gave; without one, df's own vectors are fitted. deviation is the sum over
    dimensions of (n * x - sum)^2, an exact long, where x = floor(1024 * c) + 100000; numbers beyond 64
    bits raise an OverflowError. Rows that fit() doesn't learn from are left out. Along a component
    without variance (one row, equal rows) whitened and explained are 0. Repeated rows stay repeated, a
    null vec_id stays null, other columns aren't read, and a table of no rows gives no rows.
    """
    model = model or fit(df, components, vector)
    if model is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    d, k = model.components.shape
    vectors = usable(df, vector).filter(F.size("_v") == d)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = model.centred(whole_numbers(batch.column("_v"), d))
            if float((centred.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) >= _LARGEST:
                raise OverflowError("a deviation is beyond 64 bits")
            m = len(centred)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat((centred * centred).sum(axis=1), k)),
                    pa.array(model.whitened(centred).ravel()),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return _folded(vectors, rows, SCHEMA)
