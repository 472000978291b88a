"""Whitening of vectors along their leading principal components, found by LOBPCG over distributed rows.

A component c becomes the integer floor(1024 * c) + 100000. With n rows and per-dimension sums S, a centred row is
x - S / n, made from the exact n * x - S, so nothing cancels. The covariance V is never built: a step multiplies it with a
block of directions, each task adding up Z'(Z B) over its own rows. Directions are the iterate, its residuals and the
previous directions (LOBPCG); the Rayleigh-Ritz step in their span is a dense problem as wide as three blocks, on the
driver. As many guard vectors as components ride along. Steps go on until every residual |V v - e v| is at rounding
level (1e-14 of the largest eigenvalue, or no longer falling below 1e-11 of it); rows are whitened with certified
components only, and it is an error if the residuals don't get there. Components have either sign, the same for all rows:
the one by which the largest entry is positive.

Rows are read from Parquet in the shared folder in every step and never shuffled; a task sends a number for each entry of
the block. identity_error comes from the whitened values themselves, in a pass of its own.

Defined results: vectors that are null or hold a null or non-finite entry take no part, nor do those of another length than
most or with an entry of 2 ** 40 or more in size; rows that repeat count each, rows without an id too; vectors of fewer
dimensions have as many components; a component without variance (its eigenvalue is rounding noise) is 0 in all rows,
explains 0 and stays out of identity_error, which is 0 if there is no other; deviation is null if it is no long; an
empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import integers, matrix, summed


@dataclass
class Centre:
    """n rows with sums S: per dimension S = n * mean + rest, in integers."""

    n: int
    mean: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n"""
        return (x - self.mean) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2 of each row, exact; None if that is no long."""
        y = x - self.mean
        small = len(x) and int(np.abs(y).max()) * self.n < 2**62 // max(1, x.shape[1]) and int(np.abs(y).max()) ** 2 * x.shape[1] < 2**62
        rest, n = self.rest.tolist(), self.n
        if small:  # n * n * sum(y * y) - 2 * n * sum(y * rest) + sum(rest * rest), whose sums are longs
            out = [n * n * a - 2 * n * b for a, b in zip((y * y).sum(axis=1).tolist(), (y * self.rest).sum(axis=1).tolist(), strict=True)]
            own = sum(r * r for r in rest)
            out = [o + own for o in out]
        else:
            out = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        return [o if o < 2**63 else None for o in out]


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, value) of one task: its rows at -1, its sums by dimension."""
    n, total = 0, None
    for batch in batches:
        if len(batch):
            x = matrix(batch.column(0))
            total = np.zeros(x.shape[1], object) if total is None else total
            n, total = n + len(x), total + np.array(x.sum(axis=0).tolist(), object)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int64()), pa.array([str(v) for v in [n, *total]])], ["at", "value"])


def product(rows: DataFrame, centre: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """(V block, trace of V), summed over all rows where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros(block.shape), 0.0
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), 2048):
                z = centre.rows(x[at : at + 2048])
                total += z.T @ (z @ block)
                trace += float((z * z).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, total.size), pa.int64()), pa.array([trace, *total.ravel().tolist()], pa.float64())], ["at", "value"])

    total = summed(rows.select("x").mapInArrow(run, "at long, value double"), "double")
    return np.array([total[i] for i in range(block.size)]).reshape(block.shape) / centre.n, total[-1] / centre.n


def orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """A basis of what the blocks span, the first block's directions first."""
    basis = np.zeros((len(blocks[0]), 0))
    for b in blocks:
        size = np.linalg.norm(b, axis=0)
        b = b[:, size > 0] / size[size > 0]
        for _ in range(2):  # twice is enough against rounding
            b = b - basis @ (basis.T @ b)
            u, s, _ = np.linalg.svd(b, full_matrices=False)
            b = u[:, s > 1e-10]
        basis = np.hstack([basis, b])[:, : len(basis)]
    return basis


@dataclass
class Components:
    """Unit eigenvectors as columns by falling eigenvalue, the trace, and the residuals of each step."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: list[float]


def lobpcg(rows: DataFrame, centre: Centre, count: int, steps: int = 500, seed: int = 5) -> Components:
    """The leading ``count`` components of the covariance of ``rows`` (x)."""
    dims = len(centre.mean)
    count = min(count, dims)
    x = np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, min(dims, 2 * count)))
    width, residual, before = x.shape[1], np.zeros((dims, 0)), np.zeros((dims, 0))
    x, history = orthonormal(x), []
    for _ in range(steps):
        basis = orthonormal(x, residual, before)
        image, trace = product(rows, centre, basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        before = basis[:, x.shape[1] :] @ turn[x.shape[1] :]
        x, moved = basis @ turn, image @ turn
        residual = moved - x * values
        history.append(float(np.linalg.norm(residual[:, :count], axis=0).max()))
        scale = max(values[0], 0.0)
        if history[-1] <= 1e-14 * scale or history[-1] <= 1e-11 * scale and history[-1] > 0.5 * min(history[:-1], default=np.inf):
            x, values = x[:, :count], values[:count]
            sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(count)])
            return Components(x * sign, np.where(values > dims * 1e-14 * scale, values, 0.0), trace, history)
    raise ArithmeticError(f"residuals stay at {history[-1]} after {steps} steps")


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, plus: int = 100_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(vectors, [F.col(key).cast("long").alias("id")], vector, scale, plus, 2**40)
    sums = {at: int(v) for at, v in summed(rows.select("x").mapInArrow(_column_sums, "at long, value string"), "decimal(38,0)").items()}
    if not sums:
        return vectors.sparkSession.createDataFrame([], schema)
    centre = Centre.of(sums[-1], [sums[i] for i in range(len(sums) - 1)])
    found = lobpcg(rows, centre, components)
    live = found.values > 0
    to = np.divide(found.vectors, np.sqrt(found.values), out=np.zeros_like(found.vectors), where=live)
    count = len(live)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + count, count))
        for batch in batches:
            y = centre.rows(matrix(batch.column(0))) @ to
            total += np.vstack([y.sum(axis=0), y.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], ["at", "value"])

    got = summed(rows.select("x").mapInArrow(squares, "at long, value double"), "double")
    total = np.array([got[i] for i in range((1 + count) * count)]).reshape(1 + count, count) / centre.n
    off = np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(count))[live][:, live]
    error = float(off.max(initial=0.0))
    explained = found.values / found.trace if found.trace > 0 else np.zeros(count)

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            y = centre.rows(x) @ to
            m = len(x) * count
            again = np.repeat(np.arange(len(x)), count)
            columns = [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(m, centre.n, np.int64))]
            columns += [pa.array(centre.deviations(x), pa.int64()).take(pa.array(again)), pa.array(y.ravel(), pa.float64()), pa.array(np.tile(explained, len(x)), pa.float64()), pa.array(np.full(m, error))]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(rows_out, schema)
