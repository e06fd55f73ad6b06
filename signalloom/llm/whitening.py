"""Whitening of embeddings with eigenvectors that are refined to full precision.

1. Every vector becomes whole numbers; the fit list holds each distinct one once.
2. Sums per dimension are exact; products of centred vectors are added up per task, then in two levels.
3. The covariance, as wide as a vector is long, comes to the driver. Its eigenvectors are found in 32-bit floats and
   corrected by the matrix-multiplication iteration of Ogita and Aishima in extended precision. Eigenvalues that are
   too close for the correction are a cluster: the covariance is solved again inside the space of their vectors,
   shifted by their mean, so that their differences come out at full relative precision.
4. The components go back to all rows, and the covariance of the whitened fit list is measured in a further pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import materialize

# Products are added up in this many groups first, so that no group grows with the number of tasks alone.
FAN = 64
ROUNDS = 12
EXACT = 2**62


def whole_vectors(df: DataFrame, scale: float, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, x) with x = floor(scale * c) as longs; rows whose vector is null or has a null, NaN or infinity go."""
    c = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(F.col(f"`{vector}`").isNotNull() & ~bad).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * scale).cast("long")).alias("x")
    )


def _rows(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as a matrix of longs; all are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def exact_sums(fit: DataFrame) -> list[int]:
    """Sums per dimension, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                small = max(abs(int(x.min())), abs(int(x.max()))) < EXACT // len(x)
                part = [int(v) for v in (x if small else x.astype(object)).sum(axis=0)]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(str, total))], ["at", "total"])

    parts = fit.select("x").mapInArrow(run, "at int, total string")
    found = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(28,0)")).cast("string").alias("total")).collect()
    return [int(r["total"]) for r in sorted(found, key=lambda r: r["at"])]


def _added(parts: DataFrame) -> np.ndarray:
    """Sum of matrices that tasks give as rows (task, at, row): first in FAN groups for each row, then over these."""

    def add(table: pa.Table) -> pa.Table:
        total = _floats(table.column("row")).sum(axis=0)
        return pa.table({"task": table.column("task")[:1], "at": table.column("at")[:1], "row": pa.array([total], pa.list_(pa.float64()))})

    schema = "task int, at int, row array<double>"
    first = parts.withColumn("task", F.col("task") % FAN).groupBy("task", "at").applyInArrow(add, schema)
    whole = first.withColumn("task", F.lit(0)).groupBy("at").applyInArrow(add, schema).collect()
    return np.array([r["row"] for r in sorted(whole, key=lambda r: r["at"])], float)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(fit: DataFrame, size: int, function) -> np.ndarray:
    """Sum over the fit list of the products of the rows of ``function(x)``, which is ``size`` wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                y = function(_rows(batch.column(0)))
                total += y.T @ y
        # Rows one by one, since a matrix of a wide table is large.
        task = TaskContext.get().partitionId()
        for at in range(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([at], pa.int32()), pa.array([total[at]], pa.list_(pa.float64()))], ["task", "at", "row"]
            )

    return _added(fit.select("x").mapInArrow(run, "task int, at int, row array<double>"))


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of ascending ``values`` whose neighbours are at most ``gap`` apart."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > gap) + 1)


def refined_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix.

    The start is an eigensolution in 32-bit floats. A round computes R = I - X'X and S = X'AX in extended precision and
    corrects X by X E, where E removes the first-order part of both. It squares the error of separate eigenvalues.
    Columns whose eigenvalues are closer than the error bound of the round are solved anew in the space that they span.
    """
    n = len(matrix)
    # A power of two, so that scaling rounds nothing, and 32-bit floats cannot overflow.
    scale = 2.0 ** -np.frexp(np.abs(matrix).max())[1] if n and np.abs(matrix).max() > 0 else 1.0
    a = (np.asarray(matrix, np.longdouble) + np.asarray(matrix, np.longdouble).T) / 2 * scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    values, eye, tiny = np.zeros(n, np.longdouble), np.eye(n, dtype=np.longdouble), np.finfo(float).eps / 64
    for _ in range(ROUNDS):
        r, s = eye - x.T @ x, x.T @ a @ x
        # Rounding must not make S lopsided: the correction divides by small differences and would amplify it.
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values) + r * values
        error = np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float))
        if max(np.abs(off).max(initial=0), np.abs(r).max(initial=0)) <= tiny:
            break
        difference = values[None, :] - values[:, None]
        close = np.abs(difference) <= 2 * error
        x = x + x @ np.where(close, r / 2, (s + r * values[None, :]) / np.where(close, 1, difference))
        for group in _clusters(values.astype(float), 2 * error):
            if 1 < len(group):
                # Orthonormal inside the cluster, then the small problem without its mean.
                q = x[:, group]
                for _ in range(3):
                    q = q + q @ (np.eye(len(group), dtype=np.longdouble) - q.T @ q) / 2
                mean = values[group].mean()
                inner = q.T @ (a @ q - mean * q)
                inner = (inner + inner.T) / 2
                size = np.abs(inner).max()
                turned = np.linalg.eigh((inner / size).astype(float))[1] if size > 0 else np.eye(len(group))
                x[:, group] = q @ turned.astype(np.longdouble)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return (values[order] / scale).astype(float), (x / np.sqrt((x * x).sum(axis=0))).astype(float)


@dataclass
class Whitening:
    """``n`` and ``sums`` of the fit list, the first components as columns with their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)**2; None where the sum exceeds a long."""
        largest = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums))
        if largest * largest * len(self.sums) < EXACT:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v < 2**63 else None for v in (d * d).sum(axis=1)]


def fit_whitening(fit: DataFrame, components: int) -> Whitening:
    """Of a table of distinct vectors ``x``, all equally long. Components without variance are left out."""
    n = fit.count()
    sums = exact_sums(fit)
    mean = np.array([s / n for s in sums])
    covariance = moments(fit, len(sums), lambda x: x - mean) / n
    values, vectors = refined_eigen(covariance)
    trace = float(np.trace(covariance))
    count = int((values[:components] > max(trace, 0.0) * len(sums) * np.finfo(float).eps).sum())
    found = Whitening(n, sums, values[:count], vectors[:, :count], trace, 0.0)
    if count:
        # With a column of ones, the products hold the sums too.
        whitened = moments(fit, count + 1, lambda x: np.hstack([found.project(x), np.ones((len(x), 1))])) / n
        middle = whitened[:count, count]
        found.identity_error = float(np.abs(whitened[:count, :count] - np.outer(middle, middle) - np.eye(count)).max())
    return found


def whiten(
    df: DataFrame, components: int = 4, scale: float = 256.0, vector: str = "embedding", vec_id: str = "vec_id"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component.

    Rows whose vector is null or holds a null or non-finite entry are dropped. Vectors of the commonest length take
    part (the longer of equally common ones), others are dropped: they have no place in one covariance. Each distinct
    whole-number vector counts once in the fit, however many rows have it; every row, also with a null or repeated id,
    gets its rows of the result. Components whose eigenvalue is zero up to rounding are left out, so a table with one
    distinct vector, or none, or of empty vectors gives no rows. ``deviation`` is null where it exceeds a long. The
    covariance, its width squared in doubles, must fit the driver; nothing else that is collected grows with the rows.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, scale, vector, vec_id)
    distinct = materialize(rows.select("x").distinct(), "fit")
    lengths = rows.groupBy(F.size("x").alias("size")).count().collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = max(((r["count"], r["size"]) for r in lengths), default=(0, 0))[1]
    if not size:
        return spark.createDataFrame([], schema)
    found = fit_whitening(distinct.filter(F.size("x") == size), components)
    count = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = _rows(batch.column(1))
            repeated = np.repeat(np.arange(len(x)), count)
            total = len(repeated)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(repeated)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(total, found.n)), pa.array(found.deviations(x), pa.int64()).take(pa.array(repeated)),
                    pa.array(found.project(x).ravel()), pa.array(np.tile(found.values / found.trace, len(x))),
                    pa.array(np.full(total, found.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(F.size("x") == size).mapInArrow(run, schema)
