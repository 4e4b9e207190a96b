"""Whitening of embeddings with MLlib's BlockMatrix.

Entries become whole numbers, floor(64 c) + 1000000, so that sums, means and deviations are exact. Each task packs its rows
into blocks of ``ROWS`` rows and writes them once; a block's number is its row index in the matrix, the last block of a task
is filled up with zero rows, which add nothing. The centred blocks form a distributed BlockMatrix A, cut into ``WIDTH``
columns: A'A is the scatter, its d x d result is decomposed on the driver (d is a vector's length, whatever the number of
rows), and A W projects all rows on the scaled eigenvectors W.

The middle dimension of A'A, which grows with the table, is split, so that no task multiplies more than a few blocks of
each side; the driver knows one pair of numbers per block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut
from .common import only

SCALE, SHIFT = 64, 1_000_000
ROWS = 1024
WIDTH = 1024
COMPONENTS = 32
# Entries from here on, whose whole number a long cannot hold, count as infinite.
WIDEST = 2.0**56
TASK_BITS = 33  # a task's share of monotonically_increasing_id
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """What is learned from all rows: their number, exact sums, covariance and scaled eigenvectors by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    projection: np.ndarray  # d x k; a column of zeros where the eigenvalue is zero to double precision

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [float(v) / trace if trace > 0 else None for v in self.values]

    @property
    def usable(self) -> np.ndarray:
        return np.any(self.projection != 0, axis=0)


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is whole and has the commonest length (of several, the largest)."""
    finite = rows.where(F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < WIDEST), F.lit(False))) & (F.size("embedding") > 0))
    common = finite.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return finite.where(F.size("embedding") == (common.d if common else 0))


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ROWS rows: their ids and whole numbers, row by row."""
    ids: list = []
    held: list[np.ndarray] = []

    def block(count: int) -> pa.RecordBatch:
        taken = pa.array([ids[:count]], pa.list_(pa.int64()))
        x = np.concatenate([h.reshape(len(h), -1) for h in held])
        done = pa.RecordBatch.from_arrays([taken, pa.array([x[:count].tobytes()], pa.binary())], names=["ids", "x"])
        ids[:count], held[:] = [], [x[count:]]
        return done

    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        held.append(np.floor(vectors * float(SCALE)).astype(np.int64) + SHIFT)
        ids.extend(batch.column("vec_id").to_pylist())
        while len(ids) >= ROWS:
            yield block(ROWS)
    if ids:
        yield block(len(ids))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of rows (place -1) and each place's sum over one task's blocks."""
    rows, total = 0, None
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x")):
            part = np.frombuffer(x.as_py(), "<i8").reshape(len(ids), -1)
            rows += len(ids)
            low, high = part & 0xFFFFFFFF, part >> 32  # neither half's sum passes 64 bits
            some = high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
            total = some if total is None else total + some
    if total is not None:
        sums = pa.array([Decimal(rows), *[Decimal(int(t)) for t in total]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), sums], names=["place", "total"])


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exactly: as longs, or as Python integers where those might overflow."""
    if n * max(int(np.abs(x).max()), 1) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(deviations: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; none where a long cannot hold it."""
    widest = max(int(np.abs(deviations).max()), 1)
    if widest * widest * deviations.shape[1] >= 1 << 63:
        deviations = deviations.astype(object)
    return [int(s) if s <= LONGEST else None for s in (deviations * deviations).sum(1).tolist()]


def _part(first: list[int], tasks: list[int], number: int) -> int:
    """The id under which the block of this number was written."""
    at = bisect_right(first, number) - 1
    return (tasks[at] << TASK_BITS) + number - first[at]


class _Blocks:
    """The table of packed rows as row blocks of a matrix."""

    def __init__(self, packed: DataFrame):
        self.packed = packed  # part, ids, x
        tasks = packed.groupBy(F.expr(f"part >> {TASK_BITS}").alias("task")).count().orderBy("task").collect()
        self.tasks = [r.task for r in tasks]
        self.first = np.cumsum([0, *[r["count"] for r in tasks]]).tolist()
        self.count = self.first[-1]

    def matrix(self, rows: RDD, columns: int, centre: object) -> BlockMatrix:
        """The centred BlockMatrix of ``rows`` (part, values); ``centre`` makes a float matrix of a row's values."""
        first, mask = dict(zip(self.tasks, self.first)), (1 << TASK_BITS) - 1

        def blocks(row: Row) -> Iterator[tuple[tuple[int, int], DenseMatrix]]:
            values = centre(row)
            number = first[row.part >> TASK_BITS] + (row.part & mask)
            whole = np.zeros((ROWS, columns))
            whole[: len(values)] = values
            for j, begin in enumerate(range(0, columns, WIDTH)):
                some = whole[:, begin : begin + WIDTH]
                yield (number, j), DenseMatrix(ROWS, some.shape[1], some.ravel(order="F"))

        return BlockMatrix(rows.flatMap(blocks), ROWS, min(WIDTH, columns), self.count * ROWS, columns)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right with the middle dimension in ``splits`` parts, an argument that only MLlib's Scala API offers."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix, count: int) -> np.ndarray:
    return _product(matrix.transpose(), matrix, min(count, 4 * (isqrt(count) + 1))).toLocalMatrix().toArray()


def _eigen(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    enough = values > np.trace(covariance) * len(covariance) * 2.0**-52
    scale = np.zeros(len(values))
    scale[enough] = 1 / np.sqrt(values[enough])
    return values, vectors * scale


def _expand(fit: Fit, error: float | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector and component."""
    k, explained, usable = len(fit.values), fit.explained, fit.usable
    for batch in batches:
        for ids, deviation, y in zip(batch.column("ids").to_pylist(), batch.column("deviation").to_pylist(), batch.column("y")):
            size = len(ids)
            values = np.frombuffer(y.as_py(), "<f8").reshape(ROWS, k)[:size].ravel()
            column = lambda one, kind: pa.array([one] * (size * k), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i in ids for _ in range(k)], pa.int64()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    column(fit.n, pa.int64()),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array(values, pa.float64(), mask=np.tile(~usable, size)),
                    pa.array(explained * size, pa.float64()),
                    column(error, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    Rows go whose vector is null or empty, holds null, infinite or other non-numbers, or has not the commonest length;
    repeated rows and null ids stay. A component without variance has null ``whitened`` values and no part in
    identity_error, which is null if there is none. ``deviation`` is null where a long cannot hold it. An empty table gives
    no rows.
    """
    spark = embeddings.sparkSession
    given = only(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = _usable(given).mapInArrow(_pack, "ids array<long>, x binary").withColumn("part", F.monotonically_increasing_id())
    blocks = _Blocks(cut(packed, "blocks"))
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not blocks.count:
        return spark.createDataFrame([], columns)

    # one row per place of a vector
    found = blocks.packed.select("ids", "x").mapInArrow(_sums, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    totals = {r.place: int(r.total) for r in found.collect()}
    n, sums = totals.pop(-1), tuple(totals[i] for i in range(len(totals)))
    d = len(sums)

    def centred(row: Row) -> np.ndarray:
        return (_deviations(np.frombuffer(row.x, "<i8").reshape(-1, d), n, sums) / n).astype(float)

    a = blocks.matrix(blocks.packed.select("part", "x").rdd, d, centred)
    covariance = _scatter(a, blocks.count) / n
    values, projection = _eigen(covariance, min(components, d))
    fit = Fit(n, sums, covariance, values, projection)
    k = len(values)

    width = min(WIDTH, d)
    parts = [((j, 0), Matrices.dense(len(p), k, p.ravel(order="F"))) for j, p in enumerate(projection[b : b + width] for b in range(0, d, width))]
    w = BlockMatrix(spark.sparkContext.parallelize(parts, 1), width, k, d, k)
    first, tasks = blocks.first, blocks.tasks
    projected = _product(a, w, 1).blocks.map(lambda b: (_part(first, tasks, b[0][0]), bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))
    y = cut(spark.createDataFrame(projected, "part long, y binary"), "projected")

    sizes = blocks.packed.select("part", F.size("ids").alias("rows"))
    sized = y.join(sizes, "part")

    def mean_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            for one in batch.column("y"):
                total += np.frombuffer(one.as_py(), "<f8").reshape(ROWS, k).sum(0)  # rows that fill up are zero
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["place", "total"])

    mean = np.zeros(k)
    for r in y.select("y").mapInArrow(mean_of, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        mean[r.place] = r.total / n
    again = blocks.matrix(sized.rdd, k, lambda row: np.frombuffer(row.y, "<f8").reshape(ROWS, k)[: row.rows] - mean)
    off = np.abs(_scatter(again, blocks.count) / n - np.eye(k))[np.ix_(fit.usable, fit.usable)]
    error = float(off.max()) if off.size else None

    def deviate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_squares(_deviations(np.frombuffer(x.as_py(), "<i8").reshape(-1, d), n, sums)) for x in batch.column("x")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("ids"), pa.array(done, pa.list_(pa.int64()))], names=["part", "ids", "deviation"])

    exact = blocks.packed.select("part", "ids", "x").mapInArrow(deviate, "part long, ids array<long>, deviation array<long>")
    return exact.join(y, "part").mapInArrow(partial(_expand, fit, error), columns)
