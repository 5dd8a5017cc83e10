"""Vectors as exact integers, and weighted moments of them as one GEMM per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 256
#: Entries below this size keep squares and products of any usual number of dimensions inside 64 bits.
NARROW = 1 << 26
#: A decimal(38, 0) holds integers up to this one.
WIDEST = 10**38 - 1
WIDE = pa.decimal128(38, 0)


def finite(vector: Column) -> Column:
    """True if the vector is there and every entry is a finite number; an empty vector qualifies."""
    return vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < F.lit(float("inf"))))


def whole_steps(vector: Column) -> Column:
    """Each entry c as the integer floor(256 * c), at most the largest 64-bit one in size."""
    return F.transform(vector, lambda e: F.floor(e.cast("double") * STEP).cast("long"))


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, their vectors as a matrix) for every length of vector in the batch."""
    column = batch.column(name)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(size), at, flat.reshape(len(at), int(size))


def wide_array(values) -> pa.Array:
    """Python integers as decimal(38, 0); null where one does not fit."""
    return pa.array([int(v) if abs(v) <= WIDEST else None for v in values], WIDE)


def sums(table: DataFrame, column: str, weight: str) -> dict[int, tuple[int, list]]:
    """Per length of vector the sum of weights and the weighted sum of every entry; exact if the entries are integers.

    A task adds its batches up and sends one row per entry; the driver gets one per length and entry.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            weights = batch.column(weight).to_numpy(zero_copy_only=False)
            for size, at, x in by_length(batch, column):
                w = weights[at]
                if x.dtype.kind == "i":
                    exact = int(np.abs(x).max(initial=0)) < NARROW and int(w.sum()) < NARROW
                    x, w = (x, w) if exact else (x.astype(object), w.astype(object))
                total, n = w @ x if size else np.zeros(0), int(w.sum())
                before = held.get(size, (0, 0))
                held[size] = (before[0] + n, before[1] + (total.astype(object) if x.dtype.kind in "iO" else total))
        for size, (n, total) in held.items():
            whole = [int(v) if isinstance(v, int) else 0 for v in total]
            part = [0.0 if isinstance(v, int) else float(v) for v in total]
            yield pa.RecordBatch.from_pydict(
                {
                    "size": pa.array([size] * (size + 1), pa.int32()), "i": pa.array(range(-1, size), pa.int32()),
                    "whole": wide_array([n, *whole]), "part": pa.array([0.0, *part]),
                }
            )

    made = table.select(column, weight).mapInArrow(add, "size int, i int, whole decimal(38,0), part double")
    rows = made.groupBy("size", "i").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part")).orderBy("size", "i").collect()
    exact = table.schema[column].dataType.elementType.typeName() in ("long", "integer")
    out: dict[int, tuple[int, list]] = {}
    for r in rows:
        if r["i"] < 0:
            out[r["size"]] = (int(r["whole"]), [])
        else:
            out[r["size"]][1].append(int(r["whole"]) if exact else r["part"])
    return out


def centred_products(table: DataFrame, column: str, weight: str, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per length the weighted sum of (x - mean)(x - mean)', as one GEMM per batch; a task sends one row per pair of entries."""
    held = table.sparkSession.sparkContext.broadcast(means)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(float)
            for size, at, x in by_length(batch, column):
                y = x - held.value[size]
                totals[size] = totals.get(size, 0.0) + (y * weights[at, None]).T @ y
        for size, total in totals.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_pydict(
                {"size": pa.array(np.full(len(i), size, np.int32)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "part": pa.array(total[i, j])}
            )

    made = table.select(column, weight).mapInArrow(add, "size int, i int, j int, part double")
    found = made.groupBy("size", "i", "j").agg(F.sum("part").alias("part")).toPandas()
    out = {size: np.zeros((size, size)) for size in means}
    for size, rows in found.groupby("size"):
        i, j, part = rows["i"].to_numpy(), rows["j"].to_numpy(), rows["part"].to_numpy()
        out[size][i, j] = part
        out[size][j, i] = part
    return out


def principal_axes(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    if axes.size:
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return values, axes
