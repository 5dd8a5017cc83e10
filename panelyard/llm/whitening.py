"""Embedding whitening from a weighted multiplicity covariance.

Vectors become integer vectors x, entry by entry floor(256 * c). Equal x vectors are grouped; each distinct one enters the
fit once, with weight one or with its number of copies. Weighted sums give the mean, a second pass adds up one weighted
centred GEMM per batch, and the covariance's leading eigenvectors whiten each distinct vector once. The results are
joined back to the rows.

Rows whose vector is null or holds null or non-finite entries are left out. Vectors of each length are a space of their
own, fitted apart; an empty vector has no components. A space has as many components as its covariance has positive
eigenvalues (above 1e-12 of their sum), at most ``components``; one distinct vector has none. Ids may repeat or be null.

No row set is gathered: the driver holds one square matrix per length of vector. The join back is a shuffle join on a
128-bit key of x; vectors with more than a thousandth of all rows, at most 1,000, are broadcast instead, so no task
receives all copies of one vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.tables import packed
from panelyard.llm.vectors import NARROW, by_length, centred_products, finite, principal_axes, sums, whole_steps, wide_array
from panelyard.session import staged

HOT_SHARE = 1_000
TINY = 1e-12


@dataclass(frozen=True)
class Space:
    """The fit of one length of vector: weight, exact sums, axes as columns, their eigenvalues and the covariance's trace."""

    n: int
    total: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])


def with_keys(df: DataFrame, column: str) -> DataFrame:
    """Integer vector ``_x`` and its key (_k1, _k2) of every row that has a vector of finite entries."""
    kept = df.where(finite(F.col(column))).withColumn("_x", whole_steps(F.col(column)))
    return kept.withColumn("_k1", F.xxhash64("_x")).withColumn("_k2", F.xxhash64(F.lit(1), F.col("_x")))


def distinct_vectors(keyed: DataFrame) -> DataFrame:
    """(_x, _k1, _k2, _copies, _one) of every distinct integer vector."""
    return keyed.groupBy("_k1", "_k2", "_x").agg(F.count("*").alias("_copies")).withColumn("_one", F.lit(1).cast("long"))


def fit(distinct: DataFrame, components: int = 4, weight: str = "_one") -> dict[int, Space]:
    """One space per length of vector; ``weight`` is ``_one`` or ``_copies``."""
    found = sums(distinct, "_x", weight)
    means = {size: np.array([s / n for s in total]) for size, (n, total) in found.items()}
    products = centred_products(distinct, "_x", weight, means)
    spaces = {}
    for size, (n, total) in found.items():
        values, axes = principal_axes(products[size] / n)
        trace = float(np.trace(products[size] / n))
        rank = int((values > TINY * trace).sum()) if trace > 0 else 0
        keep = min(components, rank)
        spaces[size] = Space(n, total, np.ascontiguousarray(axes[:, :keep]), values[:keep], trace)
    return spaces


def deviations(x: np.ndarray, space: Space) -> np.ndarray:
    """The sum over entries of (n * x - S)^2 as exact Python integers, from n^2 x'x - 2 n x'S + S'S."""
    if int(np.abs(x).max(initial=0)) < NARROW:
        low = np.array([s & 0xFFFFF for s in space.total], np.int64)
        high = np.array([s >> 20 for s in space.total], object)
        squares = np.einsum("ij,ij->i", x, x).astype(object)
        high = high.astype(np.int64) if max((abs(h) for h in high), default=0) < NARROW else high
        cross = (x @ high if high.dtype != object else x.astype(object) @ high).astype(object) * (1 << 20) + (x @ low).astype(object)
    else:
        wide = x.astype(object)
        squares, cross = (wide * wide).sum(axis=1), wide @ np.array(space.total, object)
    return squares * (space.n * space.n) - cross * (2 * space.n) + sum(s * s for s in space.total)


def whitened_vectors(distinct: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """(_k1, _k2, _copies, _one, _n, _deviation, _z, _explained) per distinct vector."""
    held = distinct.sparkSession.sparkContext.broadcast(spaces)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in by_length(batch, "_x"):
                space = held.value[size]
                z = (x - space.mean) @ (space.axes / np.sqrt(space.values))
                count = z.shape[1]
                rows = [batch.column(c).take(pa.array(at)) for c in ("_k1", "_k2", "_copies", "_one")]
                cuts = pa.array(np.arange(len(at) + 1, dtype=np.int32) * count)
                shares = np.tile(space.values / space.trace if count else space.values, len(at))
                made = [
                    pa.array(np.full(len(at), space.n, np.int64)), wide_array(deviations(x, space)),
                    pa.ListArray.from_arrays(cuts, pa.array(z.ravel())), pa.ListArray.from_arrays(cuts, pa.array(shares)),
                ]
                yield pa.RecordBatch.from_arrays([*rows, *made], ["_k1", "_k2", "_copies", "_one", "_n", "_deviation", "_z", "_explained"])

    schema = "_k1 long, _k2 long, _copies long, _one long, _n long, _deviation decimal(38,0), _z array<double>, _explained array<double>"
    return distinct.select("_x", "_k1", "_k2", "_copies", "_one").mapInArrow(scan, schema)


def identity_error(white: DataFrame, weight: str = "_one") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, 0 without components."""
    found = sums(white, "_z", weight)
    means = {size: np.array(total) / n for size, (n, total) in found.items()}
    products = centred_products(white, "_z", weight, means)
    return max((float(np.abs(products[size] / n - np.eye(size)).max()) for size, (n, _) in found.items() if size), default=0.0)


def whiten(df: DataFrame, column: str = "embedding", components: int = 4, weight: str = "_one", whole: bool = True, id_column: str = "vec_id") -> DataFrame:
    """(_id, _n, _deviation, _z, _explained, _identity_error) per row with a usable vector, and the input row as ``_row`` if ``whole``.

    ``_z`` holds the whitened coordinates, ``_explained`` each component's share of the covariance's trace; ``_deviation``
    is exact and null only beyond 38 digits.
    """
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{column}`").alias("_vector"), *([packed(df).alias("_row")] if whole else []))
    keyed = with_keys(rows, "_vector").drop("_vector")
    distinct = staged(distinct_vectors(keyed))
    white = staged(whitened_vectors(distinct, fit(distinct, components, weight)))
    error = identity_error(white, weight)
    every = white.agg(F.sum("_copies")).first()[0] or 0
    # fewer than HOT_SHARE vectors can be as frequent as that: small enough to broadcast at any size of the table
    hot = F.col("_copies") > every // HOT_SHARE + 1
    bare, result = keyed.drop("_x"), white.drop("_one")
    often, rare = F.broadcast(result.where(hot).drop("_copies")), result.where(~hot).drop("_copies")
    others = bare.join(F.broadcast(result.where(hot).select("_k1", "_k2")), ["_k1", "_k2"], "left_anti")
    joined = bare.join(often, ["_k1", "_k2"]).unionByName(others.join(rare, ["_k1", "_k2"]))
    return joined.drop("_k1", "_k2").withColumn("_identity_error", F.lit(error))
