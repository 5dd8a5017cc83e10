"""Centroid clustering by Lloyd's rounds, with a filter in coordinates rotated to the principal axes.

Vectors become integer vectors x, entry by entry floor(256 * c). The principal axes of all of them give a rotation; each
vector stores its ``lead`` leading rotated coordinates p and the norm r of what remains. For a centroid with p' and r',
|p - p'|^2 + (r - r')^2 never exceeds the squared distance, since the remainders differ by at least the difference of
their norms. So the centroid with the smallest bound is measured first, in integers; only centroids whose bound (less a
margin for rounding) does not exceed that distance are measured too. The nearest one is exact, ties go to the smaller
number.

The first centroids are the vectors with the smallest hex SHA-256 of ``<seed>:<id>``, in that order (equal hashes, from
equal ids, by their entries; a null id counts as the text ``null``). A round assigns every vector and replaces each
centroid that has vectors by their floored exact mean. Tasks send one row per centroid and entry; the driver holds
the centroids. Fewer vectors than ``clusters`` give as many centroids as there are vectors, none give none.

Rows whose vector is null, has another number of entries than ``dims`` or holds null or non-finite entries are left out.
Repeated rows count each. Distances are exact decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm.tables import packed
from panelyard.llm.vectors import NARROW, centred_products, finite, principal_axes, sums, whole_steps, wide_array
from panelyard.session import drop_staged, staged

PAIRS = 1 << 15


@dataclass(frozen=True)
class Lloyd:
    """``lead``: rotated coordinates that are kept."""

    clusters: int = 40
    rounds: int = 5
    dims: int = 64
    lead: int = 16
    seed: int = 2


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Leading rotated coordinates, and the norm of the rest as the last column."""
        centred = x.astype(float) - self.mean
        lead = centred @ self.axes
        rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", lead, lead), 0))
        return np.column_stack([lead, rest])


def narrow(*matrices: np.ndarray) -> bool:
    return all(int(np.abs(m).max(initial=0)) < NARROW and m.min(initial=0) > -NARROW for m in matrices)


def squared_distances(x: np.ndarray, rows: np.ndarray, centres: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs; Python integers where 64 bits might not hold them."""
    if not narrow(x, centres):
        x, centres = x.astype(object), centres.astype(object)
    out = np.zeros(len(rows), x.dtype)
    for at in range(0, len(rows), PAIRS):
        apart = x[rows[at : at + PAIRS]] - centres[cols[at : at + PAIRS]]
        out[at : at + PAIRS] = (apart * apart).sum(axis=1)
    return out


def nearest(x: np.ndarray, leads: np.ndarray, centres: np.ndarray, centre_leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector, its exact squared distance, and how many pairs were measured."""
    sizes, centre_sizes = np.einsum("ij,ij->i", leads, leads), np.einsum("ij,ij->i", centre_leads, centre_leads)
    scale = sizes[:, None] + centre_sizes
    bounds = scale - 2 * leads @ centre_leads.T
    every = np.arange(len(x))
    first = bounds.argmin(axis=1)
    reach = squared_distances(x, every, centres, first)
    open_ = bounds - 1e-9 * scale - 1e-6 <= reach.astype(float)[:, None] * (1 + 1e-12)
    open_[every, first] = False
    rows, cols = np.nonzero(open_)
    distances = np.concatenate([reach, squared_distances(x, rows, centres, cols)])
    rows, cols = np.concatenate([every, rows]), np.concatenate([first, cols])
    order = np.lexsort((cols, distances, rows)) if distances.dtype != object else np.array(sorted(range(len(rows)), key=lambda k: (rows[k], distances[k], cols[k])), int)
    best = order[np.searchsorted(rows[order], every)]
    return cols[best], distances[best], len(rows)


def first_centroids(points: DataFrame, p: Lloyd) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))), 256)
    found = points.select(hashed.alias("at"), "_x").orderBy("at", "_x").limit(p.clusters).collect()
    return np.array([r["_x"] for r in found], np.int64).reshape(len(found), p.dims)


def matrices(batch: pa.RecordBatch, p: Lloyd) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p.dims)
    leads = batch.column("_lead").flatten().to_numpy(zero_copy_only=False)
    return x, leads.reshape(batch.num_rows, -1)


def centroid_totals(points: DataFrame, centres: np.ndarray, rotation: Rotation, p: Lloyd) -> dict[int, tuple[int, dict[int, int]]]:
    """Per centroid that has vectors their number and the exact sum of each entry."""
    held = points.sparkSession.sparkContext.broadcast((centres, rotation(centres)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leads = held.value
        totals, counts = np.zeros(now.shape, object), np.zeros(len(now), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrices(batch, p)
            cluster, _, _ = nearest(x, own, now, leads)
            order = np.argsort(cluster, kind="stable")
            there, starts = np.unique(cluster[order], return_index=True)
            body = x[order] if narrow(x) else x[order].astype(object)
            totals[there] += np.add.reduceat(body, starts, axis=0).astype(object)
            counts += np.bincount(cluster, minlength=len(now))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(np.repeat(there, p.dims).astype(np.int32)), "i": pa.array(np.tile(np.arange(p.dims, dtype=np.int32), len(there))),
                "n": pa.array(np.repeat(counts[there], p.dims)), "total": wide_array(totals[there].ravel()),
            }
        )

    made = points.select("_x", "_lead").mapInArrow(add, "cluster int, i int, n long, total decimal(38,0)")
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in made.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out.setdefault(r["cluster"], (r["n"], {}))[1][r["i"]] = int(r["total"])
    return out


def assigned(points: DataFrame, centres: np.ndarray, rotation: Rotation, p: Lloyd) -> DataFrame:
    """The points with ``_cluster`` and exact ``_distance``, without their vectors."""
    held = points.sparkSession.sparkContext.broadcast((centres, rotation(centres)))
    kept = [c for c in points.columns if c not in ("_x", "_lead")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leads = held.value
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = nearest(*matrices(batch, p), now, leads)
                made = [pa.array(cluster.astype(np.int32)), wide_array(distance)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "_cluster", "_distance"])

    schema = T.StructType([points.schema[c] for c in kept]).add("_cluster", T.IntegerType()).add("_distance", T.DecimalType(38, 0))
    return points.mapInArrow(scan, schema)


def lloyd(points: DataFrame, rotation: Rotation, p: Lloyd) -> np.ndarray:
    """The centroids after all rounds."""
    centres = first_centroids(points, p)
    for _ in range(p.rounds if len(centres) else 0):
        centres = centres.copy()
        for cluster, (n, entries) in centroid_totals(points, centres, rotation, p).items():
            centres[cluster] = [entries[i] // n for i in range(p.dims)]
    return centres


def cluster(df: DataFrame, p: Lloyd | None = None, column: str = "embedding", whole: bool = True, id_column: str = "vec_id") -> DataFrame:
    """(_id, _cluster, _distance, _cluster_inertia, _inertia, _centroid, _centroid_sha256) per usable row, and the input row as ``_row`` if ``whole``."""
    p = p or Lloyd()
    spark = df.sparkSession
    vector = F.col(f"`{column}`")
    rows = df.where(finite(vector) & (F.size(vector) == p.dims))
    rows = rows.select(F.col(f"`{id_column}`").alias("_id"), whole_steps(vector).alias("_x"), F.lit(1).cast("long").alias("_one"), *([packed(df).alias("_row")] if whole else []))
    found = sums(rows, "_x", "_one")
    n, total = found.get(p.dims, (0, [0] * p.dims))
    mean = np.array([s / max(n, 1) for s in total])
    products = centred_products(rows, "_x", "_one", {p.dims: mean})
    rotation = Rotation(mean, np.ascontiguousarray(principal_axes(products[p.dims])[1][:, : p.lead]))
    points = staged(rotated(rows.drop("_one"), rotation, p))
    centres = lloyd(points, rotation, p)
    if not len(centres):
        placed = points.drop("_x", "_lead").withColumn("_cluster", F.lit(0)).withColumn("_distance", F.lit(0).cast("decimal(38,0)"))
    else:
        placed = staged(assigned(points, centres, rotation, p))
        drop_staged(points)
    inertia = {r["_cluster"]: int(r["s"]) for r in placed.groupBy("_cluster").agg(F.sum("_distance").alias("s")).collect()}
    every = Decimal(sum(inertia.values()))
    facts = [
        (k, Decimal(inertia[k]), every, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centres) if k in inertia
    ]
    schema = "_cluster int, _cluster_inertia decimal(38,0), _inertia decimal(38,0), _centroid array<long>, _centroid_sha256 string"
    # one row per centroid
    return placed.join(F.broadcast(spark.createDataFrame(facts, schema)), "_cluster")


def rotated(rows: DataFrame, rotation: Rotation, p: Lloyd) -> DataFrame:
    """The rows with ``_lead``: the leading rotated coordinates and the norm of the rest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p.dims)
                leads = rotation(x)
                cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * leads.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(leads.ravel()))], [*batch.schema.names, "_lead"])

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields]).add("_lead", T.ArrayType(T.DoubleType())))
