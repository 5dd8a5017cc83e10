"""Quantile boosting of many models at once over one binned matrix.

Every model of a joint fit (an arm: a seed, a feature set, a training period, a set of parameters) grows its trees level
by level together with all others: one pass over the matrix adds up the histograms of all arms, nodes and features, through
one shuffle keyed by (arm, feature) where they are many bytes, and the driver finds the best split of every node. Below the
root a pass counts the rows of the smaller child of each node alone: the driver holds the counts of the level above, and the
sibling has the rest. A fit of ten models therefore takes the jobs of one.

The loss is the pinball loss. Its gradient at a row has one of two values, so a histogram is two counts per bin and
splits do not depend on the order of summation. The value of a leaf is the exact, linearly interpolated quantile of its
residuals, found by counting: brackets of every large leaf are narrowed by counts per range of the doubles' bit
patterns until few enough residuals are left to be sent. A first leaf over all rows starts the model at the label's
quantile, and a last one puts the wanted share of its training rows at or below the prediction.

The matrix holds a byte per feature, 0 for missing, and one score per arm, packed column by column for the rows of one
Arrow batch: a pass moves buffers and no single rows. It is dealt evenly over all cores, at least ``LEAST`` and at most
``ROWS`` rows a task and in full rounds of tasks, written to the shared folder and read by every pass; one that fits a single task needs no shuffle.
After ``FOLD`` trees the scores are brought up to date, so a pass never replays more than that many. The driver holds
trees, at most ``KEPT`` bytes of summed histograms (beyond that the tasks that sum them choose the splits), and at most
``TOLD`` bytes of single ones or ``SENT`` residuals.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.scale import attach
from panelyard.session import drop_staged, staged

FOLD = 5
ROWS = 1 << 20
LEAST = 1 << 13
MOST_ARMS = 62
#: Bytes of histograms that one pass may send to the driver; more are summed in a shuffle.
TOLD = 1 << 25
#: Bytes of one level's summed histograms that the driver holds; of more the tasks choose the splits, and every node is counted.
KEPT = 1 << 27
#: Residuals that one round may send to the driver, over all leaves.
SENT = 1 << 19
RANGES = 256
#: Rounds that cut a bracket into ranges of equal width; later ones cut its bit patterns, which always ends.
EVEN = 2
TOP = (1 << 64) - 1
CATEGORY_SMOOTHING = 20.0
#: Points of a column's sketch when it leaves a task, and those held before it is thinned.
POINTS = 10_000
HELD = 1 << 17


@dataclass(frozen=True)
class TreeParams:
    """``columns``: share of the features a tree sees; ``least``: rows on both sides of a split."""

    trees: int = 40
    depth: int = 6
    step: float = 0.1
    subsample: float = 0.8
    bins: int = 64
    columns: float = 0.8
    least: int = 20


@dataclass(frozen=True)
class Arm:
    """One model of a joint fit. ``rows``: condition on its training rows, all if None."""

    name: str
    features: tuple[str, ...]
    params: TreeParams = TreeParams()
    seed: int = 42
    quantile: float = 0.55
    rows: Column | None = None


@dataclass
class Tree:
    """Nodes in heap order from 1; a node without a feature is a leaf. Values include the step."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> Tree:
        size = 1 << (depth + 1)
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    @property
    def depth(self) -> int:
        return len(self.feature).bit_length() - 2

    def place(self, bins: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """The node of the level ``depth`` below which each of ``rows`` (columns of ``bins``) ends; below a leaf, the leftmost."""
        inner = np.flatnonzero(self.feature[: 1 << depth] >= 0)
        node = np.ones(len(rows), np.intp)
        if not len(inner):
            return node << depth
        # no bin is past 255, so rows in a leaf go on to the left
        line, split = np.zeros(1 << depth, np.intp), np.full(1 << depth, 255, np.uint8)
        line[inner], split[inner] = self.feature[inner] * np.intp(bins.shape[1]), self.split[inner]
        flat = bins.ravel()
        for _ in range(depth):
            right = flat.take(line.take(node) + rows) > split.take(node)
            node += node
            node += right
        return node

    def predict(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        value = self.value.copy()
        for level in range(self.depth):
            leaf = (1 << level) + np.flatnonzero(self.feature[1 << level : 2 << level] < 0)
            value[2 * leaf] = value[leaf]
        return value.take(self.place(bins, np.arange(bins.shape[1]) if rows is None else rows, self.depth))


@dataclass(frozen=True)
class Encoding:
    """How columns become bins: thresholds per feature, and label means per category."""

    thresholds: dict[str, np.ndarray]
    categories: tuple[str, ...] = ()
    means: DataFrame | None = None
    overall: float = 0.0

    @property
    def names(self) -> list[str]:
        return list(self.thresholds)

    def prepared(self, rows: DataFrame) -> DataFrame:
        """The rows with one double ``_in0``, ``_in1``, ... per name, in their order; ``bins`` drops what is not a finite number."""
        out = rows
        for c in self.categories:
            dim = self.means.where(F.col("_column") == c).select(F.col("_category").alias(c), F.col("_mean").alias(f"{c}__t"))
            out = attach(out, dim, c).withColumn(f"{c}__t", F.coalesce(f"{c}__t", F.lit(self.overall)))
        return out.select(*rows.columns, *[F.col(f"`{c}`").cast("double").alias(f"_in{k}") for k, c in enumerate(self.names)])

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """One row of bytes per feature."""
        out = np.zeros((len(self.thresholds), batch.num_rows), np.uint8)
        first = batch.num_columns - len(out)
        for k, edges in enumerate(self.thresholds.values()):
            x = batch.column(first + k).to_numpy(zero_copy_only=False)
            known = np.isfinite(x)
            out[k, known] = 1 + np.searchsorted(edges, x[known], "left")
        return out


def tasks_of(df: DataFrame, rows: int) -> int:
    """One task per core, or several full rounds of them, so that no pass ends with a few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(min(rows // LEAST, cores * -(-rows // (ROWS * cores))), 1)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows evenly over all cores; a table of one task stays as it is."""
    tasks = tasks_of(df, rows)
    return df.repartition(tasks) if tasks > 1 else df


def thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts; of more than ``most`` values those that end groups of near equal counts, each for its group."""
    order = np.argsort(values, kind="stable")
    values, total = values[order], np.cumsum(counts[order])
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else order
    if len(ends) > most:
        ends = ends[np.unique(np.searchsorted(total[ends], np.ceil(np.arange(1, most + 1) * (total[-1] / most)).clip(max=total[-1])))]
    return values[ends], np.diff(total[ends], prepend=0)


class Sketch:
    """Weighted values of one column: exact up to ``POINTS`` distinct ones, beyond that a rank is off by at most 1/POINTS per thinning."""

    def __init__(self) -> None:
        self.parts, self.held = [], 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((values, counts))
        self.held += len(values)
        if self.held > HELD:
            self.points()

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts = [thinned(*(np.concatenate(c) for c in zip(*self.parts, strict=True)), POINTS)]
        self.held = len(self.parts[0][0])
        return self.parts[0]


def quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float]) -> dict[int, np.ndarray]:
    """Values at approximate quantiles by position in ``names``; columns without a finite number are left out.

    The rows stay where they are: a task sends one sketch per column, and sketches of a column are merged in one task.
    """
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_{k}") for k, c in enumerate(names)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Sketch() for _ in names]
        for batch in batches:
            for k, one in enumerate(made):
                x = batch.column(k).to_numpy(zero_copy_only=False)
                one.add(*np.unique(x[np.isfinite(x)], return_counts=True))
        found = [(k, *(c.tobytes() for c in one.points())) for k, one in enumerate(made) if one.held]
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], SKETCHED.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Sketch] = {}
        for batch in batches:
            for k, values, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made.setdefault(k, Sketch()).add(np.frombuffer(values, float), np.frombuffer(counts, np.int64))
        at = []
        for one in made.values():
            values, counts = one.points()
            total = np.cumsum(counts)
            at.append(values[np.searchsorted(total, np.ceil(np.array(probs) * total[-1]).clip(min=1))].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array(at, pa.binary())], FOUND.names)

    found = wide.mapInArrow(sketch, SKETCHED).repartition("column").mapInArrow(merge, FOUND)
    return {r["column"]: np.frombuffer(r["values"], float) for r in found.collect()}


def encode(train: DataFrame, features: Sequence[str], categories: Sequence[str], label: str, bins: int) -> Encoding:
    """Thresholds at approximate quantiles and shrunken label means per category, both from all rows of ``train``.

    A feature without any value is left out. Categories of any number are a small table that is joined.
    """
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    probs = F.array(*[F.lit(p) for p in shares])
    found = quantiles(train, features, shares) if features and shares else {}
    thresholds = {c: np.unique(found[k]) for k, c in enumerate(features) if k in found}
    mean = train.agg(F.avg(label)).first()[0]
    overall = float(mean) if mean is not None else 0.0
    if not categories:
        return Encoding(thresholds)
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_category")) for c in categories]))
    cells = train.select(F.col(label).alias("_y"), pair.alias("_p")).groupBy("_p._column", "_p._category").agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    means = staged(cells.select("_column", "_category", ((F.col("_s") + CATEGORY_SMOOTHING * overall) / (F.col("_n") + CATEGORY_SMOOTHING)).alias("_mean")))
    wide = {r["_column"]: r["q"] for r in means.groupBy("_column").agg(F.percentile_approx("_mean", probs, 10_000).alias("q")).collect()}
    thresholds |= {f"{c}__t": np.unique(np.array(wide[c], float)) for c in categories if wide.get(c)}
    return Encoding(thresholds, tuple(categories), means, overall)


@dataclass
class Level:
    """What the driver knows of the last level: the rows of its children, and per arm its nodes with their counts, if it holds them."""

    sizes: dict[tuple[int, int], int] = field(default_factory=dict)
    counts: list[tuple[np.ndarray, np.ndarray]] | None = None


@dataclass(frozen=True)
class Plan:
    """What the tasks of a pass need: the arms' numbers, their unfolded trees and the tree that grows."""

    arms: tuple[tuple[int, int, float, float], ...]  # bit of the row mask, seed, subsample, quantile
    grown: list[list[Tree]]
    trees: list[Tree]
    number: int
    nodes: list[np.ndarray]  # open nodes per arm
    features: list[np.ndarray] = field(default_factory=list)
    depth: int = 0
    bins: int = 64
    least: tuple[int, ...] = ()
    tasks: int = 1
    last: Level | None = None  # stays on the driver

    def slots(self, arm: int) -> np.ndarray:
        """The position in the list of the arm's open nodes by place on the level ``depth``, -1 for none."""
        out = np.full(1 << self.depth, -1, np.int16)
        for k, node in enumerate(self.nodes[arm].tolist()):
            out[(node << self.depth + 1 - node.bit_length()) - (1 << self.depth)] = k
        return out


def salted(numbers: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform in [0, 1) from a row's hash and a salt."""
    x = numbers.view(np.uint64) ^ np.uint64(zlib.crc32(repr(salt).encode()) * 0x9E3779B97F4A7C15 & TOP)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def schema(**columns: T.DataType) -> T.StructType:
    """Built once: parsing a schema for every pass costs more than a small pass."""
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


I, L, D, RAW = T.IntegerType(), T.LongType(), T.DoubleType(), T.BinaryType()
COUNTED = schema(arm=I, feature=I, counts=RAW)
CHOSEN = schema(arm=I, node=I, gain=D, feature=I, split=I, below=L, n=L)
RESIDUALS = schema(arm=I, node=I, spot=I, n=L, data=RAW)
SKETCHED, FOUND = schema(column=I, values=RAW, counts=RAW), schema(column=I, values=RAW)
MATRIX = schema(hash=RAW, mask=RAW, y=RAW, bins=RAW, score=RAW)


class Chunk:
    """The matrix rows of one packed record: a line of ``bins`` per feature and of ``score`` per arm."""

    def __init__(self, record: Sequence[pa.Buffer], arms: int):
        self.hash, self.mask = (np.frombuffer(record[k], np.int64) for k in (0, 1))
        self.y, self.rows = np.frombuffer(record[2], float), len(self.hash)
        self.bins = np.frombuffer(record[3], np.uint8).reshape(-1, self.rows) if record[3].size else np.zeros((0, self.rows), np.uint8)
        self.score = np.frombuffer(record[4], float).reshape(arms, self.rows)

    def residual(self, arm: int, plan: Plan, own: np.ndarray) -> np.ndarray:
        total = self.score[arm].take(own)
        for tree in plan.grown[arm]:
            total += tree.predict(self.bins, own)
        return self.y.take(own) - total

    def bag(self, arm: int, plan: Plan) -> np.ndarray:
        bit, seed, share, _ = plan.arms[arm]
        own = (self.mask >> bit & 1).astype(bool)
        return own if share >= 1 or plan.number < 0 else own & (salted(self.hash, seed, plan.number) < share)

    def placed(self, arm: int, plan: Plan, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the arm's bag in an open node, and the position of that node in the list of open ones."""
        own = np.flatnonzero(self.bag(arm, plan))
        at = slots.take(plan.trees[arm].place(self.bins, own, plan.depth) - (1 << plan.depth))
        there = at >= 0
        return (own, at) if there.all() else (own[there], at[there])


def chunks(batches: Iterator[pa.RecordBatch], arms: int) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk([batch.column(c)[k].as_buffer() for c in range(len(MATRIX))], arms)


def packed(*columns: np.ndarray) -> pa.RecordBatch:
    """The record of one chunk."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], MATRIX.names)


def keep_best(plan: Plan, a: int, nodes: np.ndarray, features: np.ndarray, counts: np.ndarray, best: dict[tuple[int, int], tuple]) -> None:
    """Enter the best split of every node by some features where it beats the one in ``best``; ``counts``: feature, node, above the score or not, bin."""
    n, above = counts.sum(axis=2), counts[:, :, 1]
    rows = n.sum(axis=2)
    left = np.cumsum(n, axis=2)[:, :, :-1]
    # the pinball gradient is 1 - q at or below the score and -q above it
    pull = (1 - plan.arms[a][3]) * n - above
    whole = pull.sum(axis=2)
    part = np.cumsum(pull, axis=2)[:, :, :-1]
    right = rows[:, :, None] - left
    allowed = (left >= plan.least[a]) & (right >= plan.least[a])
    gain = np.where(allowed, part**2 / np.maximum(left, 1) + (whole[:, :, None] - part) ** 2 / np.maximum(right, 1) - (whole**2 / np.maximum(rows, 1))[:, :, None], -1.0)
    split, most = gain.argmax(axis=2), gain.max(axis=2)
    for k, node in enumerate(nodes.tolist()):
        # gains are compared after rounding; only those near the largest can be equal to it then
        for f in np.flatnonzero((most[:, k] > 1e-9) & (most[:, k] >= most[:, k].max(initial=0.0) - 1e-8)):
            made = (round(float(most[f, k]), 9), -int(features[f]), int(split[f, k]), int(left[f, k, split[f, k]]), int(rows[f, k]))
            best[a, node] = max(best.get((a, node), (0.0,)), made)


def bytes_of(plan: Plan) -> int:
    """Of the counts of all open nodes, each of eight bytes."""
    return 16 * plan.bins * sum(len(f) * len(n) for f, n in zip(plan.features, plan.nodes, strict=True))


def counted(matrix: DataFrame, held) -> DataFrame:
    """Per task, arm and feature the rows of every open node by side of the score and bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        arms = len(p.arms)
        sums = [np.zeros((len(p.features[a]), len(p.nodes[a]) * p.bins * 2), np.int64) for a in range(arms)]
        slots = [p.slots(a) for a in range(arms)]
        for rows in chunks(batches, arms):
            for a in range(arms):
                if not len(p.nodes[a]):
                    continue
                own, at = rows.placed(a, p, slots[a])
                if not len(own):
                    continue
                base = (at * np.intp(2) + (rows.residual(a, p, own) > 0)) * p.bins
                for k, f in enumerate(p.features[a]):
                    sums[a][k] += np.bincount(base + rows.bins[f].take(own), minlength=sums[a].shape[1])
        keys = [(a, k) for a in range(arms) for k in range(len(p.features[a])) if len(p.nodes[a])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in keys], pa.int32()), pa.array([int(p.features[a][k]) for a, k in keys], pa.int32()), pa.array([sums[a][k].astype(np.int32).tobytes() for a, k in keys], pa.binary())],
            COUNTED.names,
        )

    return matrix.mapInArrow(count, COUNTED)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(arm, feature, counts) of sorted parts, the parts of each summed."""
    now, total = None, None
    for batch in batches:
        for a, f, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, f) != now:
                if now is not None:
                    yield *now, total
                now, total = (a, f), np.zeros(len(raw) // 4, np.int64)
            total += np.frombuffer(raw, np.int32)
    if now is not None:
        yield *now, total


def histograms(matrix: DataFrame, plan: Plan) -> list[np.ndarray]:
    """Per arm the counts of its open nodes by feature, node, side of the score and bin."""
    out = [np.zeros((len(f), len(n), 2, plan.bins), np.int64) for f, n in zip(plan.features, plan.nodes, strict=True)]
    place = [{int(f): k for k, f in enumerate(features)} for features in plan.features]
    held = matrix.sparkSession.sparkContext.broadcast(plan)
    found = counted(matrix, held)
    kind = np.int32
    if plan.tasks > 1 and plan.tasks * bytes_of(plan) // 2 > TOLD:

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, f, line in added(batches):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([f], pa.int32()), pa.array([line.tobytes()], pa.binary())], COUNTED.names)

        found, kind = found.repartition("arm", "feature").sortWithinPartitions("arm", "feature").mapInArrow(total, COUNTED), np.int64
    for r in found.collect():
        line = out[r["arm"]][place[r["arm"]][r["feature"]]]
        line += np.frombuffer(r["counts"], kind).reshape(line.shape)
    held.destroy()
    return out


def chosen(matrix: DataFrame, plan: Plan) -> dict[tuple[int, int], tuple]:
    """``keep_best`` of all open nodes, found by the tasks that sum the histograms."""
    held = matrix.sparkSession.sparkContext.broadcast(plan)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        best: dict[tuple[int, int], tuple] = {}
        for a, f, line in added(batches):
            keep_best(p, a, p.nodes[a], np.array([f]), line.reshape(1, len(p.nodes[a]), 2, p.bins), best)
        rows = [(*key, *made) for key, made in best.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], CHOSEN.names)

    out: dict[tuple[int, int], tuple] = {}
    for r in counted(matrix, held).repartition("arm", "feature").sortWithinPartitions("arm", "feature").mapInArrow(choose, CHOSEN).collect():
        out[r["arm"], r["node"]] = max(out.get((r["arm"], r["node"]), (0.0,)), tuple(r)[2:])
    held.destroy()
    return out


def best_splits(matrix: DataFrame, plan: Plan) -> dict[tuple[int, int], tuple]:
    """(arm, node) -> (gain, feature, split, rows left, rows) of the best split of every open node that has one.

    Where the driver holds the counts of the last level only the smaller child of a node is counted: its sibling has the rest.
    """
    nodes, last = plan.nodes, plan.last or Level()
    above, last.counts = last.counts, None
    bare = replace(plan, last=None)
    best: dict[tuple[int, int], tuple] = {}
    if bytes_of(plan) > KEPT:
        best = chosen(matrix, bare)
    else:
        counting = nodes if above is None else [
            np.array([2 * p + (last.sizes[a, 2 * p + 1] < last.sizes[a, 2 * p]) for p in np.unique(open_ // 2).tolist()], np.int64) for a, open_ in enumerate(nodes)
        ]
        last.counts = []
        for a, counts in enumerate(histograms(matrix, replace(bare, nodes=counting))):
            if above is not None and len(nodes[a]):
                at, parent = np.searchsorted(counting[a] // 2, nodes[a] // 2), np.searchsorted(above[a][0], nodes[a] // 2)
                own = (counting[a][at] == nodes[a])[:, None, None]
                counts = np.where(own, counts[:, at], above[a][1][:, parent] - counts[:, at])
            last.counts.append((nodes[a], counts))
            if len(nodes[a]):
                keep_best(plan, a, nodes[a], plan.features[a], counts, best)
    return {k: (g, -f, s, left, n) for k, (g, f, s, left, n) in best.items()}


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def of_bits(bits: int) -> float:
    """The double of ``ordered_bits``."""
    return float(np.array([bits ^ 1 << 63 if bits >> 63 else bits ^ TOP], np.uint64).view(float)[0])


def starts(low: int, high: int, turn: int, reach: float) -> np.ndarray:
    """Where the ranges of a bracket start: values at equal distances, the first time closer to 0 and over -reach to reach, or equal ranges of bits."""
    even = np.zeros(0)
    if turn == 0:
        # narrow around 0, where the residuals of a leaf lie after the first trees
        even = reach * np.linspace(-1, 1, RANGES - 1) ** 3
    elif turn < EVEN and np.isfinite([of_bits(low), of_bits(high)]).all():
        even = np.linspace(of_bits(low), of_bits(high), RANGES + 1)[1:-1]
    bits = ordered_bits(even)
    bits = np.unique(bits[(bits > np.uint64(low)) & (bits <= np.uint64(high))])
    if not len(bits):
        bits = np.array(range(low, high + 1, (high - low) // RANGES + 1)[1:], np.uint64)
    return np.concatenate([np.array([low], np.uint64), bits])


def pieces(low: int, high: int) -> np.ndarray:
    return np.array(range(low, high + 1, (high - low) // (RANGES // 2) + 1), np.uint64)


def leaf_quantiles(matrix: DataFrame, plan: Plan, sizes: dict[tuple[int, int], int], reach: float = 1.0) -> dict[tuple[int, int], float]:
    """Exact interpolated quantile of the residuals in every open node of every arm; nodes without rows are left out.

    ``sizes``: rows of the nodes for which they are known. ``reach``: about the largest residual, which only saves rounds.
    """
    arms = len(plan.arms)
    spans = {(a, int(node)): (0, TOP) for a in range(arms) for node in plan.nodes[a]}
    below = dict.fromkeys(spans, 0)
    inside = {k: sizes.get(k) for k in spans}
    sizes = {k: n for k, n in inside.items() if n is not None}
    out: dict[tuple[int, int], float] = {}
    joints: dict[tuple[int, int], tuple[int, int]] = {}
    for turn in itertools.count():
        # a bracket of one value is that value, however many rows hold it
        for key in [k for k, (low, high) in spans.items() if low == high]:
            out[key] = of_bits(spans.pop(key)[0])
        if not spans:
            break
        each = max(64, SENT // len(spans))
        known = sorted((n, k) for k in spans if (n := inside[k]) is not None)
        # the smallest together, as many as one round may send
        whole = itertools.accumulate(n for n, _ in known)
        ready = {k for (n, k), sent in zip(known, whole, strict=True) if n <= each or sent <= SENT}
        # two ranks in ranges of their own: both ranges are cut, as neither end of the bracket could move otherwise
        cuts = {k: np.unique(np.concatenate([pieces(spans[k][0], joints[k][0]), pieces(joints[k][0] + 1, joints[k][0] + 1), pieces(joints[k][1], spans[k][1])])) if k in joints else starts(*spans[k], turn, reach) for k in spans if k not in ready}
        held = matrix.sparkSession.sparkContext.broadcast((plan, spans, cuts))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, edges, ranges = held.value
            counts: dict[tuple[int, int], np.ndarray] = {}
            values: dict[tuple[int, int], list[np.ndarray]] = {}
            slots = [p.slots(a) for a in range(arms)]
            for rows in chunks(batches, arms):
                for a in range(arms):
                    wanted = [k for k in range(len(p.nodes[a])) if (a, int(p.nodes[a][k])) in edges]
                    if not wanted:
                        continue
                    own, at = rows.placed(a, p, slots[a])
                    order = np.argsort(at, kind="stable")
                    residual = rows.residual(a, p, own[order])
                    bits = ordered_bits(residual)
                    ends = np.searchsorted(at[order], np.arange(len(p.nodes[a]) + 1))
                    for k in wanted:
                        key = (a, int(p.nodes[a][k]))
                        mine = slice(ends[k], ends[k + 1])
                        low, high = edges[key]
                        there = (bits[mine] >= np.uint64(low)) & (bits[mine] <= np.uint64(high))
                        if key in ranges:
                            spot = np.searchsorted(ranges[key], bits[mine][there], "right") - 1
                            counts[key] = counts.get(key, 0) + np.bincount(spot, minlength=len(ranges[key]))
                        else:
                            values.setdefault(key, []).append(residual[mine][there])
            made = [(*key, int(spot), int(c[spot]), None) for key, c in counts.items() for spot in np.flatnonzero(c)]
            made += [(*key, -1, 0, np.concatenate(v).tobytes()) for key, v in values.items()]
            columns = list(zip(*made, strict=True)) if made else [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["arm", "node", "spot", "n", "data"])

        counts: dict[tuple[int, int], np.ndarray] = {}
        values: dict[tuple[int, int], list[np.ndarray]] = {}
        sent = matrix.mapInArrow(scan, RESIDUALS)
        if len(ready) < len(spans):
            sent = sent.groupBy("arm", "node", "spot").agg(F.sum("n").alias("n"), F.collect_list("data").alias("data"))
        else:
            sent = sent.withColumn("data", F.array("data"))
        for r in sent.collect():
            key = (r["arm"], r["node"])
            if r["spot"] >= 0:
                counts.setdefault(key, np.zeros(len(cuts[key]), np.int64))[r["spot"]] += r["n"]
            else:
                values.setdefault(key, []).extend(np.frombuffer(d, float) for d in r["data"])
        held.destroy()
        for key in list(spans):
            q = plan.arms[key[0]][3]
            if key in ready:
                found = np.sort(np.concatenate(values[key]))
                rank = q * (sizes[key] - 1)
                low, high = (found[min(max(int(f(rank)) - below[key], 0), len(found) - 1)] for f in (np.floor, np.ceil))
                out[key] = float(low + (high - low) * (rank - np.floor(rank)))
                del spans[key]
                continue
            if key not in counts or not counts[key].sum():
                del spans[key]
                continue
            line = counts[key]
            sizes.setdefault(key, int(line.sum()))
            rank = q * (sizes[key] - 1)
            total = np.cumsum(line) + below[key]
            first, last = (int(np.searchsorted(total, f(rank), "right")) for f in (np.floor, np.ceil))
            begin = cuts[key].tolist()
            joints.pop(key, None)
            if first < last:
                joints[key] = begin[first + 1] - 1, begin[last]
            below[key] = int(total[first - 1]) if first else below[key]
            inside[key] = int(line[first : last + 1].sum())
            spans[key] = (begin[first], begin[last + 1] - 1 if last + 1 < len(begin) else spans[key][1])
    return out


def grow(
    matrix: DataFrame, plan_of: Callable[[list[Tree], list[np.ndarray], int], Plan], open_: list[np.ndarray], depths: Sequence[int], least: Sequence[int],
    gains: list[dict[int, float]], trees: list[Tree],
) -> dict[tuple[int, int], int]:
    """Split the trees of all arms level by level; ``open_`` starts with the root of every arm that grows. Returns the rows of the nodes made."""
    last = Level()
    sizes = last.sizes
    for level in range(max(depths, default=0)):
        nodes = [o if level < depths[a] else np.zeros(0, np.int64) for a, o in enumerate(open_)]
        if not any(len(o) for o in nodes):
            break
        best = best_splits(matrix, replace(plan_of(trees, nodes, level), last=last))
        for a in range(len(trees)):
            after = []
            for node in nodes[a]:
                if (a, int(node)) in best:
                    gain, feature, split, left, n = best[a, int(node)]
                    trees[a].feature[node], trees[a].split[node] = feature, split
                    gains[a][feature] = gains[a].get(feature, 0.0) + gain
                    made = {2 * int(node): left, 2 * int(node) + 1: n - left}
                    sizes |= {(a, child): rows for child, rows in made.items()}
                    after += [child for child, rows in made.items() if rows >= 2 * least[a]]
            open_[a] = np.array(after, np.int64)
    return sizes


def leaves(tree: Tree) -> np.ndarray:
    """The nodes that rows can end in."""
    out, todo = [], [1]
    while todo:
        node = todo.pop()
        if tree.feature[node] < 0:
            out.append(node)
        else:
            todo += [2 * node, 2 * node + 1]
    return np.array(sorted(out), np.int64)


@dataclass(frozen=True)
class Booster:
    """A fitted arm: its trees over the bins of ``encoding``."""

    name: str
    encoding: Encoding
    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    gains: dict[str, float]

    def importances(self) -> dict[str, float]:
        """Total gain per input, largest first."""
        every = {f: self.gains.get(f, 0.0) for f in self.features}
        return dict(sorted(every.items(), key=lambda kv: (-kv[1], kv[0])))

    def predict(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        return predict(rows, {name: self})


def predict(rows: DataFrame, models: Mapping[str, Booster], least: float | None | Mapping[str, float | None] = 0.0, kept: Sequence[str] | None = None) -> DataFrame:
    """The rows with one prediction per model, at least ``least`` (0 where a mapping does not name it).

    The models share one encoding, so bins are made once. ``kept``: columns of the rows that are returned, all if None; others
    are not moved unless they are inputs.
    """
    names = list(models)
    floors = [least.get(n, 0.0) if isinstance(least, Mapping) else least for n in names]
    encoding = models[names[0]].encoding
    assert all(m.encoding is encoding for m in models.values())
    bare = Encoding(encoding.thresholds)
    held = rows.sparkSession.sparkContext.broadcast([models[n].trees for n in names])
    kept = rows.columns if kept is None else list(kept)
    prepared = encoding.prepared(rows).select(*[F.col(f"`{c}`") for c in kept], *[f"_in{k}" for k in range(len(encoding.names))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bare.bins(batch)
            made, sums = [], {}
            for trees, floor in zip(held.value, floors, strict=True):
                if id(trees) not in sums:
                    sums[id(trees)] = sum((t.predict(bins) for t in trees), np.zeros(batch.num_rows))
                total = sums[id(trees)]
                made.append(pa.array(total if floor is None else np.maximum(total, floor)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, *names])

    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in names]])
    return prepared.mapInArrow(scan, schema)


def binned(train: DataFrame, arms: Sequence[Arm], encoding: Encoding, label: str) -> tuple[DataFrame, int, float]:
    """The staged matrix (row hash, bits of the arms that learn from the row, label, bins, and a score per arm), its number of tasks, and about the largest residual."""
    bits = [F.when(F.lit(True) if a.rows is None else F.coalesce(a.rows, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, a in enumerate(arms)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    # exact columns identify a row; sums of doubles may differ in the last digit from run to run
    exact = [c for c, t in train.dtypes if t in ("string", "int", "bigint", "smallint", "tinyint", "date", "timestamp", "boolean")]
    rows = encoding.prepared(train.withColumn("_mask", mask)).where(F.col("_mask") != 0)
    rows = rows.select(F.xxhash64(*[F.col(f"`{c}`") for c in exact], F.round(F.col(label).cast("double"), 6)).alias("hash"), F.col("_mask").alias("mask"), F.col(label).cast("double").alias("y"), *[f"_in{k}" for k in range(len(encoding.names))])
    bare, count = Encoding(encoding.thresholds), len(arms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                yield packed(*known, bare.bins(batch), np.zeros(batch.num_rows * count))

    # of the training rows alone: what is joined to them changes neither their number nor the label
    size = train.where(mask != 0).agg(F.count("*"), F.max(F.abs(F.col(label).cast("double")))).first()
    tasks = tasks_of(train, size[0])
    # packed where they are read: the bytes that are dealt are a sixth of the inputs
    return staged(dealt(rows.mapInArrow(scan, MATRIX), size[0]), "matrix").coalesce(tasks), tasks, 2 * size[1] if size[1] and np.isfinite(size[1]) else 1.0


def folded(matrix: DataFrame, tasks: int, grown: list[list[Tree]]) -> DataFrame:
    """The matrix with the scores of all arms brought up to date."""
    held = matrix.sparkSession.sparkContext.broadcast(grown)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, len(held.value)):
            score = [rows.score[a] + sum((t.predict(rows.bins) for t in trees), np.zeros(rows.rows)) for a, trees in enumerate(held.value)]
            yield packed(rows.hash, rows.mask, rows.y, rows.bins, np.array(score))

    after = staged(matrix.mapInArrow(scan, MATRIX), "matrix").coalesce(tasks)
    drop_staged(matrix)
    return after


def fit_many(
    train: DataFrame, arms: Sequence[Arm], label: str = "log_value", categories: Sequence[str] = (), encoding: Encoding | None = None
) -> dict[str, Booster]:
    """Fit all arms together. Rows without a label are left out; an arm without rows predicts 0.

    Thresholds and category means come from the rows that every arm may learn from, so none sees beyond its period.
    ``encoding``: that of an earlier fit on the same rows with these features among others.
    """
    if not 0 < len(arms) <= MOST_ARMS or len({a.name for a in arms}) < len(arms):
        raise ValueError(f"1 to {MOST_ARMS} arms with names of their own")
    known = train.where(F.col(label).isNotNull())
    common = known
    for a in arms:
        common = common if a.rows is None else common.where(a.rows)
    wanted = list(dict.fromkeys(f for a in arms for f in a.features))
    most = max(a.params.bins for a in arms)
    if encoding is None:
        encoding = encode(common, wanted, categories, label, min(most, 255))
    else:
        asked = [*wanted, *[f"{c}__t" for c in encoding.categories]]
        encoding = replace(encoding, thresholds={f: encoding.thresholds[f] for f in asked if f in encoding.thresholds})
    number = {f: k for k, f in enumerate(encoding.names)}
    own = [[f for f in a.features if f in number] + [f"{c}__t" for c in encoding.categories if f"{c}__t" in number] for a in arms]
    matrix, tasks, reach = binned(known, arms, encoding, label)
    grown: list[list[Tree]] = [[] for _ in arms]
    done: list[list[Tree]] = [[] for _ in arms]
    gains: list[dict[int, float]] = [{} for _ in arms]
    facts = tuple((k, a.seed, a.params.subsample, a.quantile) for k, a in enumerate(arms))
    least = tuple(a.params.least for a in arms)
    step = [1.0] * len(arms)

    def finish(trees: list[Tree], index: int, growing: list[int], sizes: dict[tuple[int, int], int]) -> None:
        nodes = [leaves(t) if a in growing else np.zeros(0, np.int64) for a, t in enumerate(trees)]
        deepest = max((t.depth for t in trees), default=0)
        plan = Plan(facts, grown, trees, index, nodes, depth=deepest)
        for (a, node), value in leaf_quantiles(matrix, plan, sizes, reach).items():
            trees[a].value[node] = step[a] * value
        for a in growing:
            grown[a].append(trees[a])
            done[a].append(trees[a])

    everyone = list(range(len(arms)))
    finish([Tree.of(0) for _ in arms], -1, everyone, {})
    for index in range(max(a.params.trees for a in arms)):
        growing = [k for k, a in enumerate(arms) if index < a.params.trees]
        trees = [Tree.of(arms[k].params.depth if k in growing else 0) for k in everyone]
        sampled = []
        for k, a in enumerate(arms):
            count = max(1, round(a.params.columns * len(own[k])))
            drawn = np.random.default_rng([a.seed, index]).permutation(len(own[k]))[:count]
            sampled.append(np.array(sorted(number[own[k][i]] for i in drawn), np.int64))

        def plan_of(now: list[Tree], nodes: list[np.ndarray], depth: int) -> Plan:
            return Plan(facts, grown, now, index, nodes, sampled, depth, min(most, 255) + 1, least, tasks)

        open_ = [np.array([1] if k in growing and len(sampled[k]) else [], np.int64) for k in everyone]
        sizes = grow(matrix, plan_of, open_, [a.params.depth for a in arms], least, gains, trees)
        step[:] = [a.params.step for a in arms]
        finish(trees, index, growing, sizes)
        if index % FOLD == FOLD - 1:
            matrix = folded(matrix, tasks, grown)
            grown = [[] for _ in arms]
    step[:] = [1.0] * len(arms)
    finish([Tree.of(0) for _ in arms], -1, everyone, {})
    drop_staged(matrix)
    names = encoding.names
    return {
        a.name: Booster(a.name, encoding, tuple(own[k]), tuple(done[k]), {names[f]: g for f, g in gains[k].items()}) for k, a in enumerate(arms)
    }
