"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are its words and word pairs, and the same over word shapes (runs of letters, capitals and digits
shrink to one sign, other signs stay, and a word equal to the one before is marked), hashed into one table of weights.
A text's value of a feature is its share among the n-grams of that kind, so a score is a sparse dot product: the sum of
four means of weights, whatever the length of the text.

Training reads at most ``rows`` labelled documents, those with the smallest hash of their id (of a repeated id one text
for each of its labels): that many ids are broadcast and fetch their whole texts. The sample is split into shards; each runs FTRL-proximal updates over its
documents, and Spark averages the shards' weights. At most 2^bits weights reach the driver. Every document is scored.

A null or empty text has no features and gets the score of the intercept. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.tables import packed, place, smallest
from panelyard.llm.words import ngrams, raw_bytes, slices, span_hashes, word_spans, salts
from panelyard.session import drop_staged, staged

HELD_OUT = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Ftrl:
    """``rows``: bound of the labelled sample. ``shards``: independent learners whose weights are averaged."""

    rows: int = 20_000
    shards: int = 6
    bits: int = 18
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 0.1
    l1: float = 1e-4
    l2: float = 1e-5


SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[128:] = ord("a")
SHAPES[ord("a") : ord("z") + 1] = ord("a")
SHAPES[ord("A") : ord("Z") + 1] = ord("A")
SHAPES[ord("0") : ord("9") + 1] = ord("0")
SHRINKS = np.zeros(256, bool)
SHRINKS[[ord("a"), ord("A"), ord("0")]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    signs = SHAPES[data]
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != signs[:-1]) | ~SHRINKS[signs[1:]]
    keep[starts] = True
    at = np.cumsum(keep) - 1
    return span_hashes(signs[keep], at[starts], at[ends])


def features(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Four kinds of hashed features, each as (feature numbers, row bounds)."""
    data, bounds = raw_bytes(texts)
    starts, ends, rows = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    shapes = shape_hashes(data, starts, ends)
    if len(words):
        same = np.concatenate([[False], words[1:] == words[:-1]])
        same[rows[:-1][rows[:-1] < len(words)]] = False
        shapes = np.where(same, shapes ^ salts(1, 23)[0], shapes)
    shift = np.uint64(64 - bits)
    made = [ngrams(words, rows, 1, seed=31), ngrams(words, rows, 2, seed=32), ngrams(shapes, rows, 1, seed=33), ngrams(shapes, rows, 2, seed=34)]
    return [((grams >> shift).astype(np.int64), cuts) for grams, cuts in made]


def mean_weights(weights: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[numbers])])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def rows_of(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct feature numbers and their shares; number 2^bits is the intercept."""
    for low, high in slices(texts):
        kinds = features(texts.slice(low, high - low), bits)
        for r in range(high - low):
            numbers, shares = [np.array([1 << bits])], [np.ones(1)]
            for grams, cuts in kinds:
                if cuts[r + 1] > cuts[r]:
                    found, times = np.unique(grams[cuts[r] : cuts[r + 1]], return_counts=True)
                    numbers.append(found)
                    shares.append(times / (cuts[r + 1] - cuts[r]))
            found, place_of = np.unique(np.concatenate(numbers), return_inverse=True)
            yield found, np.bincount(place_of, np.concatenate(shares))


def train(texts: pa.Array, labels: np.ndarray, p: Ftrl) -> np.ndarray:
    """Weights after FTRL-proximal passes over the rows in a fixed shuffled order."""
    rows = list(rows_of(texts, p.bits))
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)

    def leader(at: np.ndarray | slice) -> np.ndarray:
        pull = z[at]
        return np.where(np.abs(pull) <= p.l1, 0.0, -(pull - np.sign(pull) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for epoch in range(p.epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[r]
            w = leader(at)
            gradient = (sigmoid(w @ x) - labels[r]) * x
            before = n[at]
            after = before + gradient * gradient
            z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / p.alpha * w
            n[at] = after
    return leader(slice(None))


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl | None = None) -> np.ndarray:
    """2^bits weights and the intercept, learned from rows whose id is not held out."""
    p = p or Ftrl()
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") > 0).cast("int").alias("y"))
    # at most ``rows`` pairs of numbers: small enough to broadcast at any size of the tables
    known = staged(known.distinct().withColumn("at", place("quality", F.col("_id"))))
    sample = smallest(known, known.count(), p.rows, "at", "_id", "y")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    joined = texts.join(F.broadcast(sample), F.col("id") == F.col("_id")).groupBy("at", "id", "y").agg(F.min("text").alias("text"))
    joined = joined.withColumn("shard", F.pmod("at", F.lit(p.shards)))

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("id", "ascending"), ("y", "ascending")])
        weights = train(rows["text"].combine_chunks(), rows["y"].to_numpy(), p)
        at = np.union1d(np.flatnonzero(weights), [1 << p.bits])
        return pa.table({"feature": pa.array(at, pa.int64()), "weight": weights[at]})

    learned = joined.groupBy("shard").applyInArrow(learn, "feature long, weight double")
    summed = learned.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("shards")).toPandas()
    drop_staged(known)
    weights = np.zeros((1 << p.bits) + 1)
    if len(summed):
        # every shard sends the intercept, so its count is the number of shards that had rows
        learners = int(summed.loc[summed["feature"] == 1 << p.bits, "shards"].iloc[0])
        weights[summed["feature"].to_numpy(np.int64)] = summed["weight"].to_numpy() / learners
    return weights


def score(docs: DataFrame, weights: np.ndarray, whole: bool = True) -> DataFrame:
    """(_doc, _score) per document, and the input row as ``_row`` if ``whole``."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(0)):
                part = batch.slice(low, high - low)
                total = np.full(part.num_rows, held.value[-1])
                for numbers, bounds in features(part.column(0), bits):
                    total += mean_weights(held.value, numbers, bounds)
                kept = [part.column(k) for k in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sigmoid(total))], [*part.schema.names[1:], "_score"])

    rows = docs.select("text", F.col("doc_id").cast("long").alias("_doc"), *([packed(docs).alias("_row")] if whole else []))
    return rows.mapInArrow(scan, rows.drop("text").schema.add("_score", "double"))


def good_documents(docs: DataFrame, labels: DataFrame, p: Ftrl | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return score(docs, fit(docs, labels, p)).where(F.col("_score") >= threshold).select("_row.*")
