"""Toxicity by multiple-instance learning: labels belong to documents, scores to their sentences.

A sentence's score is a logistic regression on the hashed words, word pairs and word heads (the first four and five
bytes of longer words) that it holds; a document's score is the noisy-or of its sentences, 1 - product(1 - score). The
learner only ever sees document labels: the gradient of the document's log loss reaches every sentence through the
noisy-or, so the sentences that explain a toxic label take the weight, and the same weights then locate the offending
sentences of any document.

A word is a run of ASCII letters and digits or of bytes above 127, lower-cased in ASCII. A sentence ends after ``.``,
``!``, ``?`` or a line feed; a longer one counts as pieces of ``most`` words. A text without words, a null among them,
has no sentence and scores 0; without labelled rows every text scores 0.

Training reads at most ``rows`` labelled documents, those with the smallest hash of their id (of a repeated id one label
row and the smallest text). They are split into shards of ``each`` or more by that hash; each shard runs FTRL-proximal
updates and Spark averages the weights. Every document is scored over its whole text. Repeated ids and rows are scored
row by row, and all columns of the input, whatever their names, travel in ``_row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.quality import held_out, sigmoid
from panelyard.llm.tables import packed, place, smallest
from panelyard.llm.words import mix, raw_bytes, salts, slices, span_hashes, word_spans
from panelyard.session import drop_staged, staged

THRESHOLD = 0.5


@dataclass(frozen=True)
class Instances:
    """``rows``: bound of the labelled sample. ``each``: documents a learner has, if there are several. ``most``: words of
    a sentence. ``start``: the intercept before learning."""

    rows: int = 20_000
    each: int = 3_000
    bits: int = 18
    most: int = 64
    epochs: int = 8
    start: float = -4.0
    alpha: float = 3.0
    beta: float = 0.1
    l1: float = 2.0
    l2: float = 1e-3


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
GAP = np.ones(256, bool)
GAP[ord("a") : ord("z") + 1] = False
GAP[ord("0") : ord("9") + 1] = False
GAP[128:] = False
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True


HEADS = (4, 5)


@dataclass(frozen=True)
class Sentences:
    """Feature numbers and the sentence each belongs to; per sentence its text's row and its bytes ``[first, last)``."""

    numbers: np.ndarray
    owner: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray


def sentences(texts: pa.Array, bits: int, most: int) -> Sentences:
    data, bounds = raw_bytes(texts)
    low = LOWER[data]
    starts, ends, rows = word_spans(low, bounds, GAP)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Sentences(none, none, none, none, none)
    words = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    stops = np.cumsum(STOP[data])
    natural = np.concatenate([[True], (row[1:] != row[:-1]) | (stops[starts[1:]] != stops[starts[:-1]])])
    heads = np.flatnonzero(natural)
    inside = np.arange(len(starts)) - heads[np.cumsum(natural) - 1]
    opens = natural | (inside % most == 0)
    owner = np.cumsum(opens) - 1
    at = np.flatnonzero(opens)
    closes = np.append(at[1:], len(starts)) - 1
    together = np.flatnonzero(owner[1:] == owner[:-1])
    salt = salts(3 + len(HEADS), 41)
    made = [mix(words * salt[0]), mix(words[together] * salt[1] + words[together + 1] * salt[2])]
    owners = [owner, owner[together]]
    for size, s in zip(HEADS, salt[3:], strict=True):
        longer = np.flatnonzero(ends - starts >= size)
        made.append(mix(span_hashes(low, starts[longer], starts[longer] + size - 1) * s))
        owners.append(owner[longer])
    numbers = (np.concatenate(made) >> np.uint64(64 - bits)).astype(np.int64)
    begin = bounds[row[at]]
    once = np.unique((np.concatenate(owners) << bits) | numbers)
    return Sentences(once & ((1 << bits) - 1), once >> bits, row[at], starts[at] - begin, ends[closes] + 1 - begin)


def logits(weights: np.ndarray, found: Sentences) -> np.ndarray:
    return weights[-1] + np.bincount(found.owner, weights[found.numbers], len(found.row))


def noisy_or(z: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """1 - product(1 - sigmoid(z)) over the sentences of each text."""
    return -np.expm1(-np.bincount(row, np.logaddexp(0, z), count))


def train(texts: pa.Array, labels: np.ndarray, p: Instances) -> np.ndarray:
    """Weights after FTRL-proximal passes over the documents in a fixed shuffled order.

    With d the document's score, the loss falls along score(s) * (1 - y / d) of each sentence s: its own score if the
    document is clean, and less of it the surer the whole document is if it is toxic.
    """
    bags = []
    for low, high in slices(texts):
        for r in range(low, high):
            found = sentences(texts.slice(r, 1), p.bits, p.most)
            at, place_of = np.unique(found.numbers, return_inverse=True)
            bags.append((np.append(at, 1 << p.bits), place_of, found.owner, len(found.row)))
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    start = np.zeros_like(z)
    start[-1] = p.start

    def leader(at: np.ndarray | slice) -> np.ndarray:
        pull = z[at]
        return start[at] + np.where(np.abs(pull) <= p.l1, 0.0, -(pull - np.sign(pull) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for epoch in range(p.epochs):
        for r in np.random.default_rng(epoch).permutation(len(bags)):
            at, place_of, owner, count = bags[r]
            if not count:
                continue
            w = leader(at)
            logit = w[-1] + np.bincount(owner, w[place_of], count)
            whole = max(-np.expm1(-np.logaddexp(0, logit).sum()), 1e-12)
            pull = sigmoid(logit) * (1 - labels[r] / whole)
            gradient = np.append(np.bincount(place_of, pull[owner], len(at) - 1), pull.sum())
            before = n[at]
            after = before + gradient * gradient
            z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / p.alpha * (w - start[at])
            n[at] = after
    return leader(slice(None))


def fit(docs: DataFrame, labels: DataFrame, p: Instances | None = None) -> np.ndarray | None:
    """2^bits weights and the intercept, learned from rows whose id is not held out; None without such rows."""
    p = p or Instances()
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    known = staged(known.withColumn("at", place("toxic", F.col("_id"))))
    have = known.count()
    # at most ``rows`` triples of numbers: small enough to broadcast at any size of the tables
    sample = smallest(known, have, p.rows, "at", "_id")
    shards = max(1, min(have, p.rows) // p.each)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(sample), F.col("id") == F.col("_id")).groupBy("at", "id", "y").agg(F.min("text").alias("text"))

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("id", "ascending")])
        weights = train(rows["text"].combine_chunks(), rows["y"].to_numpy(), p)
        at = np.union1d(np.flatnonzero(weights), [1 << p.bits])
        return pa.table({"feature": pa.array(at, pa.int64()), "weight": weights[at]})

    learned = joined.withColumn("shard", F.pmod("at", F.lit(shards))).groupBy("shard").applyInArrow(learn, "feature long, weight double")
    summed = learned.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("shards")).toPandas()
    drop_staged(known)
    if not len(summed):
        return None
    # every shard sends the intercept, so its count is the number of shards that had rows
    weights = np.zeros((1 << p.bits) + 1)
    learners = int(summed.loc[summed["feature"] == 1 << p.bits, "shards"].iloc[0])
    weights[summed["feature"].to_numpy(np.int64)] = summed["weight"].to_numpy() / learners
    return weights


def score(docs: DataFrame, weights: np.ndarray | None, whole: bool = True, most: int = Instances.most, threshold: float = THRESHOLD) -> DataFrame:
    """(_doc, _score, _sentences, _offending) per document, and the input row as ``_row`` if ``whole``.

    ``_offending`` lists the sentences whose own score reaches the threshold, worst first, as (start, end, score); start
    and end are byte positions in the UTF-8 text.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        bits = (len(w) - 1).bit_length() - 1 if w is not None else 1
        for batch in batches:
            for low, high in slices(batch.column(0)):
                part = batch.slice(low, high - low)
                found = sentences(part.column(0), bits, most)
                z = logits(w, found) if w is not None else np.full(len(found.row), -np.inf)
                own = sigmoid(z)
                bad = np.flatnonzero(own >= threshold)
                bad = bad[np.lexsort((found.first[bad], -own[bad], found.row[bad]))]
                cuts = np.searchsorted(found.row[bad], np.arange(part.num_rows + 1))
                spans = pa.StructArray.from_arrays(
                    [pa.array(found.first[bad], pa.int64()), pa.array(found.last[bad], pa.int64()), pa.array(own[bad])], ["start", "end", "score"]
                )
                made = [
                    pa.array(noisy_or(z, found.row, part.num_rows)), pa.array(np.bincount(found.row, minlength=part.num_rows).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans),
                ]
                kept = [part.column(k) for k in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*part.schema.names[1:], "_score", "_sentences", "_offending"])

    rows = docs.select("text", F.col("doc_id").cast("long").alias("_doc"), *([packed(docs).alias("_row")] if whole else []))
    made = "_score double, _sentences long, _offending array<struct<start:long,end:long,score:double>>"
    schema = rows.drop("text").schema
    for field in docs.sparkSession.createDataFrame([], made).schema:
        schema = schema.add(field)
    return rows.mapInArrow(scan, schema)


def offending_sentences(scored: DataFrame) -> DataFrame:
    """One row per offending sentence of documents scored with ``whole``: (doc_id, rank, start, end, score, sentence)."""
    each = scored.select("_doc", F.encode(F.col("_row.text"), "utf-8").alias("_bytes"), F.posexplode("_offending").alias("_rank", "_at"))
    sentence = F.decode(F.substring("_bytes", F.col("_at.start").cast("int") + 1, (F.col("_at.end") - F.col("_at.start")).cast("int")), "utf-8")
    return each.select(
        F.col("_doc").alias("doc_id"), (F.col("_rank") + 1).alias("rank"), F.col("_at.start").alias("start"), F.col("_at.end").alias("end"),
        F.col("_at.score").alias("score"), sentence.alias("sentence"),
    )
