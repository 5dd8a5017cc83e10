"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit is a logistic regression on hashed character n-grams
(two to four bytes of lower-cased letters, other signs are gaps). The classifiers' margins are compared with every
codeword by logistic loss, each bit weighted by its accuracy in training, and the nearest codeword names the language.
A text whose two nearest codewords are about as near is flagged.

Up to six languages use the exhaustive code, more use the best of several pseudo-random codes. Every language of a
training document is learned. Training reads at most ``rows`` documents, the same number of each language but ``least`` of
a language in any case, those with the smallest hash of their id (of a repeated id one text per language); their whole
texts are fetched by broadcast ids. All documents are classified, repeated ids row by row.
A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.quality import held_out
from panelyard.llm.tables import PLACE_BITS, place
from panelyard.llm.words import mix, raw_bytes, slices
from panelyard.session import drop_staged, staged

UNKNOWN = "und"


@dataclass(frozen=True)
class Codes:
    """``rows``: bound of the training sample, but ``least`` of each language; ``near``: largest score gap between the
    best two that counts as ambiguous."""

    rows: int = 4_000
    least: int = 8
    bits: int = 12
    steps: int = 150
    rate: float = 0.5
    l2: float = 1e-4
    near: float = 0.2


def codewords(count: int) -> np.ndarray:
    """One row of -1 and 1 per language; no column is constant and rows are far apart."""
    if count < 2:
        return np.zeros((count, 0))
    if count <= 6:
        columns = [[1] + [1 if number >> k & 1 else -1 for k in range(count - 1)] for number in range(2 ** (count - 1) - 1)]
        return np.array(columns, float).T
    length = max(16, int(np.ceil(8 * np.log2(count))))
    best, spread = None, -1.0
    for seed in range(64):
        drawn = np.random.default_rng(seed).choice([-1.0, 1.0], (count, length))
        apart = (length - drawn @ drawn.T) / 2 + length * np.eye(count)
        if apart.min() > spread and (np.abs(drawn.sum(axis=0)) < count).all():
            best, spread = drawn, apart.min()
    return best


LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[128:] = True


def gram_counts(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Per text the square roots of the shares of its hashed character n-grams; n-grams without a letter do not count."""
    data, bounds = raw_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    letter = LETTER[data]
    signs = np.where(letter, data, 32).astype(np.uint64)
    orders = []
    code, some = signs.copy(), letter.copy()
    for n in (2, 3, 4):
        size = max(len(signs) - n + 1, 0)
        code = (code[:size] << np.uint64(8)) | signs[n - 1 :][:size]
        some = some[:size] | letter[n - 1 :][:size]
        orders.append((n, np.where(some, 1 + (mix(code + np.uint64(n << 40)) % np.uint64((1 << bits) - 1)).astype(np.int64), 0)))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        counts = np.zeros(1 << bits)
        for n, numbers in orders:
            counts += np.bincount(numbers[low : max(high - n + 1, low)], minlength=1 << bits)
        counts[0] = 0
        yield np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def train(x: np.ndarray, signs: np.ndarray, p: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features and intercept, bits) by Adam on the mean logistic loss, and each bit's training accuracy."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros((x.shape[1], signs.shape[1]), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, p.steps + 1):
        pull = -signs / (1 + np.exp(np.clip(signs * (x @ w), -30, 30)))
        gradient = x.T @ pull.astype(np.float32) / len(x) + p.l2 * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= p.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w, ((x @ w) * signs > 0).mean(axis=0)


def decode(margins: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the nearest codeword by weighted logistic loss, its score, and the score of the next one."""
    # 1,024 rows at a time: memory stays bounded whatever the number of languages
    parts = [np.logaddexp(0, -margins[k : k + 1024, None, :] * codes[None, :, :]) @ weights for k in range(0, max(len(margins), 1), 1024)]
    loss = np.concatenate(parts)
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    ordered = np.sort(share, axis=1)
    return best, share[np.arange(len(best)), best], ordered[:, -2] if ordered.shape[1] > 1 else np.zeros(len(best))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def fit(docs: DataFrame, p: Codes | None = None) -> Model:
    """Learn from text and non-null lang of documents whose id is not held out."""
    p = p or Codes()
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").alias("_lang"))
    known = staged(known.groupBy("_id", "_lang").agg(F.count("*").alias("n")).drop("n").withColumn("at", place("lang", F.col("_id"))))
    counts = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts, key=lambda s: s.encode())
    if not names:
        return Model((), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    codes = codewords(len(names))
    each = max(p.least, p.rows // len(names))
    # a bound on the hash leaves a few more than ``each`` rows of a language, and only these are ranked
    bounds = [(name, min(1 << PLACE_BITS, int((each + 6 * each**0.5 + 16) / n * (1 << PLACE_BITS)))) for name, n in counts.items()]
    below = F.broadcast(docs.sparkSession.createDataFrame(bounds, "_lang string, bound long"))
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy("at", "_id"))
    ids = known.join(below, "_lang").where(F.col("at") < F.col("bound")).withColumn("turn", turn).where(F.col("turn") <= each).select("_id", "_lang", "at")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("lang"), "text").where(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(ids), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    joined = joined.groupBy("at", "id", "lang").agg(F.min("text").alias("text")).withColumn("all", F.lit(0))
    numbers = {name: k for k, name in enumerate(names)}

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("id", "ascending"), ("lang", "ascending")])
        texts = rows["text"].combine_chunks()
        x = np.array([line for low, high in slices(texts) for line in gram_counts(texts.slice(low, high - low), p.bits)])
        signs = codes[[numbers[name] for name in rows["lang"].to_pylist()]].astype(np.float32)
        w, right = train(x, signs, p)
        return pa.table({"part": ["weights", "trust"], "data": pa.array([w.astype("<f4").tobytes(), right.astype("<f8").tobytes()], pa.binary())})

    if codes.shape[1]:
        made = {r["part"]: r["data"] for r in joined.groupBy("all").applyInArrow(learn, "part string, data binary").collect()}
        weights = np.frombuffer(made["weights"], "<f4").reshape(-1, codes.shape[1])
        trust = np.frombuffer(made["trust"], "<f8")
    else:
        weights, trust = np.zeros(((1 << p.bits) + 1, 0), np.float32), np.zeros(0)
    drop_staged(known)
    return Model(tuple(names), codes, weights, trust)


def identify(docs: DataFrame, model: Model, near: float = Codes.near) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) per document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        bits = (len(m.weights) - 1).bit_length() - 1 if len(m.weights) else 0
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                texts = part.column(1)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if m.languages:
                    margins = np.array([line @ m.weights[:-1] + m.weights[-1] for line in gram_counts(texts, bits)]).reshape(part.num_rows, -1)
                    best, first, second = decode(margins, m.codes, m.trust)
                    names = np.array(m.languages, object)[best]
                    names[~letters], first[~letters], second[~letters] = UNKNOWN, 0.0, 0.0
                else:
                    names, first, second = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows)
                close = (first - second < near) & (names != UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(np.clip(first, 0, 1)), pa.array(close.astype(bool))], ["doc_id", "lang_pred", "score", "ambiguous"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, lang_pred string, score double, ambiguous boolean")
