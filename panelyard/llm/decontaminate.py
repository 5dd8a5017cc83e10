"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over ``span`` words that ignores some positions, so a hit survives a substituted word there.
The eight masks of six words meet every stretch of 12, 16 or 20 words in which at most 3, 4 or 5 words differ, wherever
these are. An overlap of any length from 12 words on in which three quarters agree holds such a stretch: it can be cut
into parts of 12 to 23 words, in one of which three quarters agree. So no overlap escapes verification.
Masked windows of the benchmark items and of the documents are hashed and joined. The hashes of the documents are
never shuffled as a whole: a Bloom bitmap, sized by the number of item windows and built by Spark, lets through the
windows that may hit. Neighbouring windows that pass become one segment of a document, with its word hashes and as many
words on both sides as the longest item has, so every alignment of an item with a hit lies inside the hit's segment.
The segments' hashes join the items' exactly, and each (segment, item, alignment) that meets is verified: the longest
stretch of the alignment in which enough words agree has to reach ``least`` words.

Rows: null texts count as empty; items of fewer than ``least`` words are too short to identify and match nothing.
Words are lower-cased before hashing, on both sides. The result of ``overlaps`` has one row per (doc_id, item_id) pair that
overlaps, so rows with the same id are one document there, and a null doc_id is an id. ``clean_documents`` goes by texts:
ids that repeat or are missing decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.tables import packed, text_key
from panelyard.llm.words import mix, salts, slices, word_hashes
from panelyard.session import staged


@dataclass(frozen=True)
class Seeds:
    """``masks``: positions that count, 1, or are ignored, 0; zeros at the end are padding. ``share``: words that have to agree in the overlap.
    ``bitmap_bits``: smallest and largest bitmap, as powers of two; a fuller one lets more windows through to the exact join.

    The masks belong to ``least`` and ``share``: others need masks that meet their patterns.
    """

    masks: tuple[str, ...] = (
        "111011100000", "110100101100", "110011011000", "111000111000", "101111100000", "111101000100", "110101001010", "110010000111",
    )
    least: int = 12
    share: float = 0.75
    bitmap_bits: tuple[int, int] = (24, 28)

    @property
    def span(self) -> int:
        return len(self.masks[0])

    @property
    def reach(self) -> tuple[int, ...]:
        """Words from the first to the last that counts, per mask."""
        return tuple(m.rindex("1") + 1 for m in self.masks)


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(pc.fill_null(texts, "")))


def seed_hashes(words: np.ndarray, seeds: Seeds) -> np.ndarray:
    """Hash of each masked window, one row of the result per mask and one column per word; windows may cross rows and the end."""
    weights = salts(seeds.span, 17)
    out = np.empty((len(seeds.masks), len(words)), np.uint64)
    out[:] = np.arange(1, len(seeds.masks) + 1, dtype=np.uint64)[:, None]
    for j in range(seeds.span):
        weighed = words[j:] * weights[j]
        for m, mask in enumerate(seeds.masks):
            if mask[j] == "1":
                out[m, : len(weighed)] += weighed
    return mix(out)


def window_starts(bounds: np.ndarray, seeds: Seeds) -> np.ndarray:
    """Marks, per mask, the windows that lie inside one row of at least ``least`` words."""
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(bounds[-1])
    left[np.repeat(counts < seeds.least, counts)] = 0
    return left >= np.array(seeds.reach)[:, None]


def item_seeds(items: DataFrame, seeds: Seeds) -> DataFrame:
    """(seed, item_id, at, words) for each masked window of each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = folded_words(batch.column(1))
            hashes = seed_hashes(words, seeds)
            mask, at = np.nonzero(window_starts(bounds, seeds))
            row = np.searchsorted(bounds, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[mask, at].view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at - bounds[row])],
                ["seed", "item_id", "at"],
            )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(scan, "seed long, item_id long, at long")


def word_lists(items: DataFrame) -> DataFrame:
    """(item_id, item_words): the word hashes of each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = folded_words(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "item_words"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(scan, "item_id long, item_words array<long>")


def bitmap_size(windows: int, limits: tuple[int, int]) -> int:
    """Sixteen bits for each window of an item, within the limits."""
    return 1 << min(max((16 * windows).bit_length(), limits[0]), limits[1])


def bitmap(seeds_of_items: DataFrame, bits: int) -> bytes:
    """Two bits per seed in a bitmap of ``bits``: set words are aggregated by Spark, at most bits / 64 of them."""
    spots = F.explode(F.array(F.pmod("seed", F.lit(bits)), F.pmod(F.shiftright("seed", 32), F.lit(bits))))
    marked = seeds_of_items.select(spots.alias("spot")).select(F.floor(F.col("spot") / 64).alias("word"), F.pmod("spot", F.lit(64)).cast("int").alias("bit"))
    lines = marked.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))
    found = lines.toPandas()
    held = np.zeros(bits // 64, np.int64)
    held[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return held.tobytes()


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def segments(docs: DataFrame, shared: bytes, seeds: Seeds, around: int) -> DataFrame:
    """(doc_id, start, words, hits) for each stretch of a document whose windows pass the bitmap, and ``around`` words on both sides."""
    held = docs.sparkSession.sparkContext.broadcast(shared)
    bits, span = len(shared) * 8, seeds.span

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            texts = batch.column(1)
            for low, high in slices(texts):
                part = batch.slice(low, high - low)
                words, bounds = folded_words(part.column(1))
                hashes = seed_hashes(words, seeds)
                inside = window_starts(bounds, seeds)
                signed = hashes.view(np.int64)
                found = []
                for m, line in enumerate(signed):
                    near = np.flatnonzero(inside[m] & marks[line & (bits - 1)])
                    near = near[marks[(line[near] >> 32) & (bits - 1)]]
                    if len(near):
                        found.append((m, near))
                at = np.concatenate([a for _, a in found]) if found else np.zeros(0, np.int64)
                if not len(at):
                    continue
                seed = np.concatenate([signed[m, a] for m, a in found])
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                row = np.searchsorted(bounds, at, "right") - 1
                # a new segment where the row changes or the gap is wider than what goes along on both sides
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(at) > span + 2 * around)])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(at)]]) - 1
                left = np.maximum(at[first] - around, bounds[row[first]])
                right = np.minimum(at[last] + span + around, bounds[row[first] + 1])
                cuts = np.concatenate([[0], np.cumsum(right - left)]).astype(np.int32)
                body = np.concatenate([words[a:b] for a, b in zip(left, right, strict=True)]).view(np.int64)
                sizes = np.diff(np.concatenate([first, [len(at)]]))
                hits = pa.StructArray.from_arrays([pa.array(seed), pa.array(at - np.repeat(left, sizes))], ["seed", "at"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row[first])), pa.array(left - bounds[row[first]]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(body)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(at)]]).astype(np.int32)), hits),
                    ],
                    ["doc_id", "start", "words", "hits"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type(docs)}, start long, words array<long>, hits array<struct<seed:long,at:long>>")


def best_stretch(agree: np.ndarray, share: float) -> tuple[int, int]:
    """Longest run [a, b) that starts and ends with an agreeing word and in which at least ``share`` of the words agree."""
    starts = np.flatnonzero(agree)
    if not len(starts):
        return 0, 0
    ends = starts + 1
    total = np.concatenate([[0.0], np.cumsum(agree - share)])
    # the furthest end whose running surplus is not below the start's: the best surplus of all later ends never rises
    later = np.maximum.accumulate(total[ends][::-1])[::-1]
    last = np.searchsorted(-later, -total[starts] + 1e-9, "right") - 1
    length = np.where(last >= np.arange(len(starts)), ends[last] - starts, 0)
    k = int(np.argmax(length))
    return int(starts[k]), int(starts[k] + length[k])


def overlaps(docs: DataFrame, items: DataFrame, seeds: Seeds | None = None) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, words, agreeing): the longest verified overlap of each pair."""
    return verified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, seeds or Seeds())


def verified(docs: DataFrame, items: DataFrame, seeds: Seeds) -> DataFrame:
    """``overlaps`` for a ``doc_id`` of any type; rows with the same one are one document."""
    item_hits = staged(item_seeds(items, seeds), "seeds")
    lists = staged(word_lists(items), "items")
    windows, around = item_hits.count(), lists.agg(F.max(F.size("item_words"))).first()[0] or 0
    found = staged(segments(docs, bitmap(item_hits, bitmap_size(windows, seeds.bitmap_bits)), seeds, around), "segments")
    found = found.withColumn("segment", F.xxhash64("doc_id", "start", "words"))
    hits = found.select("doc_id", "segment", "start", F.explode("hits").alias("hit")).select("doc_id", "segment", "start", "hit.seed", F.col("hit.at").alias("here"))
    lines = hits.join(item_hits, "seed").select("doc_id", "segment", "start", "item_id", (F.col("here") - F.col("at")).alias("shift")).distinct()
    asked = lines.groupBy("doc_id", "segment", "start", "item_id").agg(F.array_sort(F.collect_set("shift")).alias("shifts"))
    bodies = found.groupBy("doc_id", "segment", "start").agg(F.first("words").alias("words"))
    same = asked["doc_id"].eqNullSafe(bodies["doc_id"]) & (asked["segment"] == bodies["segment"]) & (asked["start"] == bodies["start"])
    pairs = asked.join(bodies, same).select(asked["doc_id"], asked["start"], "item_id", "shifts", "words")
    whole = lists.withColumnRenamed("item_id", "_item")
    pairs = pairs.join(whole, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    least, share = seeds.least, seeds.share

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                words, item = (batch.column(n)[k].values.to_numpy(zero_copy_only=False) for n in ("words", "item_words"))
                best = (0, 0, 0, 0)
                for shift in batch.column("shifts")[k].as_py():
                    a, b = max(shift, 0), min(shift + len(item), len(words))
                    agree = words[a:b] == item[a - shift : b - shift]
                    low, high = best_stretch(agree.astype(np.float64), share)
                    best = max(best, (high - low, int(agree[low:high].sum()), -(a + low), a + low - shift))
                if best[0] >= least:
                    for column, value in zip(out, (k, best[0], best[1], -best[2], best[3]), strict=True):
                        column.append(value)
            rows = pa.array(out[0], pa.int64())
            starts = pc.add(batch.column("start").take(rows), pa.array(out[3], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("item_id").take(rows), starts, pa.array(out[4], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                ["doc_id", "item_id", "doc_start", "item_start", "words", "agreeing"],
            )

    checked = pairs.mapInArrow(check, f"doc_id {id_type(docs)}, item_id long, doc_start long, item_start long, words long, agreeing long")
    best = F.max(F.struct("words", "agreeing", (-F.col("doc_start")).alias("early"), (-F.col("item_start")).alias("first")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.early")).alias("doc_start"), (-F.col("b.first")).alias("item_start"), F.col("b.words").alias("words"), F.col("b.agreeing").alias("agreeing")
    )


def clean_documents(docs: DataFrame, items: DataFrame, seeds: Seeds | None = None) -> DataFrame:
    """The documents whose text overlaps no benchmark item, with all their columns."""
    key = F.unhex(text_key())
    hit = verified(docs.select(key.alias("doc_id"), "text"), items, seeds or Seeds()).select(F.col("doc_id").alias("_hit")).distinct()
    rows = docs.select(packed(docs).alias("_row"), key.alias("_key"))
    return rows.join(hit, F.col("_key") == F.col("_hit"), "left_anti").select("_row.*")
