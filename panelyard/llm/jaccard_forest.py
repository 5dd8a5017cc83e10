"""Similarity join of texts on word n-grams: MinHash label prefixes of one length, then exact verification.

Every text gets ``trees`` labels of MinHash values, and two texts meet where they share a whole label. The length of the
labels is settled beforehand from the parameters: from ``depth`` it is shortened one value at a time until the chance that
a pair of exactly the wanted similarity meets in some tree reaches the target recall. So this is static banding with the
length of a forest's last step, not a forest whose prefixes are shortened on the data: a join that may miss no link has
to go down to that length for every text, and the longer prefixes would find subsets of the same candidates. Only texts
that meet are compared, on their exact n-gram sets.

* Exact copies are one text: a class, found by a 128-bit key. Links are counted with copies, never expanded.
* Nodes with the same members (close texts meet in many trees) are one group. A pair that meets in several groups is
  counted in the one of its first common tree, so nothing is counted twice.
* A group of many texts is cut into blocks by hash, and each pair of blocks is one unit of work: every text is sent
  once per block, not once per pair, and a unit returns one row per text, never its pairs. So neither a task nor an
  exchange holds the square of a group; the comparisons themselves are the job.

Rows: a null text counts as empty. A text without words has no n-grams and links to its copies only. Fewer than
``n`` words are one n-gram. Rows with a null id or a repeated id count as documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.tables import components, packed, text_key
from panelyard.llm.words import mix, ngrams, salts, slices, word_hashes
from panelyard.session import drop_staged, staged


@dataclass(frozen=True)
class Forest:
    n: int = 5
    similarity: float = 0.8
    recall: float = 0.999
    trees: int = 32
    depth: int = 10
    block_texts: int = 512
    block_grams: int = 400_000

    def recall_at(self, length: int) -> float:
        """Chance that a pair of exactly the wanted similarity shares a prefix of this length in some tree."""
        return 1 - (1 - self.similarity**length) ** self.trees

    def prefix(self) -> int:
        """The longest prefix that reaches the target recall."""
        for length in range(self.depth, 0, -1):
            if self.recall_at(length) >= self.recall:
                return length
        raise ValueError("even one value per tree misses the target recall: use more trees")


def node_keys(grams: np.ndarray, bounds: np.ndarray, trees: int, length: int) -> np.ndarray:
    """The forest nodes of each row: a 64-bit key per tree, from the first ``length`` MinHash values of its label."""
    counts = np.diff(bounds)
    held = counts > 0
    keys = np.zeros((len(counts), trees), np.uint64)
    if not held.any():
        return keys
    starts = bounds[:-1][held]
    values = (grams >> np.uint64(32)).astype(np.uint32)
    factors = (salts(trees * length, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (salts(trees * length, 13) >> np.uint64(32)).astype(np.uint32)
    work = np.empty_like(values)
    for tree in range(trees):
        label = np.full(len(starts), tree + 1, np.uint64)
        for k in range(tree * length, (tree + 1) * length):
            np.multiply(values, factors[k], out=work)
            np.add(work, shifts[k], out=work)
            label = mix((label << np.uint64(1)) ^ np.minimum.reduceat(work, starts).astype(np.uint64))
        keys[held, tree] = label
    return keys


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """(key, doc_id, grams, nodes) per row; ``grams`` counts n-grams with repeats."""
    trees, length, n = forest.trees, forest.prefix(), forest.n

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for low, high in slices(texts):
                grams, bounds = ngrams(*word_hashes(texts.slice(low, high - low)), n, short=True)
                keys = node_keys(grams, bounds, trees, length).view(np.int64)
                counts = np.diff(bounds)
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, trees, 0))]).astype(np.int32)
                nodes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].ravel()))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), nodes], ["key", "doc_id", "grams", "nodes"])

    rows = docs.select(F.unhex(text_key()).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sign, "key binary, doc_id long, grams long, nodes array<long>")


def groups(texts: DataFrame, forest: Forest) -> DataFrame:
    """(key, homes, blocks): for each text that meets another one its group per tree (0: none) and its groups' block counts."""
    met = texts.select("key", "grams", F.posexplode("nodes").alias("tree", "node"))
    # most nodes hold one text: they are counted first, so that only the others meet the rest of the work
    shared = met.groupBy("node").agg(F.count("*").alias("texts")).where(F.col("texts") > 1).select(F.col("node").alias("_node"))
    met = staged(met.join(shared, F.col("node") == F.col("_node")).drop("_node"), "met")
    nodes = met.groupBy("node").agg(
        F.count("*").alias("texts"), F.sum("grams").alias("weight"), F.min("key").alias("low"),
        F.bit_xor(F.xxhash64("key")).alias("mark"), F.bit_xor(F.xxhash64("key", F.lit(7))).alias("check"),
    )
    blocks = F.greatest(F.ceil(F.col("texts") / forest.block_texts), F.ceil(F.col("weight") / forest.block_grams))
    same = ["texts", "low", "mark", "check"]
    # a bounded list: one set of members is a node of each tree at most
    merged = nodes.groupBy(*same).agg(F.min("node").alias("group"), F.max(F.least(blocks, "texts")).alias("blocks"), F.collect_list("node").alias("list"))
    homes = merged.select(F.explode("list").alias("home"), "group", "blocks")
    placed = met.join(homes, F.col("node") == F.col("home")).select("key", "tree", "group", "blocks")
    per_text = placed.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("tree", "group"))).alias("at"), F.collect_set(F.struct("group", "blocks")).alias("blocks")
    )
    trees = F.sequence(F.lit(0), F.lit(forest.trees - 1))
    return per_text.select("key", F.transform(trees, lambda t: F.coalesce(F.try_element_at("at", t), F.lit(0).cast("long"))).alias("homes"), "blocks")


def gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """Replace ``text`` by the sorted distinct n-gram hashes, packed eight bytes each."""
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).schema.add("grams", "binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for low, high in slices(texts):
                grams, bounds = ngrams(*word_hashes(texts.slice(low, high - low)), n, short=True)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*[part.column(batch.schema.get_field_index(c)) for c in kept], pa.array(sets, pa.binary())], [*kept, "grams"])

    return rows.mapInArrow(pack, schema)


def overlaps(sets: list[np.ndarray], split: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets with a common element and the number of common elements.

    With ``split``, only pairs of one set before and one from that position on. The sets form a 0/1 matrix over the
    elements that occur at least twice; its product with itself counts the common ones, a chunk of elements at a time.
    """
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    order = np.cumsum(times > 1) - 1
    row, column = row[shared], order[column[shared]]
    left, right = (len(sets), 0) if split is None else (split, split)
    common = np.zeros((left, len(sets) - right), np.float32)
    width = int(order[-1]) + 1 if len(order) else 0
    step = max(64, (1 << 23) // max(len(sets), 1))
    arranged = np.argsort(column, kind="stable")
    row, column = row[arranged], column[arranged]
    for low in range(0, width, step):
        a, b = np.searchsorted(column, [low, low + step])
        dense = np.zeros((len(sets), min(step, width - low)), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        common += dense[:left] @ dense[right:].T
    i, j = np.nonzero(np.triu(common, 1) if split is None else common)
    return i, j + right, common[i, j].astype(np.int64)


def roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each position's component: labels sink to the least neighbour and jump until they rest."""
    label = np.arange(size)
    while len(left):
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def verify(unit: dict[str, list], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Linked texts of one unit: positions, position of the smallest text in the unit's component, links with copies."""
    first, second = unit["first"][0], unit["second"][0]
    block = np.array(unit["block"])
    order = np.argsort(block != first, kind="stable")
    sets = [np.frombuffer(unit["grams"][k], np.uint64) for k in order]
    split = None if first == second else int((block == first).sum())
    if len(sets) < 2 or split == 0 or split == len(sets):
        return None
    i, j, common = overlaps(sets, split)
    sizes = np.array([len(s) for s in sets])
    alike = common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9
    i, j = i[alike], j[alike]
    homes = np.array([unit["homes"][k] for k in order], np.int64)
    home = np.zeros(len(i), np.int64)
    for tree in range(homes.shape[1] - 1, -1, -1):
        ours = homes[i, tree]
        home = np.where((ours == homes[j, tree]) & (ours != 0), ours, home)
    mine = home == unit["group"][0]
    i, j = i[mine], j[mine]
    if not len(i):
        return None
    copies = np.array(unit["copies"], np.int64)[order]
    links = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
    label = roots(len(sets), i, j)
    linked = np.flatnonzero(links)
    return order[linked], order[label[linked]], links[linked].astype(np.int64)


def units(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, root, links) per text and unit in which it has a link."""
    names = ["group", "first", "second", "block", "key", "copies", "homes", "grams"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        made: list[list] = [[], [], []]

        def close() -> None:
            if len(held["key"]) > 1 and (found := verify(held, similarity)):
                at, root, links = found
                made[0] += [held["key"][k] for k in at]
                made[1] += [held["key"][k] for k in root]
                made[2] += links.tolist()
            for n in names:
                held[n] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary()), pa.array(made[2], pa.int64())], ["key", "root", "links"])
            made[:] = [[], [], []]
            return out

        last = None
        for batch in batches:
            columns = [batch.column(n) for n in names[:3]]
            ids = list(zip(*[c.to_pylist() for c in columns], strict=True))
            cuts = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if ids[low] != last:
                    close()
                    last = ids[low]
                part = batch.slice(low, high - low)
                for n in names:
                    held[n] += part.column(n).to_pylist()
            if len(made[0]) > 20_000:
                yield flush()
        close()
        yield flush()

    dealt = rows.select(*names).repartition("group", "first", "second").sortWithinPartitions("group", "first", "second")
    return dealt.mapInArrow(scan, "key binary, root binary, links long")


def similar_texts(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """(doc_id, key, copy_id, root, class_id, copies, links) per document.

    ``key`` names the text and ``copy_id`` is the smallest doc_id with it; ``root`` is the smallest key of the texts
    connected by links, so it names the class, and ``class_id`` the smallest doc_id there, which other classes may hold
    too; ``links`` counts the other documents whose similarity reaches the threshold.
    """
    forest = forest or Forest()
    signed = staged(signatures(docs, forest), "signatures")
    texts = staged(
        signed.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.max("grams").alias("grams"), F.first("nodes").alias("nodes")), "texts"
    )
    met = groups(texts, forest)
    asked = met.join(texts.select("key", "copy_id", "copies"), "key")
    body = docs.select(F.unhex(text_key()).alias("_key"), F.col("doc_id").cast("long").alias("_id"), "text")
    found = body.join(asked, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("copy_id")))
    one = found.dropDuplicates(["_key", "_id"]).select("key", "copies", "homes", "blocks", "text")
    sets = gram_sets(one, forest.n)
    spread = sets.select("key", "copies", "homes", "grams", F.explode("blocks").alias("g")).select("key", "copies", "homes", "grams", "g.group", F.col("g.blocks").alias("n"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    spread = spread.withColumn("other", other).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    linked = staged(units(spread, forest.similarity), "links")
    joined = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    rooted = (
        texts.select("key", "copy_id", "copies")
        .join(joined.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
        .select("key", "copy_id", "copies", F.coalesce("root", "key").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    least = rooted.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    classes = rooted.join(least, "root").select("key", "copy_id", "root", "class_id", "copies", "links")
    return signed.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "copy_id", "root", "class_id", "copies", "links")


def one_per_class(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """The documents without near copies: of every class the one with the smallest id stays, all others go.

    A class is named by its texts, so ids that repeat or are missing neither merge nor split classes. Of equal smallest
    ids in a class, and where all are missing, the one with the smallest key stays.
    """
    found = similar_texts(docs, forest)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_one")).select(
        F.col("_one.doc_id").alias("_id"), F.col("_one.key").alias("_key")
    )
    rows = docs.select(packed(docs).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.unhex(text_key()).alias("_text"))
    chosen = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi")
    return chosen.dropDuplicates(["_doc", "_text"]).select("_row.*")
