"""Sharding by longest processing time: whole groups, largest first, to the least loaded shard.

Only the multiset of group sizes decides the loads, so the heap does not run over groups but over the histogram of
their sizes, largest first, in one pass of one task. It has at most sqrt(2 x total size) rows, whatever the number of
documents. A size that few groups share goes through the heap group by group; for a size that many share the heap's
outcome has a closed form: its groups fill the lowest steps of the staircases load, load + size, load + 2 size, ...
Every size gets a quota per shard, and a distributed rank of the groups of that size picks the shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.tables import add_totals, packed, place, range_bits, range_offsets, running_totals, text_key
from panelyard.session import staged

FEW = 64


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """Add ``count`` groups of ``size`` to ``loads`` as the heap would; returns the groups per shard."""
    taken = [0] * len(loads)
    if count <= FEW:
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            taken[shard] += 1
    else:
        low, high = min(loads), max(loads) + size * count
        # the largest level below which the staircases have at most ``count`` steps
        while low < high:
            level = (low + high + 1) // 2
            if sum(max(0, -((load - level) // size)) for load in loads) <= count:
                low = level
            else:
                high = level - 1
        taken = [max(0, -((load - low) // size)) for load in loads]
        rest = count - sum(taken)
        for shard, load in enumerate(loads):
            if rest and load + taken[shard] * size == low:
                taken[shard] += 1
                rest -= 1
    for shard, n in enumerate(taken):
        loads[shard] += n * size
    return taken


def quotas(histogram: DataFrame, shards: int) -> DataFrame:
    """(size, upto): for each group size the running number of its groups up to each shard."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * shards
        for frame in frames:
            upto = []
            for size, count in zip(frame["size"].tolist(), frame["count"].tolist(), strict=True):
                total, line = 0, []
                for n in deal(loads, size, count):
                    total += n
                    line.append(total)
                upto.append(line)
            yield pd.DataFrame({"size": frame["size"], "upto": upto})

    ordered = histogram.select("size", "count").repartition(1).sortWithinPartitions(F.desc("size"))
    return ordered.mapInPandas(scan, "size long, upto array<long>")


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """Shard of each group: ``groups`` has a string ``key`` and a positive long ``size``."""
    placed = groups.select("key", "size", place("group", F.col("key")).alias("at"), F.lit(1).alias("one"))
    per_size = quotas(placed.groupBy("size").agg(F.count("*").alias("count")), shards)
    ranked = running_totals(placed, ["size"], "at", ["key"], "one", "rank")
    sized = ranked.join(per_size.withColumnRenamed("size", "_size"), F.col("size") == F.col("_size"))
    return sized.select("key", F.size(F.filter("upto", lambda n: n <= F.col("rank"))).alias("shard"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def measures(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        text_key().alias("_key"), text_bytes(F.col("text")).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        F.col("doc_id").cast("long").alias("_doc"), place("slot", F.col("doc_id"), text_key()).alias("_at"), F.lit(1).alias("_one"),
    ]


def shard_documents(docs: DataFrame, shards: int = 16, whole: bool = True) -> DataFrame:
    """(_row, _key, _size, _crc, _doc, _shard, _slot) per document; ``_row`` holds the input row, if ``whole``.

    Documents of equal text stay together. The size of a document is its UTF-8 bytes plus 1; a null text counts as
    empty. ``_slot`` numbers the documents of a shard from 0 without gaps, in an order fixed by a hash of doc_id and text; equal
    rows are interchangeable. An empty table gives no rows.
    """
    sizes = staged(docs.select(*measures(docs)), "sizes")
    groups = staged(sizes.groupBy("_key").agg(F.sum("_size").alias("size")).withColumnRenamed("_key", "key"), "groups")
    chosen = staged(assign(groups, shards).select(F.col("key").alias("_text"), F.col("shard").alias("_shard")), "shards")
    same = F.col("_key") == F.col("_text")
    placed = sizes.join(chosen, same).drop("_text")
    bits = range_bits(sizes.count())
    offsets = range_offsets(placed, ["_shard"], "_at", "_one", bits)
    if whole:
        placed = docs.select(packed(docs).alias("_row"), *measures(docs)).join(chosen, same).drop("_text")
    return add_totals(placed, offsets, ["_shard"], "_at", ["_doc", "_key"], "_one", "_slot", bits).drop("_at", "_one")


def with_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; input columns of these names give way."""
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shard_documents(docs, shards).select(*kept, F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"))
