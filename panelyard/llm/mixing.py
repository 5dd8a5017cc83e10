"""Mixing sources to target weights by random order and distributed prefix sums.

Documents get a hash-random place, ranges of places are summed per source, and the running word count of a document
inside its source decides how often it is taken: a source whose target is e times its words and a rest takes every
document e times, and once more those whose running count lies below the rest. Reruns agree, because a place depends
on the document alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.tables import add_totals, packed, place, range_bits, range_offsets, text_key
from panelyard.session import staged

WORD = r"[^\x20\x09-\x0D]+"
SHARE = 1.5
CAP = 2.0
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources by code point, null last, take the weights in turn. The targets share ``share`` of all words by weight;
    none exceeds ``cap`` times its source. Resharing an excess until none is left ends where every open source gets
    the same words per weight, so it is solved at once: with sources ordered by cap per weight, a prefix of them is at
    the cap. The windows run over sources, not documents: one task holds a row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))).cast("int") + 1))
    weighed = weighed.withColumn("_cap", F.lit(cap) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(until), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(until), F.lit(0.0))
    )
    levels = weighed.withColumn("_level", level)
    # the first source in that order which stays below its cap sets the level for all that follow
    open_level = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source", "_level"))).over(everything)
    target = F.when(open_level.isNull(), F.col("_cap")).otherwise(F.least("_cap", open_level["_level"] * F.col("_w")))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def measures() -> list[Column]:
    return [
        F.col("doc_id").cast("long").alias("_doc"), F.col("source").alias("_source"), words(F.col("text")).alias("_size"),
        place("mix", F.col("doc_id"), text_key()).alias("_at"),
    ]


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, cut_documents: bool = True, whole: bool = True
) -> DataFrame:
    """(_row, _doc, _source, _size, _source_size, _target, _times, _part) per document; ``_row`` holds the input row, if ``whole``.

    A document is taken ``_times`` times as a whole and then once more for its first ``_part`` words: the one at the
    cut of its source fills the budget exactly. Without ``cut_documents`` it is taken once more as a whole if at least
    half of it fits, and ``_part`` is 0. A null text has no words and is never taken. Repeated rows and null ids are
    documents of their own; an empty table gives no rows. The place of a document comes from its id and its text, so many
    texts under one id, or without one, are spread like others.
    """
    sizes = staged(docs.select(*measures()), "sizes")
    targets = staged(source_targets(sizes.select(F.col("_source").alias("source"), F.col("_size").alias("size")), weights, share, cap), "targets")
    targets = targets.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    bits = range_bits(sizes.count())
    offsets = range_offsets(sizes, ["_source"], "_at", "_size", bits)
    rows = docs.select(packed(docs).alias("_row"), *measures()) if whole else sizes
    running = add_totals(rows, offsets, ["_source"], "_at", ["_doc", "_size"], "_size", "_before", bits)
    joined = running.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_at")
    budget = F.floor("_target")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("_source_size")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_before"))).cast("long")
    again = part == F.col("_size") if cut_documents else part * 2 >= F.col("_size")
    times = F.when(F.col("_size") > 0, epochs + again.cast("long")).otherwise(F.lit(0).cast("long"))
    left = F.when(again, F.lit(0).cast("long")).otherwise(part) if cut_documents else F.lit(0).cast("long")
    return joined.withColumn("_times", times).withColumn("_part", left).drop("_before")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of the mix with all columns of ``docs``: each document as often as it is taken as a whole."""
    plan = mix(docs, weights, share, cap, cut_documents=False).where(F.col("_times") > 0)
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")
