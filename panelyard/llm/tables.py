"""Shared helpers: whole-row packing, running totals inside hot groups, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.session import drop_staged, staged

PLACE_DIGITS = 15
PLACE_BITS = 4 * PLACE_DIGITS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that columns of any name survive an operator's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_key(text: Column | str = "text") -> Column:
    """A 128-bit key of the text; a null counts as empty."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def place(seed: str, *parts: Column) -> Column:
    """A fixed pseudo-random integer below 2^60 from the given values; DuckDB computes the same one."""
    joined = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, PLACE_DIGITS), 16, 10).cast("long")


def smallest(rows: DataFrame, have: int, count: int, at: str, *ties: str) -> DataFrame:
    """The ``count`` of ``have`` rows with the smallest ``at``, a uniform integer in [0, 2^60).

    A bound on ``at`` leaves a few more than ``count`` rows, so that ranking moves no more than these whatever the size
    of the table or of its tasks. Where rows share one ``at`` it may leave fewer.
    """
    if have > count:
        wanted = count + 6 * count**0.5 + 16
        rows = rows.where(F.col(at) < int(min(1.0, wanted / have) * 2**PLACE_BITS))
    return rows.orderBy(at, *ties).limit(count)


def range_bits(rows: int, rows_per_range: int = 4_096) -> int:
    """How many leading bits of a place make ranges of about ``rows_per_range`` rows."""
    return max(0, min(32, (max(rows, 1) // rows_per_range).bit_length()))


def with_range(df: DataFrame, at: str, bits: int) -> DataFrame:
    return df.withColumn("_range", F.shiftright(F.col(at), PLACE_BITS - bits))


def range_offsets(df: DataFrame, keys: Sequence[str], at: str, value: str, bits: int) -> DataFrame:
    """Per group and range of places the sum of ``value`` in all earlier ranges of the group, as (_k0.., _r, _offset)."""
    totals = with_range(df, at, bits).groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    return offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_offset")


def add_totals(
    df: DataFrame, offsets: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], value: str, out: str, bits: int
) -> DataFrame:
    """Sum of ``value`` over the rows of a group before each row: its range's offset and a window inside the range."""
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = with_range(df, at, bits).join(offsets, same).drop("_r", *[f"_k{i}" for i in range(len(keys))])
    inside = Window.partitionBy(*keys, "_range").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(out, before).drop("_offset", "_range")


def running_totals(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of a group before each row, in the order (``at``, ``order``).

    ``at`` is uniform in [0, 2^60), so equal ranges of it hold equal shares of any group. The number of ranges grows
    with the rows of the table; a window only ever holds one range of one group, and the totals of the ranges carry
    what came before. So a group with a third of all rows is spread over as many tasks as any other rows. ``df`` is
    read three times: stage it first.
    """
    bits = range_bits(df.count())
    return add_totals(df, range_offsets(df, keys, at, value, bits), keys, at, order, value, out, bits)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected graph given as pairs (a, b); the root is the smallest node.

    Alternating large-star and small-star steps. Each step attaches to every edge the smallest neighbour of its end,
    by an aggregate and a join, so no neighbour list is ever gathered and a hot centre is a skewed join at worst. The
    pairs are rewritten to the shared folder after every round; the loop ends when a round changes nothing.
    """
    now = staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = fingerprint(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("c")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        moved = large.join(least, F.col("a") == F.col("c")).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(moved.union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct())
        drop_staged(now)
        now, previous = after, mark
        mark = fingerprint(now)
        if mark == previous:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def fingerprint(pairs: DataFrame) -> tuple:
    """Number of distinct pairs and an order-free checksum of them."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
