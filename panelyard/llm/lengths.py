"""Token counts: an exact histogram of encoded lengths answers every question about a context limit.

Documents are encoded whole, aggregated by source and length, and the histogram gets suffix sums. From a row of the
result follow, for a context limit of that length: the documents and tokens in all, those at least that long, the
tokens that remain when longer documents are truncated, and the share of documents up to the length (its quantile).
``totals_at`` and ``quantiles`` read limits and ranks off that lie between two lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.session import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern that belongs to this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a file of base64 tokens and ranks; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) per document, over whole texts; a null text has no tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes)], ["doc_id", "source", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(count, "doc_id long, source string, tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(source, tokens, docs): documents of each length; a null source is a source."""
    return lengths.groupBy("source", "tokens").agg(F.count("*").alias("docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Add to (source, tokens, docs) what holds for a context limit of ``tokens``.

    docs_from and tokens_from: documents at least that long and their tokens; docs_all and tokens_all: the source's;
    docs_cut: longer documents; tokens_kept: tokens left when those are truncated; share_upto: share of documents up to
    the length. Lengths are summed in blocks first, so a window holds one block of lengths, or the blocks of a source.
    """
    blocked = counts.withColumn("_block", F.floor(F.col("tokens") / BLOCK)).withColumn("_tokens", F.col("tokens") * F.col("docs"))
    blocks = blocked.groupBy("source", "_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.partitionBy("source").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    sums = blocks.select(
        F.col("source").alias("_source"), F.col("_block").alias("_b"),
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("_d", "_t")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("_d", "_t")],
    )
    joined = blocked.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_b")))
    inside = Window.partitionBy("source", "_block").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, 0)
    docs_from, tokens_from = F.col("_d_later") + F.sum("docs").over(inside), F.col("_t_later") + F.sum("_tokens").over(inside)
    out = joined.select(
        "source", "tokens", "docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), F.col("_d_all").alias("docs_all"), F.col("_t_all").alias("tokens_all")
    )
    longer = F.col("docs_from") - F.col("docs")
    return out.withColumns(
        {
            "docs_cut": longer,
            "tokens_kept": F.col("tokens_all") - F.col("tokens_from") + F.col("tokens") * F.col("docs_from"),
            "share_upto": (F.col("docs_all") - longer) / F.col("docs_all"),
        }
    )


def length_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The histogram with its suffix sums, per source. An empty table gives no rows."""
    # stored, because the sums read it twice and encoding is the work
    return with_suffix_sums(staged(histogram(encoded_lengths(docs, vocabulary)), "lengths"))


def totals_at(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(source, limit, docs_all, tokens_all, docs_cut, tokens_kept) for any context limits, exact between lengths too.

    The shortest length above a limit carries what is needed: the documents from there on are cut to the limit.
    """
    asked = table.withColumn("limit", F.explode(F.array(*[F.lit(n).cast("long") for n in limits])))
    above = F.when(F.col("tokens") > F.col("limit"), F.struct("tokens", "docs_from", "tokens_from"))
    found = asked.groupBy("source", "limit").agg(F.max("docs_all").alias("docs_all"), F.max("tokens_all").alias("tokens_all"), F.min(above).alias("a"))
    cut = F.coalesce(F.col("a.docs_from"), F.lit(0))
    kept = F.col("tokens_all") - F.coalesce(F.col("a.tokens_from"), F.lit(0)) + F.col("limit") * cut
    return found.select("source", "limit", "docs_all", "tokens_all", cut.alias("docs_cut"), kept.alias("tokens_kept"))


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(source, share, tokens): the smallest length up to which at least that share of a source's documents lies."""
    asked = table.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    reached = F.when(F.col("share_upto") >= F.col("share"), F.col("tokens"))
    return asked.groupBy("source", "share").agg(F.min(reached).alias("tokens"))
