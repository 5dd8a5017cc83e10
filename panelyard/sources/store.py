"""A stored table of latest rows per key, and the ledger of what has been fetched into it.

The store is a folder: ``rows`` holds one parquet partition per hash bucket of the key, ``ledger`` one per batch. A batch
rewrites only the buckets its keys fall in, by a dynamic partition overwrite; its ledger partition is written last and
marks it as done. So a batch that is replayed, whole or after a crash between the two writes, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators.scale import measured
from panelyard.session import drop_staged, staged
from panelyard.sources.exports import fetch_ledger, upsert_events
from panelyard.sources.sinks import folder_of


LEDGER = "kind string, province string, date date, n long"


@dataclass(frozen=True)
class EventStore:
    """``keys`` name a row, the largest ``version`` of it stays; ``buckets``: partitions of the rows."""

    folder: str
    keys: tuple[str, ...]
    version: str
    buckets: int = 32

    def exists(self, spark: SparkSession, part: str) -> bool:
        path, system = folder_of(spark, f"{self.folder.rstrip('/')}/{part}")
        return system.exists(path)

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """The latest row of every key, or None while nothing is stored."""
        if not self.exists(spark, "rows"):
            return None
        return spark.read.parquet(f"{self.folder}/rows").drop("_bucket")

    def done(self, spark: SparkSession, batch: int) -> bool:
        return self.exists(spark, f"ledger/batch-{batch}/_SUCCESS")

    def upsert(self, incoming: DataFrame, batch: int, fetched: DataFrame | None = None) -> None:
        """Store a batch; ``fetched`` lists (kind, province, date) that it covers, days without rows among them.

        Usable as ``writeStream.foreachBatch(store.sink(...))``.
        """
        spark = incoming.sparkSession
        if self.done(spark, batch):
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = staged(incoming.withColumn("_bucket", bucket))
        touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]
        if touched:
            before = fresh.limit(0)
            if self.exists(spark, "rows"):
                before = spark.read.parquet(f"{self.folder}/rows").where(F.col("_bucket").isin(touched))
            merged = upsert_events(before, fresh, self.keys, self.version)
            # the rows are read from the folder that they replace, so they are written elsewhere first
            beside = staged(merged)
            writer = beside.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("_bucket").parquet(f"{self.folder}/rows")
            drop_staged(beside)
        self.record(incoming, batch, fetched)
        drop_staged(fresh)

    def record(self, incoming: DataFrame, batch: int, fetched: DataFrame | None) -> None:
        """Write the batch's ledger: every fetched day with its number of rows, zero included."""
        place = ["kind", "province", "date"]
        if fetched is None:
            lines = incoming.sparkSession.createDataFrame([], LEDGER)
        elif set(place) <= set(incoming.columns):
            counts = incoming.groupBy(*place).agg(F.count("*").alias("n"))
            lines = fetched.select(*place).distinct().join(counts, place, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        else:
            lines = fetched.select(*place).distinct().withColumn("n", F.lit(None).cast("long"))
        lines.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch-{batch}")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """(kind, province, date, n) of everything fetched so far."""
        if not self.exists(spark, "ledger"):
            return spark.createDataFrame([], LEDGER)
        path, system = folder_of(spark, f"{self.folder.rstrip('/')}/ledger")
        parts = [str(s.getPath()) for s in system.listStatus(path) if s.isDirectory()]
        return spark.read.schema(LEDGER).parquet(*parts) if parts else spark.createDataFrame([], LEDGER)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The wanted (kind, province, date) that no batch has fetched, with or without rows."""
        return fetch_ledger(wanted, measured(self.ledger(wanted.sparkSession)).select("kind", "province", "date").distinct())

    def sink(self, days: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``; ``days`` derives what a batch covers from its rows."""
        return lambda rows, batch: self.upsert(rows, batch, days(rows) if days else None)

