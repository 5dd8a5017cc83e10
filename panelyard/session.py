"""Session settings and the shared folder for derived tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
Made = TypeVar("Made")


def build_session(app: str = "panelyard", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a single-process master may fall back to a temporary folder: on a cluster a machine-local path would vanish
    with its executor. The folder goes when the application's JVM ends.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FALLBACK:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="panelyard-")
        folder = f"{named.rstrip('/')}/panelyard-{app}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FALLBACK[app] = folder
    return _FALLBACK[app]


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and continue from the table.

    For a derived panel that several aggregates read: each of them then scans only its own columns, Catalyst
    knows the true size, and a lost executor costs a re-read instead of a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(builds: Sequence[Callable[[], Made]]) -> list[Made]:
    """The results of a few builds that run their own jobs, so the jobs of one fill the cores that another leaves idle."""
    with ThreadPoolExecutor(max(len(builds), 1)) as pool:
        return [made.result() for made in [pool.submit(inheritable_thread_target(build)) for build in builds]]


def drop_staged(df: DataFrame) -> None:
    """Delete the table behind a frame that ``staged`` returned, once no later plan reads it."""
    context = df.sparkSession.sparkContext
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
