"""Small helpers around a SparkSession that every part of the library shares."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; any store that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_workers_import(spark: SparkSession) -> None:
    """Put this package on the Python workers' path, for sessions started from another folder.

    A cluster gets the package by ``--py-files`` or its image; there this adds a path that
    isn't looked at first and does no harm.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (have, ROOT) if p)


#: Rows of a batch that goes to a Python worker, where rows hold whole texts.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batches_of_texts(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in a batch than Spark's ten thousand: of texts, that many take tens of megabytes on each side of every worker.

    Only the default is changed; a session that sets a size of its own keeps it.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without one gets a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tallyline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths given out within each open temporary_tables().
_held: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; no two calls get the same one."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if _held:
        _held[-1].append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Whatever is written to new paths within it is deleted at its end, when nothing may read it any more."""
    _held.append([])
    try:
        yield
    finally:
        for path in _held.pop():
            deleted(spark, path)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    Any executor can read the files, so losing one loses nothing.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**({"compression": compression} if compression else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own switch: a query's shuffle files are deleted at its end, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs within it go when the query ends; for tables that are written, whose plans nothing runs again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settled(spark: SparkSession, made: Callable[[], DataFrame], name: str) -> DataFrame:
    """What made() gives, written densely; the tables that it wrote on the way and its shuffle files are gone then."""
    path = scratch(spark, name)
    with shuffles_deleted(spark), temporary_tables(spark):
        df = made()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tables/" in path:
                deleted(spark, path)
