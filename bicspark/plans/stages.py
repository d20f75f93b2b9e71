"""Stage tables: parquet under the session's shared checkpoint folder.

An iterative job cuts its lineage by writing each step as a table and reading it
back. A written table survives the loss of any executor, is computed once, and has
a file size that lets the optimizer choose a broadcast by a checked size.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_TASK = 2_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the session's warehouse.

    Both are shared by the driver and all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers on machines that hold this code import it.

    On a cluster whose executors don't, pass the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


#: Whether Spark removes the shuffle files of a job when it ends; otherwise they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each job run inside as soon as it ends, as what it wrote is read again, not they."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_made: ContextVar[list[Stages] | None] = ContextVar("made", default=None)


@contextmanager
def dropped_after() -> Iterator[None]:
    """Remove all stage tables made inside at the end, when their result is written elsewhere."""
    made: list[Stages] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for stages in made:
            stages.drop()


class Stages:
    """Tables of one job run, each written once under a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        made = _made.get()
        if made is not None:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        with shuffle_files_dropped(self.spark):
            df.write.mode("error").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def new_table(self, df: DataFrame, name: str) -> DataFrame:
        """As :meth:`table`, under a name that is not taken."""
        return self.table(df, f"{name}-{uuid.uuid4().hex}")

    def observed_table(self, df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
        """As :meth:`table`, with aggregates over the written records.

        They are observed while writing, so they cost no job of their own.
        """
        seen = Observation()
        written = self.table(df.observe(seen, *[v.alias(k) for k, v in values.items()]), name)
        return written, seen.get

    def counted_table(self, df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
        """As :meth:`table`, with the number of records that meet a condition."""
        written, seen = self.observed_table(df, name, n=F.count_if(condition))
        return written, seen["n"]

    def drop(self, *names: str) -> None:
        """Remove tables that no result reads any more; without a name, the whole folder."""
        for path in [self.path(n) for n in names] or [self.folder]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()

    def tasks(self, n_records: int) -> int:
        """The number of tasks to spread so many records over."""
        slots = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(slots, -(-n_records // RECORDS_PER_TASK)))

    def spread(self, table: DataFrame, n_records: int, *keys: str) -> DataFrame:
        """Redistribute a table that has few splits for its number of records.

        A small table is read by few tasks, however much work each record makes. A
        table with enough splits stays as it is.
        """
        tasks = self.tasks(n_records)
        if tasks == 1 or table.rdd.getNumPartitions() >= tasks:
            return table
        return table.repartition(tasks, *keys)

    def spread_by(self, df: DataFrame, key: str, within: str, size: str, n_records: int) -> DataFrame:
        """Bring records of one ``key`` together, but a large key over several tasks.

        ``size`` is a column with the number of records of the key, and is dropped. A
        key above a fair share is cut by a hash of ``within``.
        """
        tasks = self.tasks(n_records)
        if tasks == 1:
            return df.drop(size)
        share = max(RECORDS_PER_TASK, n_records // tasks)
        piece = F.pmod(F.xxhash64(within), F.floor(F.col(size) / share) + 1)
        return df.withColumn("piece", piece).repartition(tasks, key, "piece").drop("piece", size)

    def cut_up(self, df: DataFrame, within: str, size: str, n_records: int, largest: int) -> DataFrame:
        """Give the records of large keys a ``piece`` from 1, by a hash of ``within``, and others piece 0.

        ``size`` is a column with the number of records of the key, and is dropped. A key
        with a fair share of a task is cut; if ``largest`` is below that, no piece is added.
        """
        tasks = self.tasks(n_records)
        share = max(RECORDS_PER_TASK, n_records // tasks)
        if tasks == 1 or largest < share:
            return df.drop(size)
        piece = F.pmod(F.xxhash64(within), F.floor(F.col(size) / share) + 1) + 1
        return df.withColumn("piece", F.when(F.col(size) >= share, piece).otherwise(0)).drop(size)
