"""Staged tables: lineage is cut by writing Parquet to the folder all executors share.

A written table survives the loss of any executor, is computed once, and is
compressed. The folder is the one the cluster names in ``spark.checkpoint.dir``;
only a local session without that setting gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return _LOCAL[0]


#: A plan that ends in more tasks than this a core, and than there are pieces of
#: this size in its inputs, is written in fewer: a file costs a store several
#: calls, and a local one several processes.
FILES_PER_CORE, FILE_BYTES = 2, 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of the tables that a plan reads, as Spark estimates it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def few_files(df: DataFrame) -> DataFrame:
    """``df`` without the many small tasks that small inputs make of a large setting; no shuffle.

    A task then runs the partitions it stands for one after the other, so it
    needs no more memory than one of them.
    """
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(min(max(FILES_PER_CORE * cores, -(-input_bytes(df) // FILE_BYTES)), (1 << 31) - 1))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting that holds inside, and is put back after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Stage:
    """Writes intermediate tables and forgets those no later step reads.

    The shuffle files of a cut go when it is written, so a query of several cuts
    holds those of one cut at a time.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a scan of what was written."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            few_files(df).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that nothing reads any more."""
        path = getattr(df, "_staged", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows for the plans that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield
