"""Rebuild on change: a file stream triggers a full, single-flight rescan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.code import scan


def watch(spark: SparkSession, root: str, rebuild: Callable[[DataFrame], None], checkpoint: str, seconds: float = 1.0, once: bool = False):
    """Start a query that calls ``rebuild`` with all files whenever new ones are seen.

    Batches run one at a time and each reads the folder as it is then, so late
    or repeated notices of a file change nothing.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).option("wholetext", True).text(root)

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            rebuild(scan(spark, root))

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
