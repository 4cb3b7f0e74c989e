"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Add a zip of this package to the context, once; new executors fetch it too."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='graphloom-ship-')}/graphloom_package", "zip", root, "graphloom")
    sc.addPyFile(made)
    _SHIPPED[sc.applicationId] = made


def shipped(query):
    """A query that ships the package before it plans."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
