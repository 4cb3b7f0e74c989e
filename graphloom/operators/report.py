"""What a report shows of a project: lines with their findings, snippets, as much source as fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines_of(files: DataFrame) -> DataFrame:
    """(file, line, text) of (file, content), lines counted from 1."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def line_marks(findings: DataFrame) -> DataFrame:
    """(file, line, marks): the findings (file, line, kind, loc) that cover each line, by kind."""
    covered = findings.select("file", "kind", F.explode(F.sequence("line", F.col("line") + F.greatest("loc", F.lit(1)) - 1)).alias("line"))
    return covered.groupBy("file", "line").agg(F.array_sort(F.collect_set("kind")).alias("marks"))


def snippets(files: DataFrame, spans: DataFrame, context: int = 0) -> DataFrame:
    """(id, first, text) of spans (id, file, line, end_line): their lines, with some before and after."""
    split = files.select("file", F.split("content", "\n").alias("rows"))
    first = F.greatest(F.col("line") - context, F.lit(1))
    size = F.greatest(F.least(F.col("end_line") + context, F.size("rows")) - first + 1, F.lit(0))
    return spans.join(split, "file").select("id", first.alias("first"), F.array_join(F.slice("rows", first, size), "\n").alias("text"))


def within_budget(sources: DataFrame, budget: int, by: str = "grp") -> DataFrame:
    """The rows (``by``, place, bytes, ...) of each group that fit a byte budget together, in order of place.

    A row that does not fit is left out, as is all that comes after it.
    """
    order = Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sources.withColumn("used", F.sum("bytes").over(order)).where(F.col("used") <= budget)


def signature(source):
    """The head of a declaration: its text up to the body, blanks folded."""
    return F.trim(F.regexp_replace(F.regexp_extract(source, r"(?s)^(.*?)\s*(?:\{|=>|:\s*\n|\z)", 1), r"\s+", " "))
