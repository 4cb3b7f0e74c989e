"""Ignore directives in comments: parsed relationally, applied as anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("dead", "orphan-file", "duplicate", "drift", "contradiction", "unfinished")
PATTERN = r"graphloom-ignore\s+([a-z,\s-]*?)(?:\s*:\s*(.*))?$"


def directives(files: DataFrame) -> DataFrame:
    """(file, line, target, kinds, reason, malformed) of (file, content).

    A directive after code covers its own line, else the next line that is
    neither blank nor a comment nor a decorator, and the decorators before it.
    """
    lines = files.where(F.contains("content", F.lit("graphloom-ignore"))).select("file", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    plain = ~F.trim("text").rlike(r"^(?://|#|/?\*|@)") & (F.trim("text") != "")
    # from the last line up, as a frame that only grows is not read anew for each line
    after = Window.partitionBy("file").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("next", F.min(F.when(plain, F.col("at"))).over(after))
    body = F.trim(F.regexp_replace("text", r"\*/\s*$", ""))
    hit = lines.where(F.contains("text", F.lit("graphloom-ignore"))).withColumn("body", body)
    kinds = F.filter(F.split(F.regexp_extract("body", PATTERN, 1), r"[,\s]+"), lambda k: k != "")
    reason = F.trim(F.regexp_extract("body", PATTERN, 2))
    code_before = ~F.trim("text").rlike(r"^(?://|#|/?\*|<!--|\{/\*)")
    bad = (F.size(kinds) == 0) | (reason == "") | F.exists(kinds, lambda k: ~k.isin(*KINDS))
    return hit.select("file", (F.col("at") + 1).alias("line"), (F.when(code_before, F.col("at")).otherwise(F.col("next")) + 1).alias("target"), kinds.alias("kinds"), reason.alias("reason"), bad.alias("malformed"))


def apply(findings: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings left, directives with ``used``): findings (file, line, kind, ...) on a covered line go."""
    good = given.where(~F.col("malformed")).select("file", F.col("target").alias("line"), F.explode("kinds").alias("kind")).distinct()
    left = findings.join(good, ["file", "line", "kind"], "left_anti")
    seen = findings.select(F.col("file").alias("f"), F.col("line").alias("l"), F.col("kind").alias("k")).distinct()
    used = given.join(seen, (F.col("file") == F.col("f")) & (F.col("target") == F.col("l")) & F.array_contains("kinds", F.col("k")), "left_semi").select("file", "line", F.lit(True).alias("used")).distinct()
    return left, given.join(used, ["file", "line"], "left").withColumn("used", F.coalesce("used", F.lit(False)) & ~F.col("malformed"))
