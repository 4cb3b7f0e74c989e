"""Range joins on lines, as-of joins on time, and roll-ups over paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def innermost(ranges: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, seq): the innermost range (file, seq, line, end_line) around each site (file, line, site).

    The range that starts last wins, then the first in order. Ranges are blocked
    by stretches of lines, so a file with many of them is no single hot key.
    """
    width = 16
    blocks = ranges.select("file", "seq", F.col("line").alias("from"), "end_line", F.explode(F.sequence(F.floor(F.col("line") / width), F.floor(F.col("end_line") / width))).alias("block"))
    at = sites.select("file", "site", F.col("line").alias("at"), F.floor(F.col("line") / width).alias("block"))
    hit = at.join(blocks, ["file", "block"]).where("at >= from and at <= end_line")
    return hit.groupBy("site").agg(F.max_by("seq", F.struct(F.col("from"), -F.col("seq"))).alias("seq"))


def _blocks(first: str, last: str, width: int):
    """The stretches that a range touches, one row each."""
    return F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width)))


#: Lines, and characters, of a stretch: what a file's ranges are dealt by, so that no file is one hot key.
LINES, CHARACTERS = 64, 4096


def executed(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Ranges (file, line, end_line, ...) with an executed line (file, line)."""
    seen = lines.select("file", F.col("line").alias("at"), F.floor(F.col("line") / LINES).alias("block")).distinct()
    dealt = ranges.select("file", "line", "end_line").distinct().withColumn("block", _blocks("line", "end_line", LINES))
    hit = dealt.join(seen, ["file", "block"]).where("at >= line and at <= end_line").select("file", "line", "end_line").distinct()
    return ranges.join(hit, ["file", "line", "end_line"], "left_semi").select(*ranges.columns)


def paint(lines: DataFrame, painters: DataFrame) -> DataFrame:
    """(file, line, executed): the narrowest painter over a line decides, the later of equals.

    ``lines``: (file, line, line_start, line_stop); ``painters``: (file, start, stop,
    hit boolean, seq). A painter that did not run applies only to lines wholly inside it.
    """
    on = lines.withColumn("block", _blocks("line_start", "line_stop", CHARACTERS))
    by = painters.withColumn("block", _blocks("start", "stop", CHARACTERS))
    hit = on.join(by, ["file", "block"]).where("start <= line_stop and stop >= line_start").where("hit or (start <= line_start and stop >= line_stop)")
    width = F.col("stop") - F.col("start")
    return hit.groupBy("file", "line").agg(F.max_by("hit", F.struct(-width, F.col("seq"))).alias("executed"))


def asof(grid: DataFrame, commits: DataFrame) -> DataFrame:
    """(sha, stamp, instant): the last commit at or before each instant; one row per commit, its first instant.

    One sort by time of both tables together; nothing is joined.
    """
    both = grid.select(F.col("instant").alias("t"), F.lit(1).alias("o"), F.col("instant"), F.lit(None).cast("long").alias("sha"), F.lit(None).cast(commits.schema["stamp"].dataType).alias("stamp")).unionByName(
        commits.select(F.col("stamp").alias("t"), F.lit(0).alias("o"), F.lit(None).cast(commits.schema["stamp"].dataType).alias("instant"), "sha", "stamp")
    )
    day = F.to_date("t")
    # last commit of each day, then of the days before: no window over the whole table but that of days
    last = commits.groupBy(F.to_date("stamp").alias("d")).agg(F.max(F.struct("stamp", "sha")).alias("x"))
    days = both.where("o = 1").select(day.alias("d")).distinct().join(last, "d", "full").groupBy("d").agg(F.max("x").alias("x"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.max("x").over(before)).select("d", "before")
    within = Window.partitionBy("d").orderBy("t", "o", "sha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("d", day).withColumn("x", F.max(F.when(F.col("o") == 0, F.struct("stamp", "sha"))).over(within))
    found = seen.where("o = 1").join(days, "d", "left").select("instant", F.coalesce("x", "before").alias("x")).where("x is not null")
    return found.groupBy(F.col("x.sha").alias("sha"), F.col("x.stamp").alias("stamp")).agg(F.min("instant").alias("instant"))


def roll_up(files: DataFrame) -> DataFrame:
    """(folder, files, value, heat): sums over all ancestor folders; heat is weighted by value.

    ``files``: (path, value, heat).
    """
    parts = F.split("path", "/")
    anc = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = files.select(F.explode(F.filter(anc, lambda a: a.isNotNull())).alias("folder"), "value", "heat")
    return up.groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("value").cast("long").alias("value"), (F.floor(F.sum(F.col("heat") * F.col("value")) / F.sum("value") * 100 + 0.5) / 100).alias("heat")
    )
