"""Reachability and blast radius as loops of joins over staged frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.staging import Stage


#: Rows of a frontier that is sent to every task; a larger one is shuffled.
SENT = 200_000


def _next(frontier: DataFrame, size: int, links: DataFrame, at: str, to: str) -> DataFrame:
    """(id): what the links lead to from a frontier of known size."""
    ids = frontier.select(F.col("id").alias(at))
    return links.join(F.broadcast(ids) if size <= SENT else ids, at, "left_semi").select(F.col(to).alias("id")).distinct()


def reachable(edges: DataFrame, roots: DataFrame, stage: Stage, limit: int = 10_000) -> DataFrame:
    """(id) of everything reached from ``roots`` (id), themselves included.

    Each round takes the links of the last frontier only. What is reached is kept
    as a few tables: they become one whenever there are ``FOLD`` of them.
    """
    links = stage.cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    frontier = stage.cut(roots.select("id").where("id is not null").distinct())
    parts, size = [frontier], frontier.count()
    for _ in range(limit):
        seen = _together(parts)
        if not size:
            return seen
        frontier = stage.cut(_next(frontier, size, links, "src", "dst").join(seen, "id", "left_anti"))
        size = frontier.count()
        if len(parts) >= FOLD:
            whole = stage.cut(seen)
            for p in parts:
                stage.drop(p)
            parts = [whole]
        parts.append(frontier)
    raise RuntimeError(f"the walk did not end in {limit} rounds")


#: Tables of a walk's rounds that are read together.
FOLD = 8


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unreached(symbols: DataFrame, edges: DataFrame, roots: DataFrame, stage: Stage) -> DataFrame:
    """Rows of ``symbols`` (id, ...) that no path from ``roots`` reaches."""
    return symbols.join(reachable(edges, roots, stage), "id", "left_anti")


def blast_radius(edges: DataFrame, target: str, stage: Stage, depth: int = 2) -> DataFrame:
    """(id, hop): who depends on ``target``, by the fewest hops back, at most 5."""
    depth = max(1, min(5, depth))
    links = stage.cut(edges.select("src", "dst").distinct())
    seen = links.sparkSession.range(1).select(F.lit(target).alias("id"), F.lit(0).alias("hop"))
    frontier, size = seen, 1
    for hop in range(1, depth + 1):
        step = _next(frontier, size, links, "dst", "src")
        frontier = stage.cut(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        size = frontier.count()
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def orphan_files(symbols: DataFrame) -> DataFrame:
    """(file, n, loc) of files whose every symbol is unreached and none uncertain.

    ``symbols``: (file, loc, reached boolean, uncertain boolean); two symbols at least.
    """
    return (
        symbols.groupBy("file")
        .agg(F.count("*").alias("n"), F.sum("loc").cast("long").alias("loc"), F.bool_or("reached").alias("r"), F.bool_or("uncertain").alias("u"))
        .where("n >= 2 and not r and not u")
        .select("file", "n", "loc")
    )


def override_edges(hierarchy: DataFrame, members: DataFrame) -> DataFrame:
    """(base_member, derived_member): members of one name along ``hierarchy`` (base, derived)."""
    b = members.select(F.col("owner").alias("base"), F.col("name"), F.col("id").alias("base_member"))
    d = members.select(F.col("owner").alias("derived"), F.col("name"), F.col("id").alias("derived_member"))
    return hierarchy.join(b, "base").join(d, ["derived", "name"]).select("base_member", "derived_member")


def caller_counts(edges: DataFrame) -> DataFrame:
    """(id, callers, distinct_callers): edges into a symbol, and their sources."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.countDistinct("src").alias("distinct_callers"))


def file_links(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(from_file, to_file, links): distinct symbol pairs between two files. ``owner``: (id, file)."""
    a = owner.select(F.col("id").alias("src"), F.col("file").alias("from_file"))
    b = owner.select(F.col("id").alias("dst"), F.col("file").alias("to_file"))
    pairs = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("from_file <> to_file")
    return pairs.groupBy("from_file", "to_file").agg(F.count("*").alias("links"))


def name_edges(refs: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, src, dst, n): references (kind, src, name) that no type resolves reach every member (name, dst).

    References are counted before the join, so a hot name costs its distinct
    sources times its members, which is the size of the result.
    """
    return refs.groupBy("kind", "src", "name").agg(F.count("*").alias("n")).join(members, "name").select("kind", "src", "dst", "n")


def same_name(symbols: DataFrame) -> DataFrame:
    """(name, files, n): qualified names that several files declare."""
    full = F.when(F.col("container") == "", F.col("name")).otherwise(F.concat_ws(".", "container", "name"))
    named = symbols.where("kind <> 'module'").groupBy(full.alias("name")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))
    return named.where("files >= 2")
