"""Concepts: groups of symbols that use each other, named by their distinctive words."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T

#: Passes of propagation, and how much a symbol's own label weighs.
PASSES, OWN = 12, 0.5


def propagate(links: dict, label: dict) -> dict:
    """Asynchronous label propagation in the order of ``label``; the smallest of the heaviest wins."""
    for _ in range(PASSES):
        moved = False
        for node in label:
            near = links.get(node)
            if not near:
                continue
            weight: dict = defaultdict(float)
            weight[label[node]] += OWN
            for other, n in near.items():
                weight[label[other]] += n
            top = max(weight.values())
            new = min(x for x, w in weight.items() if w == top)
            moved |= new != label[node]
            label[node] = new
        if not moved:
            break
    return label


def concept_labels(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, concept): exact mode, one repository in one task.

    ``symbols``: (repo, id, seq, dir). Propagation is sequential by definition; a
    repository's graph of symbols is the unit of work, repositories run in parallel.
    """
    inside = symbols.select("repo", "id")
    e = edges.where("src <> dst").join(inside.select("repo", F.col("id").alias("src")), "src").select("repo", "src", "dst")
    both = symbols.select("repo", "id", "seq", "dir", F.lit(None).cast("string").alias("dst")).unionByName(
        e.select("repo", F.col("src").alias("id"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("dir"), "dst")
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame[frame["dst"].isna()].sort_values("seq")
        seeds: dict = {}
        label = {i: seeds.setdefault(d, len(seeds)) for i, d in zip(nodes["id"], nodes["dir"], strict=True)}
        links: dict = defaultdict(lambda: defaultdict(int))
        for a, b in zip(*(frame[frame["dst"].notna()][c] for c in ("id", "dst")), strict=True):
            if a in label and b in label:
                links[a][b] += 1
                links[b][a] += 1
        done = propagate(links, label)
        return pd.DataFrame({"id": list(done), "concept": list(done.values())})

    return both.groupBy("repo").applyInPandas(run, "id string, concept int")


def scale_labels(symbols: DataFrame, edges: DataFrame, stage, passes: int = 5) -> DataFrame:
    """(id, concept): all symbols at once, every pass a join and a grouping.

    Synchronous updates from the last pass's labels; results may differ from the
    exact mode, sizes may not: nothing is gathered in one task.
    """
    seeds = symbols.groupBy("dir").agg(F.min("seq").alias("concept"))
    label = stage.cut(symbols.join(seeds, "dir").select("id", "concept"))
    both = edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    both = stage.cut(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))))
    for _ in range(passes):
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id", "concept").agg(F.count("*").cast("double").alias("w"))
        votes = near.unionByName(label.withColumn("w", F.lit(OWN))).groupBy("id", "concept").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.max_by("concept", F.struct("w", -F.col("concept"))).alias("concept"))
        new = stage.cut(best.join(label.select("id"), "id", "left_semi"))
        stage.drop(label)
        label = new
    return label


def describe(labels: DataFrame, symbols: DataFrame, edges: DataFrame, target: int = 30) -> DataFrame:
    """(concept, name, symbols, loc, coupling): the ``target`` largest by lines, the tail as one."""
    s = labels.join(symbols.select("id", "dir", "name", "loc"), "id")
    sizes = s.groupBy("concept").agg(F.count("*").alias("symbols"), F.sum("loc").cast("long").alias("loc"))
    order = F.row_number().over(Window.orderBy(F.desc("loc"), "concept"))  # one row a concept
    kept = sizes.withColumn("place", order).withColumn("to", F.when(F.col("place") < target, F.col("concept")).otherwise(-1))
    s = s.join(kept.select("concept", "to"), "concept").drop("concept").withColumnRenamed("to", "concept")
    words = s.select("concept", "loc", F.explode(F.array_distinct(T.split_identifier(F.col("name")))).alias("word")).where(F.length("word") >= 2)
    tf = words.groupBy("concept", "word").agg(F.sum(F.log2(F.col("loc") + 2)).alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    total = s.agg(F.countDistinct("concept").alias("n"))
    scored = tf.join(df, "word").crossJoin(total).withColumn("score", F.col("tf") * F.log(F.col("n") / F.col("df") + 1))  # one row
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("score"), "word"))).where("r <= 2")
    named = best.groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("words"))
    per = s.groupBy("concept", "dir").agg(F.count("*").alias("n")).groupBy("concept").agg(F.max_by("dir", F.struct("n", "dir")).alias("dir"), (F.max("n") / F.sum("n")).alias("share"))
    own = s.select("id", "concept")
    cross = edges.join(own.select(F.col("id").alias("src"), "concept"), "src").join(own.select(F.col("id").alias("dst"), F.col("concept").alias("to")), "dst").where("concept <> to")
    coupling = cross.groupBy("concept", "to").agg(F.count("*").alias("weight")).groupBy("concept").agg(F.sort_array(F.collect_list(F.struct("to", "weight"))).alias("coupling"))
    out = s.groupBy("concept").agg(F.count("*").alias("symbols"), F.sum("loc").cast("long").alias("loc"))
    name = F.when((F.col("share") >= 0.75) & (F.col("dir") != ""), F.col("dir")).otherwise(F.coalesce("words", F.lit("other")))
    return out.join(named, "concept", "left").join(per, "concept").join(coupling, "concept", "left").select("concept", name.alias("name"), "symbols", "loc", "coupling")

