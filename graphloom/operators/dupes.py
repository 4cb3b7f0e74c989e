"""Duplicate code: two-stage similarity of real functions, clusters and their scores."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import similar
from graphloom.operators.components import connected_components

#: Floors of structure and vocabulary, the default threshold and least lines.
STRUCTURE, VOCABULARY, THRESHOLD, MIN_LOC = 0.85, 0.45, 0.72, 4

TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.go$|Tests?\.swift$"
SIDE_PATH = r"(?i)(^|/)(bench|benchmark|benchmarks|perf|perf-measures|examples?|fixtures?|__fixtures__|demo|playground)/"
SPECIAL = r"^(constructor|init|__.*__|main)$"
STUB = r"(?i)not[\s_-]*implemented|unimplemented"


def candidates(symbols: DataFrame, min_loc: int = MIN_LOC, include_tests: bool = False) -> DataFrame:
    """Functions and methods with a body that says something."""
    bare = F.length(F.regexp_replace("body", r"[\s{}();]", ""))
    keep = F.col("kind").isin("function", "method") & (F.col("loc") >= min_loc) & ~F.col("name").rlike(SPECIAL) & (bare >= 24) & ~F.col("body").rlike(STUB)
    if not include_tests:
        keep = keep & ~F.col("file").rlike(TEST_PATH)
    return symbols.where(keep).where(F.trim("body") != "...")


def structure_bag(c: DataFrame) -> DataFrame:
    """(id, term, w): counts of four-grams of token classes."""
    return c.select("id", F.explode(T.shingles(T.structure(F.col("body")), 4)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("w"))


def vocabulary_bag(c: DataFrame) -> DataFrame:
    """(id, term, w): words of the name three times, of identifiers and strings in the body once."""
    named = c.select("id", F.explode(T.split_identifier(F.col("name"))).alias("term"), F.lit(3).alias("w"))
    said = c.select("id", F.explode(T.tokens(F.col("body"))).alias("token")).where(F.col("token").rlike("^['\"A-Za-z_$]") & ~F.col("token").isin(*T.KEYWORDS))
    body = said.select("id", F.explode(T.split_identifier(F.col("token"))).alias("term"), F.lit(1).alias("w"))
    return named.unionByName(body).where((F.length("term") >= 2) & ~F.col("term").isin(*T.STOP)).groupBy("id", "term").agg(F.sum("w").alias("w"))


def similarities(shape: DataFrame, vocab: DataFrame, near: DataFrame, stage) -> DataFrame:
    """(a, b, score) of pairs: structure first, vocabulary of what is left, their mean."""
    built = stage.cut(similar.cosine(shape, near, STRUCTURE).withColumnRenamed("score", "structure"))
    said = similar.cosine(vocab, built.select("a", "b"), VOCABULARY).withColumnRenamed("score", "vocabulary")
    return built.join(said, ["a", "b"]).select("a", "b", ((F.col("structure") + F.col("vocabulary")) / 2).alias("score"))


def calibrated(c: DataFrame, shape: DataFrame, vocab: DataFrame, stage, threshold: float) -> float:
    """The threshold, raised over what unrelated pairs of this code have; see ``similar.calibrated_threshold``.

    ``c`` has ``place``, the candidates' order from 0. Pairs are drawn by place, so
    400 rows are all that comes to the driver; under 30 candidates nothing is drawn.
    """
    n = c.count()
    if n < 30:
        return threshold
    drawn = similar.random_pairs(n)
    rows = c.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(drawn)], "draw int, pa long, pb long")
    at = c.select("id", F.col("place").cast("long").alias("place"))
    rows = rows.join(at.select(F.col("place").alias("pa"), F.col("id").alias("a")), "pa").join(at.select(F.col("place").alias("pb"), F.col("id").alias("b")), "pb")
    near = stage.cut(rows.select("draw", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    got = near.join(similarities(shape, vocab, near.select("a", "b").distinct(), stage), ["a", "b"], "left")
    return similar.calibrated_threshold([r.score for r in got.select(F.coalesce("score", F.lit(0.0)).alias("score")).collect()], threshold)


def body_overlap(shape: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b, overlap): the share of the smaller body's token shingles that the other has."""
    sizes = shape.groupBy("id").agg(F.count("*").alias("n"))
    x, y = shape.select(F.col("id").alias("a"), "term"), shape.select(F.col("id").alias("b"), "term")
    both = near.select("a", "b").join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("shared") / F.least("na", "nb")).alias("overlap"))


def pairs(c: DataFrame, stage, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score, overlap) of pairs over the threshold, which the code itself may raise."""
    vocab, shape = stage.cut(vocabulary_bag(c)), stage.cut(structure_bag(c))
    near = similar.candidate_pairs(c, vocab, similar.DF_CAP)
    at = c.select("id", "file", "line", "end_line")
    a, b = at.select(*[F.col(x).alias(f"{x}_a") for x in at.columns]), at.select(*[F.col(x).alias(f"{x}_b") for x in at.columns])
    nested = (F.col("file_a") == F.col("file_b")) & (
        (F.col("line_a") <= F.col("line_b")) & (F.col("end_line_b") <= F.col("end_line_a")) | (F.col("line_b") <= F.col("line_a")) & (F.col("end_line_a") <= F.col("end_line_b"))
    )
    near = near.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b")).where(~nested).select("a", "b")
    least = calibrated(c, shape, vocab, stage, threshold) if "place" in c.columns else threshold
    scored = stage.cut(similarities(shape, vocab, near, stage).where(F.col("score") >= least))
    return scored.join(body_overlap(shape, scored), ["a", "b"], "left").select("a", "b", "score", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


#: Tokens of a run, and the runs that make a block worth extracting.
BLOCK_TOKENS, BLOCK_RUNS = 12, 15
BLOCK_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d+|\"[^\"]*\"|'[^']*'|\S")


def shares_block(bodies: list[str]) -> bool:
    """Whether every body repeats runs of tokens of another, names included."""
    runs = []
    for body in bodies:
        tokens = BLOCK_TOKEN.findall(body)
        runs.append({tuple(tokens[i : i + BLOCK_TOKENS]) for i in range(len(tokens) - BLOCK_TOKENS + 1)})
    return all(any(i != j and len(mine & theirs) >= BLOCK_RUNS for j, theirs in enumerate(runs)) for i, mine in enumerate(runs))


def naming_family(names: list[str], words: list[list[str]]) -> bool:
    """Whether two names of the set are variants by design: one word apart, or one the beginning of the other."""
    for (n, a), (m, b) in combinations(zip(names, words, strict=True), 2):
        if n != m and a and b:
            short, long = sorted((a, b), key=len)
            if len(long) <= 2 and (a[0] == b[0] or a[-1] == b[-1]) or long[: len(short)] == short:
                return True
        common, sizes = len(set(a) & set(b)), sorted((len(set(a)), len(set(b))))
        if sizes[0] and common >= 2 and common >= 0.5 * sizes[0] and common < sizes[1]:
            return True
    return False


def acknowledged(members: list[dict]) -> bool:
    """Whether the comment over a member names another one and says that the difference is meant."""
    others = lambda m: {x["name"] for x in members} - {m["name"]}
    return any(m["note"] and any(re.search(rf"\b{re.escape(o)}\b", m["note"]) for o in others(m)) for m in members)


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n)), strict=False))


def judge(members: list[dict], similarity: float, overlap: float, surfaces: bool = False) -> tuple[float, list[str]]:
    """(score, reasons) of one cluster; members carry name, file, container, body, callees, connected, note."""
    n, score, why = len(members), similarity, []
    names, files = [m["name"] for m in members], [m["file"] for m in members]

    def less(by: float, reason: str) -> None:
        nonlocal score
        score -= by
        why.append(reason)

    often = Counter(names).most_common(1)[0][1]
    dirs = Counter(f.rpartition("/")[0] for f in set(files)).most_common(1)[0][1]
    containers = {m["container"] for m in members}
    parallel = surfaces or len(set(names)) == 1 and all(m["container"] for m in members) or n >= 3 and (
        often >= 3 and len(containers - {""}) >= 3 or len(set(files)) >= 0.7 * n and (often >= 3 or dirs >= 4)
    )
    callees = [set(m["callees"]) - set(names) for m in members]
    common = set.intersection(*callees) if callees else set()
    delegating = all(len(m["body"]) <= 240 for m in members) and all(callees) and bool(common)
    family = naming_family(names, [m["words"] for m in members])
    literal = [set(m["literals"]) for m in members]
    skeleton = [set(_grams(m["shape"], 2)) for m in members]
    jac = lambda x, y: len(x & y) / max(1, len(x | y))
    data = all(len(x) >= 3 for x in literal) and all(jac(x, y) < 0.5 for x, y in combinations(literal, 2)) and all(jac(x, y) >= 0.85 for x, y in combinations(skeleton, 2))
    told, alone = acknowledged(members), len(set(files)) == 1
    shape_only = alone and not shares_block([m["body"] for m in members])
    if parallel:
        less(0.6, "a parallel set")
    if delegating:
        less(0.5, "members only delegate")
    if not common and all(callees):
        less(0.3, "no shared work")
    if all(m["side"] for m in members):
        less(0.3, "outside production code")
    if n > 4:
        less(min(0.5, 0.08 * (n - 4)), "many members")
    if alone:
        less(0.15, "one file")
    if any(m["connected"] for m in members):
        less(0.4, "members call each other")
    if family:
        less(0.45, "a naming family")
    if data:
        less(0.5, "different data")
    if shape_only:
        less(0.3, "one shape, no shared block")
    if told:
        less(0.4, "the difference is explained")
    if n > 2:
        score += 0.05
    if overlap >= 0.9 and not shape_only and not (family or parallel or delegating or data or told):
        score = max(score, similarity - 0.2)
    return int(min(1.0, max(0.05, score)) * 100 + 0.5) / 100, why


def _judge_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            members = json.loads(r.members)
            score, why = judge(members, r.similarity, r.overlap, bool(r.surfaces))
            out.append((r.root, len(members), score, ", ".join(why), r.removable if score >= 0.5 else 0))
        yield pd.DataFrame(out, columns=["root", "members", "score", "why", "removable"])


def find_duplicates(g, stage, threshold: float = THRESHOLD, min_loc: int = MIN_LOC, include_tests: bool = False) -> DataFrame:
    """(root, members, score, why, removable) clusters of re-implemented functions."""
    c = candidates(g.symbols, min_loc, include_tests)
    # any total order of the pairs will do; places are counted by file, then within it
    per = c.groupBy("file").agg(F.count("*").alias("n"))
    before = per.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # one row a file
    inside = F.row_number().over(Window.partitionBy("file").orderBy("seq", "id")) - 1
    c = c.withColumn("inside", inside).join(before, "file").withColumn("place", F.col("before") + F.col("inside")).drop("before", "inside")
    c = stage.cut(c.withColumn("seq", F.col("place")))
    p = stage.cut(pairs(c, stage, threshold))
    roots = connected_components(p.select("a", "b"), stage)
    called = g.symbols.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    callees = g.edges.join(called, "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("callee").alias("callees"))
    tied = p.join(g.edges.select("src", "dst").distinct(), (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")) | (F.col("a") == F.col("dst")) & (F.col("b") == F.col("src")))
    tied = tied.select(F.explode(F.array("a", "b")).alias("node"), F.lit(True).alias("tied")).distinct()
    literal = lambda t: F.array_distinct(F.filter(t, lambda x: x.rlike("^['\"0-9]")))
    notes = g.facts.where("tab = 'note'").select("file", F.col("a").alias("name"), F.col("b").alias("container"), F.col("c").alias("note")).groupBy("file", "name", "container").agg(F.min("note").alias("note"))
    one = c.join(callees, "id", "left").join(notes, ["file", "name", "container"], "left").join(tied, c["id"] == tied["node"], "left").select(
        F.col("id").alias("node"), "loc",
        F.struct(
            "name", "file", "container", "body", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"), F.coalesce("tied", F.lit(False)).alias("connected"),
            T.split_identifier(F.col("name")).alias("words"), literal(T.tokens(F.col("body"))).alias("literals"), T.structure(F.col("body")).alias("shape"),
            F.col("file").rlike(SIDE_PATH).alias("side"), F.coalesce("note", F.lit("")).alias("note"),
        ).alias("m"),
    )
    # directories that mirror each other are one design, whatever members they have
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    mirrored = similar.parallel_groups(g.symbols.where("kind <> 'module'").select(folder.alias("grp"), "name")).select(F.col("a").alias("da"), F.col("b").alias("db"))
    spread = roots.join(c.select(F.col("id").alias("node"), folder.alias("dir")), "node").select("root", "dir").distinct()
    both = spread.select("root", F.col("dir").alias("da")).join(mirrored, "da").join(spread.select("root", F.col("dir").alias("db")), ["root", "db"])
    both = both.select("root", F.lit(True).alias("surfaces")).distinct()
    groups = roots.join(one, "node").groupBy("root").agg(F.to_json(F.collect_list("m")).alias("members"), (F.sum("loc") - F.min("loc")).cast("long").alias("removable"))
    scores = p.join(roots, p["a"] == roots["node"]).groupBy("root").agg(F.avg("score").alias("similarity"), F.avg("overlap").alias("overlap"))
    whole = groups.join(scores, "root").join(both, "root", "left").withColumn("surfaces", F.coalesce("surfaces", F.lit(False)))
    return whole.mapInPandas(_judge_frames, "root string, members long, score double, why string, removable long")
