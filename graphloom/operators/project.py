"""One scan of a project: graph, findings, suppressions, headline, worklist."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import compare, concepts, dead, dupes, ignores, settings
from graphloom.plans.staging import Stage
from graphloom.sources import code, stores
from graphloom.sources.coverage import read_coverage

#: Bumped when points of an earlier version no longer compare.
HISTORY_VERSION = 1


@dataclass
class Scan:
    graph: code.Graph
    findings: DataFrame
    directives: DataFrame
    stats: dict
    #: Whether an entry or public glob means a file; without one nothing is called dead.
    has_entry: bool = True


def findings_of(g: code.Graph, stage: Stage, config: stores.Config, files: DataFrame, coverage: DataFrame | None = None, data: DataFrame | None = None) -> DataFrame:
    """(id, kind, title, file, line, loc, score) of all analyses."""
    own = tuple(dead.Rule(r["name"], *(tuple(r.get(k, ())) for k in ("packages", "decorators", "names", "files", "symbols"))) for r in config.rules)
    rules = dead.active_rules(config.dependencies, own)
    entry = (*config.entry, *(g for r in rules for g in r.files))
    cols = ("id", "kind", "title", "file", "line", "loc", "score")
    gone = dead.findings(g, stage, files, entry, config.public, coverage, data, rules)
    dup = dupes.find_duplicates(g, stage, config.threshold, config.min_loc).join(g.symbols.select(F.col("id").alias("root"), "file", "line"), "root")
    dup = dup.select(F.concat(F.lit("duplicate:"), "root").alias("id"), F.lit("duplicate").alias("kind"), F.concat(F.col("members").cast("string"), F.lit(" versions of one thing")).alias("title"), "file", "line", F.col("removable").cast("int").alias("loc"), "score")
    con = settings.contradictions(g).select(
        F.concat_ws(":", F.lit("contradiction"), "rule", "key").alias("id"), F.lit("contradiction").alias("kind"), F.concat("key", F.lit(" has several values")).alias("title"),
        F.lit("").alias("file"), F.lit(0).alias("line"), F.col("n_sites").cast("int").alias("loc"), "score",
    )
    dri = settings.dialect_drift(g).where("rank > 1").select(
        F.concat_ws(":", F.lit("drift"), "category", "dialect").alias("id"), F.lit("drift").alias("kind"), F.concat_ws(" ", "category", F.lit("also by"), "dialect").alias("title"),
        F.lit("").alias("file"), F.lit(0).alias("line"), F.col("n").cast("int").alias("loc"), "score",
    )
    todo = settings.stubs(g).select(F.concat_ws(":", F.lit("unfinished"), "file", "name").alias("id"), F.lit("unfinished").alias("kind"), F.concat("name", F.lit(" is not implemented")).alias("title"), "file", "line", F.lit(1).alias("loc"), "score")
    never = settings.unset_state(g).select(F.concat_ws(":", F.lit("unfinished"), "file", "name").alias("id"), F.lit("unfinished").alias("kind"), F.concat("name", F.lit(" is never set")).alias("title"), "file", "line", F.lit(1).alias("loc"), "score")
    out = gone.select(*cols)
    for part in (dup, con, dri, todo, never):
        out = out.unionByName(part.select(*cols))
    return stage.cut(out)


def scan(spark: SparkSession, root: str, coverage: tuple[str, ...] = ()) -> Scan:
    """Everything about the project under ``root``."""
    stage, config = Stage(spark), stores.load_config(root)
    files = stage.cut(code.scan(spark, root, config.include, (*code.EXCLUDE, *config.exclude)))
    g = code.build(files, stage, stores.aliases(root))
    data = stage.cut(code.data_names(code.scan(spark, root, code.DATA, (*code.EXCLUDE, *config.exclude))))
    found = findings_of(g, stage, config, files, read_coverage(spark, root, coverage) if coverage else None, data)
    given = stage.cut(ignores.directives(files))
    left, given = ignores.apply(found, given)
    hidden = spark.createDataFrame([(x,) for x in sorted(stores.dismissed(root))], "id string")
    left = compare.undismissed(left, hidden)
    left = stage.cut(left)
    head = compare.headline(left).first().asDict()
    sizes = g.symbols.agg(F.countDistinct("file").alias("files"), F.count_if(F.col("kind") != "module").alias("symbols"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc")).first().asDict()
    rooted = dead.has_entry(files, (*config.entry, *(x for r in dead.active_rules(config.dependencies) for x in r.files)), config.public)
    return Scan(g, left, given, {**sizes, "edges": g.edges.count(), **head}, rooted)


def worklist(s: Scan, limit: int = 20) -> DataFrame:
    return compare.rank(s.findings, limit).join(s.findings.select("id", "title", "file", "line"), "id").orderBy(F.desc("weight"), "id")


def concept_table(s: Scan, target: int = 30) -> DataFrame:
    sym = s.graph.symbols.where("kind <> 'module'").select(F.lit("project").alias("repo"), "id", F.hash("file", "seq").cast("long").alias("seq"), F.regexp_replace("file", "/?[^/]*$", "").alias("dir"), "name", "loc")
    return concepts.describe(concepts.concept_labels(sym, s.graph.edges), sym, s.graph.edges, target)


def check_budget(s: Scan, root: str) -> list[dict]:
    """Metrics that grew over the stored budget, all if there is none to compare with."""
    was = stores.read_budget(root) or {}
    return [{"metric": m, "was": was.get(m, s.stats[m]), "now": s.stats[m], "failed": s.stats[m] > was.get(m, s.stats[m])} for m in compare.METRICS]


def git_commits(root: str) -> list[tuple[str, str]]:
    """(sha, ISO time) of a repository's commits, oldest first; empty outside one."""
    out = subprocess.run(["git", "-C", root, "log", "--reverse", "--format=%H %cI"], capture_output=True, text=True)
    return [tuple(line.split(" ", 1)) for line in out.stdout.splitlines()] if out.returncode == 0 else []


def trend(spark: SparkSession, root: str, points: int = 8) -> list[dict]:
    """Sampled history: scans of commits at even instants, kept by commit and version."""
    import os
    import tempfile

    commits = git_commits(root)
    if not commits:
        return []
    from datetime import datetime

    at = [datetime.fromisoformat(t).timestamp() for _, t in commits]
    grid = [at[0] + (at[-1] - at[0]) * i / max(1, points - 1) for i in range(points)]
    chosen = sorted({max((i for i in range(len(at)) if at[i] <= g + 1e-6), default=0) for g in grid})
    known = stores.history(root, HISTORY_VERSION)
    for i in chosen:
        sha, when = commits[i]
        if sha in known:
            continue
        with tempfile.TemporaryDirectory() as d:
            tree = os.path.join(d, "tree")
            if subprocess.run(["git", "-C", root, "worktree", "add", "--detach", tree, sha], capture_output=True).returncode:
                continue
            try:
                s = scan(spark, tree).stats
                dead_or_twice = s["dead_loc"] + s["duplicate_loc"]
                share = 100.0 if not s["loc"] else int((1 - dead_or_twice / s["loc"]) * 10000 + 0.5) / 100
                known[sha] = {"sha": sha, "version": HISTORY_VERSION, "at": when, "loc": int(s["loc"]), "load_bearing": share, **{m: s[m] for m in compare.METRICS}}
            finally:
                subprocess.run(["git", "-C", root, "worktree", "remove", "--force", tree], capture_output=True)
    stores.write_history(root, known)
    return sorted((known[commits[i][0]] for i in chosen if commits[i][0] in known), key=lambda x: x["at"])


BLOCKS = "▁▂▃▄▅▆▇█"


def sparkline(values: list[float]) -> str:
    if not values:
        return ""
    lo, hi = min(values), max(values)
    return "".join(BLOCKS[3] if hi == lo else BLOCKS[min(7, int((v - lo) / (hi - lo) * 8))] for v in values)


def page(s: Scan, out: dict) -> str:
    """One HTML page: the headline, the worklist, and files as boxes by their lines and findings."""
    from html import escape

    from graphloom.operators.treemap import squarify

    sized = s.graph.symbols.where("kind <> 'module' and container = ''").groupBy("file").agg(F.sum("loc").alias("loc"))
    heat = compare.file_weights(s.findings).select("file", "weight", "n")
    files = sized.join(heat, "file", "left").orderBy(F.desc("loc"), "file").limit(200).collect()  # what a page can show
    boxes = squarify([max(1, r.loc or 0) for r in files], 0, 0, 1000, 500)
    hottest = max((r.weight or 0.0 for r in files), default=0.0) or 1.0
    shapes = "".join(
        f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="hsl(10 70% {92 - 45 * (r.weight or 0) / hottest:.0f}%)" stroke="#fff"><title>{escape(r.file)}: {r.loc} lines, {r.n or 0} findings</title></rect>'
        for r, (x, y, w, h) in zip(files, boxes, strict=True)
    )
    head = " &middot; ".join(f"{escape(k.replace('_', ' '))} <b>{v}</b>" for k, v in out["stats"].items())
    rows = "".join("<tr>" + "".join(f"<td>{escape(str(r.get(c, '')))}" for c in ("severity", "weight", "kind", "title", "file", "line")) for r in out["rows"])
    data = json.dumps(out, default=str).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return (
        "<!doctype html><meta charset=utf-8><title>graphloom</title><style>body{font:14px sans-serif;margin:2em}td{padding:2px 10px 2px 0}</style>"
        f"<p>{head}</p><svg viewBox='0 0 1000 500'>{shapes}</svg><table>{rows}</table><script type=application/json id=data>{data}</script>"
    )
