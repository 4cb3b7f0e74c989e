"""``python -m graphloom.cli VERB [ROOT] [ARGS]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

VERBS = ("scan", "dead", "duplicates", "drift", "contradictions", "unfinished", "concepts", "why", "blast", "find", "like", "uses", "gaps", "ignores", "check", "budget", "dismiss", "intent", "trend", "report", "tools")


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="graphloom", description="Analyses of a code base as tables.")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("rest", nargs="*")
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--coverage", action="append", default=[])
    a = p.parse_args(args)
    from graphloom.operators import graph, lookup, project
    from graphloom.plans.ship import ship
    from graphloom.plans.staging import Stage
    from graphloom.sources import stores

    if a.verb == "dismiss":
        stores.dismiss(a.root, a.rest[0], " ".join(a.rest[1:]))
        return 0
    if a.verb == "intent" and len(a.rest) > 1:
        stores.set_intent(a.root, a.rest[0], " ".join(a.rest[1:]))
        return 0
    if a.verb == "intent":
        print(json.dumps(list(stores.intents(a.root).values()), indent=2))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("graphloom").getOrCreate()
    ship(spark)
    if a.verb == "trend":
        points = project.trend(spark, a.root)
        print(json.dumps(points, indent=2) if a.json else f"load-bearing {project.sparkline([x['load_bearing'] for x in points])}")
        return 0
    if a.verb == "tools":
        from graphloom.tools import Tools, serve

        serve(Tools(spark, a.root), sys.stdin, sys.stdout)
        return 0
    s = project.scan(spark, a.root, tuple(a.coverage))
    if a.verb == "check":
        rows = project.check_budget(s, a.root)
        print(json.dumps(rows, indent=2) if a.json else "\n".join(f"{'FAIL' if r['failed'] else 'ok  '} {r['metric']}: {r['was']} -> {r['now']}" for r in rows))
        return int(any(r["failed"] for r in rows))
    if a.verb == "budget":
        stores.write_budget(a.root, {k: int(v) for k, v in s.stats.items()})
        return 0
    if a.verb == "concepts":
        rows = [r.asDict(recursive=True) for r in project.concept_table(s).orderBy(F.desc("loc")).collect()]
    elif a.verb in ("why", "blast", "find"):
        name = a.rest[0] if a.rest else ""
        hit = lookup.find_symbol(s.graph.symbols, name).join(s.graph.symbols.select("id", "file", "line"), "id").orderBy("how", "id").collect()
        rows = [{"id": h.id, "file": h.file, "line": h.line} for h in hit]
        if a.verb != "find" and (not hit or hit[0].how == 2):  # only names that hold it: suggestions
            rows = [{"suggestion": r["id"]} for r in rows]
        elif a.verb == "blast":
            rows = [r.asDict() for r in graph.blast_radius(s.graph.edges, hit[0].id, Stage(spark), 2).orderBy("hop", "id").limit(a.limit).collect()]
        elif a.verb == "why":
            near = lookup.why(s.graph.symbols, s.graph.edges, hit[0].id).orderBy("relation", "id").limit(3 * a.limit).collect()
            said = lambda *kinds: [r.id for r in near if r.relation in kinds][: a.limit]
            rows = [{**rows[0], "callers": said("caller", "importer"), "importedBy": said("importer"), "reaches": said("reaches"), "intent": stores.intents(a.root).get(hit[0].id)}]
    elif a.verb == "like":
        needs = spark.createDataFrame([(0, " ".join(a.rest))], "need int, text string")
        own = s.graph.symbols.where(F.col("kind").isin("function", "method", "class"))
        rows = [r.asDict() for r in lookup.similar_code(own, needs, a.limit, identifiers=True).orderBy("place").collect()]
    elif a.verb in ("uses", "gaps"):
        sym = s.graph.symbols.where("kind <> 'module'")
        told = spark.createDataFrame([(x,) for x in stores.intents(a.root)], "symbol string")
        top = lookup.load_bearing(sym, s.graph.edges, a.limit) if a.verb == "uses" else lookup.intent_gaps(sym, s.graph.edges, told, a.limit)
        rows = [r.asDict() for r in top.collect()]
    elif a.verb == "ignores":
        rows = [r.asDict() for r in s.directives.orderBy("file", "line").collect()]
    else:
        kinds = {"dead": "dead", "duplicates": "duplicate", "drift": "drift", "contradictions": "contradiction", "unfinished": "unfinished"}
        if a.verb in kinds:
            s.findings = lookup.list_findings(s.findings, (kinds[a.verb], "orphan-file") if a.verb == "dead" else (kinds[a.verb],))
        rows = [r.asDict() for r in project.worklist(s, a.limit).collect()]
    out = {"stats": {k: int(v) for k, v in s.stats.items()}, "rows": rows}
    if a.verb == "report":
        print(project.page(s, out))
    elif a.json or a.verb in ("why", "blast", "concepts", "find", "like", "uses", "gaps", "ignores"):
        print(json.dumps(out if a.verb == "scan" else rows, indent=2, default=str))
    else:
        st = out["stats"]
        if not s.has_entry:
            print("No entry or public file was found, so nothing is called dead; name some in graphloom.json.")
        print(f"{st['files']} files, {st['symbols']} symbols, {st['loc']} lines; dead {st['dead_loc']}, duplicate {st['duplicate_loc']}, drift {st['drift_count']}, contradictions {st['contradiction_count']}, unfinished {st['unfinished_count']}")
        print("\n".join(f"{r['severity']:6} {r['weight']:7.3f} {r['kind']:13} {r['title']} ({r['file']}:{r['line']})" for r in rows) or "Nothing to do.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
