"""Queries that run the scan of code itself, on source files laid over the tables, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import compare, concepts, dead, dupes, graph, ignores, lookup, report, settings
from graphloom.plans.registry import SEVERITY_SQL, WEIGHT_SQL, query
from graphloom.plans.staging import Stage
from graphloom.sources import code, coverage, written
from graphloom.sources import tables as S
from graphloom.sources.tables import FINDINGS_SQL
from graphloom.sources.written import GO_SQL, PYTHON_SQL, SWIFT_SQL, TYPESCRIPT_SQL


def _built(spark: SparkSession, files: DataFrame) -> tuple[code.Graph, DataFrame, Stage]:
    stage = Stage(spark)
    files = stage.cut(files)
    return code.build(files, stage), files, stage


def _symbols(g: code.Graph) -> DataFrame:
    return g.symbols.where("kind <> 'module'").select("id", "kind", F.col("line").cast("long").alias("line"), F.col("loc").cast("long").alias("loc"), "exported")


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT id, kind, line, loc, exported FROM symbols")
def code_ts_symbols(spark, sf):
    """Declarations of TypeScript files: ids, kinds, places, sizes, exports."""
    return _symbols(_built(spark, written.typescript(spark, sf))[0])


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT src, dst, kind FROM edges")
def code_ts_edges(spark, sf):
    """Calls resolved to declarations over relative imports, and the imports themselves."""
    return _built(spark, written.typescript(spark, sf))[0].edges.select("src", "dst", "kind").distinct()


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT id, kind, loc, score FROM dead")
def code_dead(spark, sf):
    """Unreached symbols of the scanned files and how sure that is."""
    g, _, stage = _built(spark, written.typescript(spark, sf))
    return dead.find_dead(g, stage, entry=(written.ENTRY,), rules=()).select("id", "kind", F.col("loc").cast("long").alias("loc"), "score")


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL} SELECT 'dead:' || id AS id, 'dead' AS kind, name || ' is never reached' AS title, file, loc, score FROM dead WHERE file NOT IN (SELECT file FROM orphans)
UNION ALL SELECT 'orphan-file:' || file, 'orphan-file', 'Nothing in ' || file || ' is reachable', file,
  3 + (SELECT count(DISTINCT dst) FROM calls WHERE calls.file = o.file AND dst <> calls.file) + (SELECT sum(loc + 1 + note) FROM sized WHERE sized.file = o.file), 0.9::DOUBLE FROM orphans o"""
)
def code_dead_findings(spark, sf):
    """Findings of dead code: whole files where nothing is reached, else single symbols."""
    g, files, stage = _built(spark, written.typescript(spark, sf))
    found = dead.findings(g, stage, files, entry=(written.ENTRY,), rules=())
    return found.select("id", "kind", "title", "file", F.col("loc").cast("long").alias("loc"), "score")


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, ran AS (SELECT DISTINCT id FROM symbols s JOIN events e ON s.line <= e.event_id AND e.event_id < s.line + s.loc AND s.file = 'src/n' || e.user_id % 25 || '/building.ts'
), again(id) AS (SELECT id FROM reach UNION SELECT id FROM ran UNION SELECT dst FROM edges JOIN again ON src = again.id)
SELECT id, CASE WHEN file IN (SELECT 'src/n' || user_id % 25 || '/building.ts' FROM events) THEN 0.97 ELSE floor((0.95 - CASE WHEN exported THEN 0.25 ELSE 0 END - CASE WHEN loc <= 2 THEN 0.1 ELSE 0 END) * 100 + 0.5) / 100 END AS score
FROM symbols WHERE id NOT IN (SELECT id FROM again)"""
)
def code_dead_covered(spark, sf):
    """The same with a coverage report: what ran is alive, what was watched and never ran is dead."""
    g, _, stage = _built(spark, written.typescript(spark, sf))
    lines = spark.read.parquet(f"{sf}/events.parquet").select(F.format_string("src/n%d/building.ts", F.col("user_id") % 25).alias("file"), F.col("event_id").cast("int").alias("line")).distinct()
    return dead.find_dead(g, stage, entry=(written.ENTRY,), coverage=lines, rules=()).select("id", "score")


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT split_part(src, '#', 1) AS from_file, split_part(dst, '#', 1) AS to_file, count(*) AS links FROM (SELECT DISTINCT src, dst FROM edges) WHERE split_part(src, '#', 1) <> split_part(dst, '#', 1) GROUP BY 1, 2")
def code_file_links(spark, sf):
    """How strongly files depend on each other."""
    g, _, _ = _built(spark, written.typescript(spark, sf))
    return graph.file_links(g.edges, g.symbols.select("id", "file"))


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, env AS (SELECT DISTINCT file, upper(seg) || '_URL' AS key, 'h' || n % 4 AS value FROM c
), const AS (SELECT DISTINCT file, CASE seg WHEN 'building' THEN 'build' ELSE seg END || '-timeout' AS key, (n * 10)::VARCHAR AS value FROM c
), clock AS (SELECT count(*) FILTER (k % 2 = 0) AS a, count(*) FILTER (k % 2 = 1) AS b FROM c WHERE seg = 'automobile' AND NOT stub)
SELECT 'env-default' AS rule, key, count(DISTINCT value) AS n_values, count(*) AS n_sites, arg_min(value, file) AS first_value, 0.9::DOUBLE AS score FROM env GROUP BY key HAVING count(DISTINCT value) >= 2
UNION ALL SELECT 'constant', key, count(DISTINCT value), count(*), arg_min(value, file), 0.6::DOUBLE FROM const GROUP BY key HAVING count(DISTINCT value) >= 2 AND count(DISTINCT file) >= 2
UNION ALL SELECT 'time-semantics', 'utc/local', 2, a + b, '', 0.55::DOUBLE FROM clock WHERE least(a, b) >= 2 AND least(a, b) >= 0.15 * (a + b)"""
)
def code_contradictions(spark, sf):
    """One setting, several values: defaults of variables, declared numbers, UTC against local time."""
    return settings.contradictions(_built(spark, written.typescript(spark, sf))[0])


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, uses AS (
  SELECT 'errors' AS category, 'throw Error' AS dialect, 6 AS least FROM c WHERE stub
  UNION ALL SELECT 'logging', CASE seg WHEN 'building' THEN 'console' ELSE 'logger object' END, 5 FROM c WHERE seg IN ('building', 'machinery') AND NOT stub
  UNION ALL SELECT 'validation', CASE seg WHEN 'furniture' THEN 'schema library' ELSE 'manual typeof guard' END, 4 FROM c WHERE seg IN ('furniture', 'household') AND NOT stub
  UNION ALL SELECT 'exports', 'named export', 8 FROM symbols WHERE exported
), n AS (SELECT category, dialect, count(*) AS n, any_value(least) AS least FROM uses GROUP BY 1, 2
), r AS (SELECT *, n / sum(n) OVER w AS share, sum(n) OVER w AS total, count(*) OVER w AS dialects, row_number() OVER (PARTITION BY category ORDER BY n DESC, dialect) AS rank FROM n WINDOW w AS (PARTITION BY category))
SELECT category, dialect, n, floor(share * 100 + 0.5) / 100 AS share, rank, CASE WHEN max(share) OVER (PARTITION BY category) >= 0.8 THEN 0.8::DOUBLE ELSE 0.5 END AS score
FROM r WHERE total >= least AND dialects >= 2 AND (share >= 0.02 OR n >= 3)"""
)
def code_drift(spark, sf):
    """Conventions with rivals, over the texts of the scanned symbols."""
    return settings.dialect_drift(_built(spark, written.typescript(spark, sf))[0])


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT file, line, 'cust' || k AS name, 0.9::DOUBLE AS score FROM placed WHERE stub")
def code_stubs(spark, sf):
    """Functions that only say they are not implemented."""
    return settings.stubs(_built(spark, written.typescript(spark, sf))[0]).select("file", F.col("line").cast("long").alias("line"), "name", "score")


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL} SELECT file, (line - 1)::BIGINT AS line, line::BIGINT AS target, CASE WHEN k % 3 = 0 THEN 'planned work' ELSE '' END AS reason, k % 3 = 1 AS malformed,
  k % 3 = 0 AS used FROM placed WHERE note = 1"""
)
def code_directives(spark, sf):
    """Ignore directives in comments, what they cover, and whether they hide a finding."""
    g, files, _ = _built(spark, written.typescript(spark, sf))
    found = settings.stubs(g).select("file", "line", F.lit("unfinished").alias("kind"))
    _, given = ignores.apply(found, ignores.directives(files))
    return given.select("file", F.col("line").cast("long").alias("line"), F.col("target").cast("long").alias("target"), "reason", "malformed", "used")


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT file, line, 'cust' || k AS name FROM placed WHERE stub AND k % 3 <> 0")
def code_stubs_left(spark, sf):
    """Stubs that no well-formed directive hides."""
    g, files, _ = _built(spark, written.typescript(spark, sf))
    found = settings.stubs(g).select("file", "line", "name", F.lit("unfinished").alias("kind"))
    left, _ = ignores.apply(found, ignores.directives(files))
    return left.select("file", F.col("line").cast("long").alias("line"), "name")


@query(f"WITH RECURSIVE {PYTHON_SQL} SELECT id, kind, line, loc, exported FROM symbols")
def code_py_symbols(spark, sf):
    """Declarations of Python files."""
    return _symbols(_built(spark, written.python(spark, sf))[0])


@query(f"WITH RECURSIVE {PYTHON_SQL} SELECT src, dst, kind FROM edges")
def code_py_edges(spark, sf):
    """Python calls over relative imports, imports, and the package's own start."""
    return _built(spark, written.python(spark, sf))[0].edges.select("src", "dst", "kind").distinct()


@query(f"WITH RECURSIVE {PYTHON_SQL} SELECT id FROM symbols WHERE id NOT IN (SELECT id FROM reach)")
def code_py_dead(spark, sf):
    """Python functions that the script does not reach."""
    g, _, stage = _built(spark, written.python(spark, sf))
    return dead.find_dead(g, stage, rules=()).select("id")


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, said AS (SELECT p_type AS word, 'data/b' || p_brand || '.json' AS file FROM part UNION ALL SELECT p_name, 'data/b' || p_brand || '.json' FROM part
), cut AS (SELECT file, unnest(regexp_extract_all(word, '[A-Za-z_$][A-Za-z0-9_$]{{3,}}')) AS name FROM said)
SELECT name, min(file) AS file FROM cut WHERE regexp_matches(substr(name, 2), '[A-Z_]') GROUP BY name"""
)
def code_data_names(spark, sf):
    """Names in data files that code may be called by, and the first file of each."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    files = part.groupBy(F.concat(F.lit("data/b"), "p_brand", F.lit(".json")).alias("file")).agg(F.to_json(F.collect_list(F.struct(F.col("p_type").alias("a"), F.col("p_name").alias("b")))).alias("content"))
    small = files.withColumn("content", F.explode(F.from_json("content", "array<struct<a:string,b:string>>"))).select("file", F.concat_ws(" ", "content.a", "content.b").alias("content"))
    return code.data_names(small)




@query(f"WITH {GO_SQL} SELECT id, kind, line, loc, exported FROM symbols")
def code_go_symbols(spark, sf):
    """Declarations of Go files; a capital letter exports."""
    return _symbols(_built(spark, written.go(spark, sf))[0])


@query(f"WITH {GO_SQL} SELECT src, dst FROM edges")
def code_go_edges(spark, sf):
    """Go calls, to the files of the same package too."""
    return _built(spark, written.go(spark, sf))[0].edges.where("kind = 'references'").select("src", "dst").distinct()


@query(f"WITH {GO_SQL} SELECT split_part(id, '#', 1) AS file, line, split_part(id, '#', 2) AS name FROM symbols WHERE bal < -900")
def code_go_stubs(spark, sf):
    """Go functions that panic for want of a body."""
    return settings.stubs(_built(spark, written.go(spark, sf))[0]).select("file", F.col("line").cast("long").alias("line"), "name")


@query(f"WITH {SWIFT_SQL} SELECT id, kind, line, loc, exported FROM symbols")
def code_swift_symbols(spark, sf):
    """Classes and methods of Swift files."""
    return _symbols(_built(spark, written.swift(spark, sf))[0])


@query(f"WITH {SWIFT_SQL} SELECT src, dst FROM calls")
def code_swift_edges(spark, sf):
    """Swift calls, which one namespace resolves by name."""
    return _built(spark, written.swift(spark, sf))[0].edges.where("kind = 'references'").select("src", "dst").distinct()


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT id FROM sized WHERE NOT stub")
def code_candidates(spark, sf):
    """Functions that are compared for duplicates: real ones, with a body that says something."""
    return dupes.candidates(_built(spark, written.typescript(spark, sf))[0].symbols).select("id")


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, n AS (SELECT dst AS id, count(*) AS callers FROM edges GROUP BY dst)
SELECT id, callers, floor(callers * log2(loc + 2) * 100 + 0.5) / 100 AS weight FROM n JOIN symbols USING (id)
WHERE loc >= 4 AND id NOT IN (SELECT file || '#cust' || k FROM c WHERE k % 5 = 0) ORDER BY weight DESC, id LIMIT 20"""
)
def code_intent_gaps(spark, sf):
    """Much-used functions whose purpose is not written down (a top-20 report)."""
    g, _, _ = _built(spark, written.typescript(spark, sf))
    told = g.symbols.where(F.regexp_extract("name", "^cust([0-9]+)$", 1).try_cast("long") % 5 == 0).select(F.col("id").alias("symbol"))
    return lookup.intent_gaps(g.symbols.where("kind <> 'module'"), g.edges.select("src", "dst", "kind").distinct(), told)


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, t AS (SELECT file || '#cust2' AS id FROM c WHERE k = 2)
SELECT CASE kind WHEN 'imports' THEN 'importer' ELSE 'caller' END AS relation, src AS id FROM edges WHERE dst IN (SELECT id FROM t)
UNION SELECT 'reaches', dst FROM edges WHERE src IN (SELECT id FROM t)"""
)
def code_why(spark, sf):
    """Why a function is alive: its callers, importers, and what it reaches."""
    g, _, _ = _built(spark, written.typescript(spark, sf))
    target = lookup.find_symbol(g.symbols, "cust2", 1).first()
    return lookup.why(g.symbols, g.edges, target.id if target else "")


@query(
    """WITH e AS (SELECT 'src/f' || user_id % 50 || '.ts' AS file, event_id, (event_id * 7) % 400 + 1 AS a, event_id % 3 AS more, event_type FROM events)
SELECT DISTINCT file, (a + i)::INT AS line FROM e, range(0, 3) r(i) WHERE event_type <> 'click' AND i <= more AND event_id % 2 = 1
UNION SELECT 'src/p' || user_id % 50 || '.py', (event_id % 300)::INT FROM events WHERE event_type = 'click'"""
)
def coverage_reports(spark, sf):
    """Lines that Istanbul and coverage.py reports saw run, read on executors."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("a", ((F.col("event_id") * 7) % 400 + 1).cast("int")).withColumn("b", (F.col("a") + F.col("event_id") % 3).cast("int"))
    at = F.struct(F.struct(F.col("a").alias("line")).alias("start"), F.struct(F.col("b").alias("line")).alias("end"))
    k = F.col("event_id").cast("string")
    one = e.where("event_type <> 'click'").groupBy("event_type", (F.col("user_id") % 50).alias("f")).agg(F.map_from_entries(F.collect_list(F.struct(k, at))).alias("statementMap"), F.map_from_entries(F.collect_list(F.struct(k, (F.col("event_id") % 2).cast("int")))).alias("s"))
    path = F.format_string("/work/src/f%d.ts", "f")
    ist = one.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(path, F.struct(path.alias("path"), "statementMap", "s"))))).alias("content"))
    ran = e.where("event_type = 'click'").groupBy((F.col("user_id") % 50).alias("f")).agg(F.collect_list((F.col("event_id") % 300).cast("int")).alias("executed_lines"))
    py = ran.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.format_string("src/p%d.py", "f"), F.struct("executed_lines")))).alias("files"))).alias("content"))
    return coverage.report_lines(ist.select("content").unionByName(py), "/work/")


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, s AS (SELECT n AS concept, file || '#cust' || k AS id, 'src/' || CASE WHEN seg < 'c' THEN 'a' ELSE 'b' END AS dir, bal FROM c
), sizes AS (SELECT concept, count(*) AS symbols, count(*) * 10 AS loc, row_number() OVER (ORDER BY count(*) DESC, concept) AS place FROM s GROUP BY 1
), own AS (SELECT s.id, s.dir, CASE WHEN place < 10 THEN s.concept ELSE -1 END AS concept FROM s JOIN sizes USING (concept)
), cross_ AS (SELECT a.concept, b.concept AS dst, count(*) AS weight FROM edges e JOIN own a ON a.id = src JOIN own b ON b.id = dst WHERE a.concept <> b.concept GROUP BY 1, 2)
SELECT concept, count(*) AS symbols, count(*) * 10 AS loc, coalesce((SELECT sum(weight) FROM cross_ x WHERE x.concept = own.concept), 0)::BIGINT AS coupled,
  coalesce((SELECT count(*) FROM cross_ x WHERE x.concept = own.concept), 0) AS partners FROM own GROUP BY concept"""
)
def code_concepts(spark, sf):
    """Concepts of symbols: the largest, the tail as one, and how much each uses the others."""
    g, _, _ = _built(spark, written.typescript(spark, sf))
    sym = g.symbols.where("kind = 'function'").select("id", F.when(F.regexp_extract("file", "([a-z]+)[.]ts$", 1) < "c", "src/a").otherwise("src/b").alias("dir"), "name", F.lit(10).alias("loc"), "file")
    labels = sym.select("id", F.regexp_extract("file", "^src/n([0-9]+)/", 1).cast("int").alias("concept"))
    out = concepts.describe(labels, sym, g.edges.select("src", "dst"), 10)
    return out.select("concept", "symbols", "loc", F.coalesce(F.aggregate("coupling", F.lit(0).cast("long"), lambda a, x: a + x["weight"]), F.lit(0)).alias("coupled"), F.coalesce(F.size("coupling"), F.lit(0)).cast("long").alias("partners"))


@query(
    f"""WITH {FINDINGS_SQL}, each AS (SELECT file, floor({WEIGHT_SQL} * 1000 + 0.5)::BIGINT AS w, {SEVERITY_SQL} AS level FROM findings)
SELECT file, count(*) AS n, sum(w) / 1000.0::DOUBLE AS weight, CASE max(CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst FROM each GROUP BY file"""
)
def file_weights(spark, sf):
    """How much the findings of each file weigh, and the worst of them."""
    return compare.file_weights(S.findings(spark, sf))


@query(
    f"""WITH {FINDINGS_SQL}, j AS (SELECT score, (length(file) + loc) % 3 = 0 AS want FROM findings), e AS (
  SELECT 'all' AS band, want FROM j WHERE score >= 0.5 UNION ALL SELECT CASE WHEN score >= 0.7 THEN 'sure' WHEN score >= 0.5 THEN 'likely' ELSE 'doubtful' END, want FROM j)
SELECT band, count(*) AS n, count(*) FILTER (want) AS true_n, floor(count(*) FILTER (want) / count(*)::DOUBLE * 100 + 0.5) / 100 AS precision,
  floor(count(*) FILTER (want) / (SELECT count(*) FROM j WHERE want)::DOUBLE * 100 + 0.5) / 100 AS recall FROM e GROUP BY band"""
)
def accuracy_bands(spark, sf):
    """Precision and recall of labelled findings, in bands of confidence."""
    return compare.accuracy(S.findings(spark, sf).select("score", ((F.length("file") + F.col("loc")) % 3 == 0).alias("want")))


@query(
    """WITH n AS (SELECT p_brand AS grp, p_type AS name, count(*) AS part FROM part GROUP BY 1, 2), s AS (SELECT *, sum(part) OVER (PARTITION BY grp) AS total FROM n)
SELECT grp, name, CASE WHEN part / total * 100 < 1 THEN '<1%' WHEN part < total AND part / total * 100 > 99 THEN '>99%' ELSE floor(part / total * 100 + 0.5)::INT || '%' END AS share FROM s"""
)
def percent_shares(spark, sf):
    """Shares as text, never rounded to nothing or to all."""
    from pyspark.sql import Window

    n = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_brand").alias("grp"), F.col("p_type").alias("name")).agg(F.count("*").alias("part"))
    return n.select("grp", "name", compare.percent(F.col("part"), F.sum("part").over(Window.partitionBy("grp"))).alias("share"))


@query(f"WITH RECURSIVE {TYPESCRIPT_SQL} SELECT name, count(DISTINCT file) AS files, count(*) AS n FROM symbols GROUP BY name HAVING count(DISTINCT file) >= 2")
def code_same_name(spark, sf):
    """Names that several files declare."""
    return graph.same_name(_built(spark, written.typescript(spark, sf))[0].symbols)


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL} SELECT CASE WHEN file LIKE 'src/n3/%' THEN 'third' WHEN name LIKE 'cust1%' AND kind = 'function' THEN 'ones' END AS reason, count(*) AS n
FROM (SELECT file, name, kind FROM symbols UNION ALL SELECT DISTINCT file, '<module>', 'module' FROM c) WHERE file LIKE 'src/n3/%' OR name LIKE 'cust1%' AND kind = 'function' GROUP BY 1"""
)
def code_rule_effect(spark, sf):
    """How many symbols rules of one's own keep alive, the first rule counting."""
    g, _, _ = _built(spark, written.typescript(spark, sf))
    rules = (dead.Rule("third", files=("src/n3/**",)), dead.Rule("ones", names=("cust1*",)))
    return dead.rule_effect(g.symbols, g.facts, rules)


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, m AS (SELECT file, unnest(range(line::BIGINT, (line + loc)::BIGINT)) AS line, 'dead' AS kind FROM symbols WHERE id NOT IN (SELECT id FROM reach)
  UNION SELECT file, unnest(range(line::BIGINT, (line + 3)::BIGINT)), 'unfinished' FROM placed WHERE stub)
SELECT file, line, string_agg(kind, ',' ORDER BY kind) AS marks FROM m GROUP BY file, line"""
)
def code_line_marks(spark, sf):
    """The findings on each line of the scanned files."""
    g, _, stage = _built(spark, written.typescript(spark, sf))
    gone = dead.find_dead(g, stage, entry=(written.ENTRY,), rules=()).select("file", "line", F.lit("dead").alias("kind"), "loc")
    todo = settings.stubs(g).select("file", "line", F.lit("unfinished").alias("kind"), F.lit(3).alias("loc"))
    marks = report.line_marks(gone.unionByName(todo))
    return marks.select("file", F.col("line").cast("long").alias("line"), F.array_join("marks", ",").alias("marks"))


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL} SELECT id, CASE WHEN exported THEN 'export ' ELSE '' END || 'function ' || name || '(value)' AS signature, line AS first,
  CASE WHEN exported THEN 'export ' ELSE '' END || 'function ' || name || '(value) {{' AS text FROM symbols WHERE kind = 'function'"""
)
def code_snippets(spark, sf):
    """Heads of functions: as a signature, and as the line that stands in the file."""
    g, files, _ = _built(spark, written.typescript(spark, sf))
    sym = g.symbols.where("kind = 'function'")
    shown = report.snippets(files, sym.select("id", "file", "line", F.col("line").alias("end_line")))
    return shown.join(sym.select("id", report.signature(F.col("source")).alias("signature")), "id").select("id", "signature", F.col("first").cast("long").alias("first"), "text")


@query(
    """SELECT doc_id, used::BIGINT AS used FROM (SELECT doc_id, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000"""
)
def source_budget(spark, sf):
    """As many texts of each source, in order, as fit a budget of bytes."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("grp"), F.col("doc_id").alias("place"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return report.within_budget(d, 20_000).select(F.col("place").alias("doc_id"), "used")


@query(
    f"""WITH RECURSIVE {TYPESCRIPT_SQL}, v AS (SELECT DISTINCT file, seg, n FROM c) SELECT 'named-timeouts' AS rule, seg AS key, count(DISTINCT n * 10) AS n_values, count(*) AS n_sites, arg_min((n * 10)::VARCHAR, file) AS first_value, 0.7::DOUBLE AS score
FROM v GROUP BY seg HAVING count(DISTINCT n) >= 2 AND count(DISTINCT file) >= 3"""
)
def code_own_divergence(spark, sf):
    """A project's own rule on what must have one value."""
    g, _, _ = _built(spark, written.typescript(spark, sf))
    rule = settings.Divergence("named-timeouts", r"const ([a-z]+)Timeout = ([0-9]+)", 1, 2, 0.7, 3)
    return settings.divergent(settings.sources(g), rule)
