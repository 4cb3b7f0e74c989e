"""Source files laid over the driver's parquet tables, so that the scan of code can be compared with SQL.

A customer is a function of the file of its nation and segment, a supplier one of
a Python module of its nation; each calls the functions of twice its number and of
that and one, where their balance is not negative. The balance, segment and nation
decide what else a function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table

ENTRY = "src/index.ts"


def _lines(*parts: Column) -> Column:
    """Arrays of lines after one another; null ones are none."""
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def _say(text: str, *values: Column) -> Column:
    """One line, ``%s`` standing for the values in turn."""
    return F.array(F.format_string(text, *values))


def typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a file for each nation and segment, and the entry."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("int").alias("n"), F.lower("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal")
    )
    c = c.withColumn("file", F.format_string("src/n%d/%s.ts", "n", "seg")).withColumn("stub", F.col("bal") < -900)
    child = c.where("bal >= 0").select(F.col("k").alias("child"), F.floor(F.col("k") / 2).alias("k"), F.col("file").alias("to"), F.format_string("../n%d/%s", "n", "seg").alias("spec"))
    calls = c.where("not stub").select("k", "file").join(child, "k")
    own = calls.groupBy("k").agg(F.sort_array(F.collect_list("child")).alias("children"))
    k, n, seg, stub = (F.col(x) for x in ("k", "n", "seg", "stub"))
    pads = F.when(n % 4 > 0, F.transform(F.sequence(F.lit(1), F.greatest(n % 4, F.lit(1))), lambda i: F.format_string("  total += %d;", i)))
    said = (
        F.when(seg == "building", F.lit("  console.log(total);")).when(seg == "machinery", F.lit("  logger.info(total);"))
        .when(seg == "household", F.lit("  if (typeof value === 'string') return 0;")).when(seg == "furniture", F.lit("  z.object(value);"))
        .otherwise(F.when(k % 2 == 0, F.lit("  total += value.getUTCHours();")).otherwise(F.lit("  total += value.getHours();")))
    )
    note = F.when(stub & (k % 3 == 0), _say("// graphloom-ignore unfinished: planned work")).when(stub & (k % 3 == 1), _say("// graphloom-ignore unfinished"))
    head = F.when(F.col("bal") >= 0, _say("export function cust%d(value) {", k)).otherwise(_say("function cust%d(value) {", k))
    body = F.when(stub, _say('  throw new Error("not implemented");')).otherwise(
        _lines(_say("  let total = %d;", k), pads, F.array(said), F.transform("children", lambda x: F.format_string("  total += cust%d(total);", x)), _say("  return total;"))
    )
    functions = c.join(own, "k", "left").select("file", "n", "seg", "k", F.concat(_lines(note, head, body), F.array(F.lit("}"), F.lit(""))).alias("lines"))
    functions = functions.groupBy("file", "n", "seg").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "lines"))), lambda x: x["lines"])).alias("lines"))
    named = calls.where("to <> file").groupBy("file", "to", "spec").agg(F.sort_array(F.collect_set("child")).alias("names"))
    line = F.concat(F.lit("import { "), F.array_join(F.transform("names", lambda x: F.format_string("cust%d", x)), ", "), F.lit(" } from '"), F.col("spec"), F.lit("';"))
    imports = named.select("file", F.struct("to", line.alias("line")).alias("x")).groupBy("file").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]).alias("imports"))
    top = F.array(F.format_string("export const %sTimeout = %d;", seg, n * 10), F.format_string("const url = process.env.%s_URL ?? 'h%d';", F.upper(seg), n % 4))
    files = functions.join(imports, "file", "left").select("file", F.array_join(F.concat(_lines(top, F.col("imports")), F.array(F.lit("")), F.col("lines")), "\n").alias("content"))
    first = c.where("k = 1").select(F.lit(ENTRY).alias("file"), F.format_string("import { cust1 } from './n%d/%s';\ncust1(1);\n", "n", "seg").alias("content"))
    return files.unionByName(first)


#: The same in DuckDB SQL: functions with their lines, calls, and the edges of the graph.
TYPESCRIPT_SQL = r"""c AS (
  SELECT c_custkey AS k, c_nationkey AS n, lower(c_mktsegment) AS seg, c_acctbal AS bal, c_acctbal < -900 AS stub,
    'src/n' || c_nationkey || '/' || lower(c_mktsegment) || '.ts' AS file FROM customer
), calls AS (
  SELECT a.k, a.file, b.k AS child, b.file AS dst FROM c a JOIN c b ON b.k // 2 = a.k AND b.bal >= 0 WHERE NOT a.stub
), sized AS (
  SELECT c.*, file || '#cust' || k AS id, CASE WHEN stub THEN 3 ELSE 5 + n % 4 + (SELECT count(*) FROM calls WHERE calls.k = c.k) END AS loc,
    CASE WHEN stub AND k % 3 IN (0, 1) THEN 1 ELSE 0 END AS note FROM c
), placed AS (
  SELECT *, 3 + (SELECT count(DISTINCT dst) FROM calls WHERE calls.file = sized.file AND dst <> calls.file)
    + sum(loc + 1 + note) OVER (PARTITION BY file ORDER BY k) - loc AS line FROM sized
), symbols AS (
  SELECT id, file, 'cust' || k AS name, 'function' AS kind, line::BIGINT AS line, loc::BIGINT AS loc, bal >= 0 AS exported FROM placed
  UNION ALL SELECT DISTINCT file || '#' || seg || 'Timeout', file, seg || 'Timeout', 'variable', 1, 1, true FROM c
  UNION ALL SELECT DISTINCT file || '#url', file, 'url', 'variable', 2, 1, false FROM c
), far AS (SELECT DISTINCT file, child, dst FROM (
    SELECT file, child, dst FROM calls WHERE dst <> file UNION ALL SELECT 'src/index.ts', k, file FROM c WHERE k = 1)
), edges AS (
  SELECT file || '#cust' || k AS src, dst || '#cust' || child AS dst, 'references' AS kind FROM calls WHERE k <> child
  UNION SELECT file || '#<module>', dst || '#<module>', 'imports' FROM far
  UNION SELECT file || '#<module>', dst || '#cust' || child, 'imports' FROM far
  UNION SELECT file || '#<module>', dst || '#cust' || child, 'references' FROM far
), reach(id) AS (SELECT 'src/index.ts#<module>' UNION SELECT dst FROM edges JOIN reach ON src = reach.id
), dead AS (
  SELECT id, file, name, kind, loc, floor((0.95 - CASE WHEN exported THEN 0.25 ELSE 0 END - CASE WHEN loc <= 2 THEN 0.1 ELSE 0 END) * 100 + 0.5) / 100 AS score
  FROM symbols WHERE id NOT IN (SELECT id FROM reach)
), orphans AS (
  SELECT file FROM symbols WHERE file NOT IN (SELECT split_part(dst, '#', 1) FROM edges WHERE kind = 'imports')
  GROUP BY file HAVING count(*) >= 2 AND count(*) = count(*) FILTER (id NOT IN (SELECT id FROM reach))
)"""


def python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a module for each nation of suppliers, a package and a script."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("int").alias("n"), F.col("s_acctbal").alias("bal"))
    s = s.withColumn("name", F.when(F.col("bal") >= 0, F.format_string("sup%d", "k")).otherwise(F.format_string("_sup%d", "k")))
    child = s.where("bal >= 0").select(F.col("k").alias("child"), F.floor(F.col("k") / 2).alias("k"), F.col("n").alias("to"))
    calls = s.select("k", "n").join(child, "k")
    own = calls.groupBy("k").agg(F.sort_array(F.collect_list("child")).alias("children"))
    lines = _lines(
        F.array(F.concat(F.lit("def "), "name", F.lit("(value):"))),
        F.when(F.col("bal") < -900, _say("    raise NotImplementedError")).otherwise(
            _lines(_say("    total = value + %d", F.col("k")), F.transform("children", lambda x: F.format_string("    total += sup%d(total)", x)), _say("    return total"))
        ),
        F.array(F.lit(""), F.lit("")),
    )
    functions = s.join(own, "k", "left").select("n", "k", lines.alias("lines")).groupBy("n").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "lines"))), lambda x: x["lines"])).alias("lines"))
    named = calls.where("to <> n").join(s.where("bal >= -900").select("k"), "k").groupBy("n", "to").agg(F.sort_array(F.collect_set("child")).alias("names"))
    line = F.concat(F.lit("from .n"), F.col("to").cast("string"), F.lit(" import "), F.array_join(F.transform("names", lambda x: F.format_string("sup%d", x)), ", "))
    imports = named.select("n", F.struct("to", line.alias("line")).alias("x")).groupBy("n").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]).alias("imports"))
    files = functions.join(imports, "n", "left").select(F.format_string("pkg/n%d.py", "n").alias("file"), F.array_join(_lines(F.col("imports"), F.array(F.lit("")), F.col("lines")), "\n").alias("content"))
    first = s.where("k = 1").select(F.lit("pkg/main.py").alias("file"), F.concat(F.lit("from .n"), F.col("n").cast("string"), F.lit(" import "), "name", F.lit('\n\nif __name__ == "__main__":\n    '), "name", F.lit("(1)\n")).alias("content"))
    empty = spark.range(1).select(F.lit("pkg/__init__.py").alias("file"), F.lit("").alias("content"))
    return files.unionByName(first).unionByName(empty)


PYTHON_SQL = r"""s AS (
  SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS bal, 'pkg/n' || s_nationkey || '.py' AS file,
    CASE WHEN s_acctbal >= 0 THEN 'sup' ELSE '_sup' END || s_suppkey AS name FROM supplier
), calls AS (
  SELECT a.k, a.file, a.name, b.file AS dst, b.name AS child FROM s a JOIN s b ON b.k // 2 = a.k AND b.bal >= 0 WHERE a.bal >= -900
), sized AS (
  SELECT *, file || '#' || name AS id, CASE WHEN bal < -900 THEN 2 ELSE 3 + (SELECT count(*) FROM calls WHERE calls.k = s.k) END AS loc FROM s
), symbols AS (
  SELECT id, file, name, 'function' AS kind, loc::BIGINT AS loc, bal >= 0 AS exported,
    (2 + (SELECT count(DISTINCT dst) FROM calls WHERE calls.file = sized.file AND dst <> calls.file) + sum(loc + 2) OVER (PARTITION BY file ORDER BY k) - loc - 2)::BIGINT AS line FROM sized
), far AS (
  SELECT DISTINCT file, dst, child FROM calls WHERE dst <> file UNION SELECT 'pkg/main.py', file, name FROM s WHERE k = 1
), files AS (SELECT DISTINCT file FROM s UNION SELECT 'pkg/main.py'
), edges AS (
  SELECT file || '#' || name AS src, dst || '#' || child AS dst, 'references' AS kind FROM calls WHERE name <> child
  UNION SELECT file || '#<module>', dst || '#<module>', 'imports' FROM far
  UNION SELECT file || '#<module>', dst || '#' || child, 'imports' FROM far
  UNION SELECT 'pkg/main.py#<module>', file || '#' || name, 'references' FROM s WHERE k = 1
  UNION SELECT file || '#<module>', 'pkg/__init__.py#<module>', 'imports' FROM files
), reach(id) AS (SELECT 'pkg/main.py#<module>' UNION SELECT dst FROM edges JOIN reach ON src = reach.id
)"""


def go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a package for each nation with a file for each segment; customers call within their nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("int").alias("n"), F.lower("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    c = c.withColumn("name", F.when(F.col("bal") >= 5000, F.format_string("Cust%d", "k")).otherwise(F.format_string("cust%d", "k")))
    child = c.select(F.floor(F.col("k") / 2).alias("k"), F.col("n").alias("to"), F.col("k").alias("child"), F.col("name").alias("called"))
    own = c.join(child, "k").where("n = to and k <> child").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("child", "called"))).alias("children"))
    lines = _lines(
        F.array(F.concat(F.lit("func "), "name", F.lit("(v int) int {"))),
        F.when(F.col("bal") < -900, _say('\tpanic("not implemented")')).otherwise(_lines(F.transform("children", lambda x: F.concat(F.lit("\tv += "), x["called"], F.lit("(v)"))), F.array(F.lit("\treturn v")))),
        F.array(F.lit("}"), F.lit("")),
    )
    functions = c.join(own, "k", "left").select("n", "seg", "k", lines.alias("lines")).groupBy("n", "seg").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "lines"))), lambda x: x["lines"])).alias("lines"))
    return functions.select(F.format_string("internal/n%d/%s.go", "n", "seg").alias("file"), F.array_join(F.concat(F.array(F.format_string("package n%d", "n"), F.lit("")), "lines"), "\n").alias("content"))


GO_SQL = r"""c AS (
  SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS bal, 'internal/n' || c_nationkey || '/' || lower(c_mktsegment) || '.go' AS file,
    CASE WHEN c_acctbal >= 5000 THEN 'Cust' ELSE 'cust' END || c_custkey AS name FROM customer
), calls AS (SELECT a.k, a.n, a.file, a.name, a.bal, b.file AS dst, b.name AS child FROM c a JOIN c b ON b.k // 2 = a.k AND b.n = a.n AND a.k <> b.k
), sized AS (SELECT *, file || '#' || name AS id, CASE WHEN bal < -900 THEN 3 ELSE 3 + (SELECT count(*) FROM calls WHERE calls.k = c.k) END AS loc FROM c
), symbols AS (SELECT id, 'function' AS kind, bal >= 5000 AS exported, loc::BIGINT AS loc, (2 + sum(loc + 1) OVER (PARTITION BY file ORDER BY k) - loc)::BIGINT AS line, bal FROM sized
), edges AS (SELECT DISTINCT file || '#' || name AS src, dst || '#' || child AS dst FROM calls WHERE bal >= -900)"""


def swift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a class for each nation, its suppliers' methods call those of twice their number."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("int").alias("n"), F.col("s_acctbal").alias("bal"))
    child = s.select(F.floor(F.col("k") / 2).alias("k"), F.col("k").alias("child"))
    own = s.join(child, "k").where("k <> child").groupBy("k").agg(F.sort_array(F.collect_list("child")).alias("children"))
    lines = _lines(
        F.array(F.format_string("  %sfunc sup%d(_ v: Int) -> Int {", F.when(F.col("bal") >= 5000, "public ").otherwise(""), "k")),
        F.transform("children", lambda x: F.format_string("    other.sup%d(v)", x)),
        F.array(F.lit("    return v"), F.lit("  }")),
    )
    methods = s.join(own, "k", "left").select("n", "k", lines.alias("lines")).groupBy("n").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "lines"))), lambda x: x["lines"])).alias("lines"))
    return methods.select(F.format_string("App/Nation%d.swift", "n").alias("file"), F.array_join(F.concat(F.array(F.format_string("class Nation%d {", "n")), "lines", F.array(F.lit("}"), F.lit(""))), "\n").alias("content"))


SWIFT_SQL = r"""s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS bal, 'App/Nation' || s_nationkey || '.swift#Nation' || s_nationkey AS cls FROM supplier
), calls AS (SELECT a.k, a.cls || '.sup' || a.k AS src, b.cls || '.sup' || b.k AS dst FROM s a JOIN s b ON b.k // 2 = a.k AND a.k <> b.k
), sized AS (SELECT *, 3 + (SELECT count(*) FROM calls WHERE calls.k = s.k) AS loc FROM s
), symbols AS (
  SELECT cls || '.sup' || k AS id, 'method' AS kind, bal >= 5000 AS exported, loc::BIGINT AS loc, (2 + sum(loc) OVER (PARTITION BY n ORDER BY k) - loc)::BIGINT AS line FROM sized
  UNION ALL SELECT cls, 'class', false, (2 + sum(loc))::BIGINT, 1 FROM sized GROUP BY cls
)"""
