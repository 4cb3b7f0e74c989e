"""Contradictions and drift over source facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import compare

#: Words whose value should be the same wherever it is stated.
SETTING_WORDS = (
    "timeout", "retry", "backoff", "delay", "interval", "ttl",
    "expiry", "expire", "limit", "port", "threshold", "concurrency",
)
#: How UTC and local time are read; where nothing contradicts shipping code.
UTC = r"\b(?:getUTC(?:FullYear|Month|Date|Hours|Minutes|Seconds)|toISOString|Date\.UTC|utc\(\))"
LOCAL = r"\b(?:get(?:FullYear|Month|Date|Hours|Minutes|Seconds)\s*\(|toLocale(?:Date|Time)?String)"
NON_SOURCE = r"(?i)(^|/)(test|tests|spec|__tests__|test-d|e2e|bench|benchmark|benchmarks|perf|perf-measures|examples?|docs?|fixtures?|scripts?|vendor)/|\.(test|spec)\.[cm]?[jt]sx?$|_test\.py$|^test_"
#: What a default and a declared number look like.
DEFAULT = r"(?:process\.env|env)\s*(?:\.\s*([A-Z][A-Z0-9_]*)|\[\s*['\"]([A-Za-z0-9_]+)['\"]\s*\])\s*(?:\?\?|\|\|)\s*([^;,)\]}]+)"
NUMBER = r"(?m)(?:^([ \t]*)(?:export\s+)?(?:(?:public|private|internal|fileprivate|static|final)\s+)*(?:const|let|var|val)\s+([A-Za-z_$][A-Za-z0-9_$]*)|^\s*([A-Z][A-Z0-9_]{2,}))\s*(?::\s*\w+\s*)?=\s*([0-9]+)\s*(?:;|$)"


def sources(g) -> DataFrame:
    """(file, text): comment-free texts of shipping code."""
    return g.facts.where("tab = 'text'").select("file", F.col("a").alias("text")).where(~F.col("file").rlike(NON_SOURCE))


def _sites(text: DataFrame, pattern: str, groups: int) -> DataFrame:
    """(file, at, g1, ...): the groups of each match, in order."""
    hit = text.where(F.col("text").rlike(pattern)).select("file", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "m"))
    return hit.select("file", "at", *[F.regexp_extract("m", pattern, i + 1).alias(f"g{i + 1}") for i in range(groups)])


def plain_value(raw: Column) -> Column:
    """A literal without quotes and closing marks; empty for expressions, which can't be compared."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"[;,)]+$", ""))
    bare = F.regexp_replace(bare, "^['\"`]|['\"`]$", "")
    return F.when(bare.rlike(r"[(){}\[\]?]"), "").otherwise(bare)


@dataclass(frozen=True)
class Divergence:
    """A rule of a project's own: what must be stated with one value wherever it is stated.

    ``pattern`` finds the statements; its groups ``key`` and ``value`` (numbers from 1) are compared.
    """

    name: str
    pattern: str
    key: int = 1
    value: int = 2
    score: float = 0.6
    least_files: int = 1


def divergent(text: DataFrame, rule: Divergence) -> DataFrame:
    """What ``contradictions`` finds by one rule of one's own."""
    sites = _sites(text, rule.pattern, max(rule.key, rule.value)).select(F.col(f"g{rule.key}").alias("key"), plain_value(F.col(f"g{rule.value}")).alias("value"), "file", F.struct("file", "at").alias("seq"))
    sites = sites.where("key <> '' and value <> ''")
    wide = sites.groupBy("key").agg(F.countDistinct("file").alias("files")).where(F.col("files") >= rule.least_files)
    found = compare.conflicting(sites.join(wide, "key").select("key", "value", "seq"))
    return found.select(F.lit(rule.name).alias("rule"), "*", F.lit(rule.score).alias("score"))


def contradictions(g, own: tuple[Divergence, ...] = ()) -> DataFrame:
    """(rule, key, n_values, n_sites, score, first_value) of one setting with several values."""
    text, place = sources(g), F.struct("file", "at").alias("seq")
    env = _sites(text, DEFAULT, 3).select(F.when(F.col("g1") != "", F.col("g1")).otherwise(F.col("g2")).alias("key"), plain_value(F.col("g3")).alias("value"), place)
    out = compare.conflicting(env.where("key <> '' and value <> ''")).select(F.lit("env-default").alias("rule"), "*", F.lit(0.9).alias("score"))
    const = _sites(text, NUMBER, 4).withColumn("name", F.when(F.col("g2") != "", F.col("g2")).otherwise(F.col("g3")))
    # an indented lower-case declaration of Swift belongs to its type
    const = const.where(~(F.col("file").endswith(".swift") & (F.col("g2") != "") & (F.col("g1") != "") & ~F.col("name").rlike("^[A-Z][A-Z0-9_]+$")))
    const = const.withColumn("w", T.split_identifier(F.col("name"))).where(F.exists("w", lambda w: w.isin(*SETTING_WORDS)))
    const = const.select(F.array_join("w", "-").alias("key"), F.col("g4").alias("value"), "file", place)
    several = const.groupBy("key").agg(F.countDistinct("file").alias("files")).where("files >= 2")
    second = compare.conflicting(const.join(several, "key").select("key", "value", "seq"))
    out = out.unionByName(second.select(F.lit("constant").alias("rule"), "*", F.lit(0.6).alias("score")))
    readers = g.symbols.where((F.col("kind") != "module") & ~F.col("file").rlike(NON_SOURCE))
    clock = readers.select(F.lit("time").alias("grp"), F.col("source").rlike(UTC).alias("u"), F.col("source").rlike(LOCAL).alias("l")).where("u <> l")
    split = compare.split_population(clock.select("grp", F.col("u").alias("side")))
    third = split.select(F.lit("time-semantics").alias("rule"), F.lit("utc/local").alias("key"), F.lit(2).cast("long").alias("n_values"), (F.col("n_a") + F.col("n_b")).alias("n_sites"), F.lit("").alias("first_value"), F.lit(0.55).alias("score"))
    out = out.unionByName(third)
    for rule in own:
        out = out.unionByName(divergent(text, rule))
    return out


#: Conventions, the uses each needs to be one, and their dialects.
CATEGORIES = (("errors", 6), ("caught", 6), ("async", 6), ("logging", 5), ("exports", 8), ("validation", 4))
DIALECTS = (
    ("errors", "throw Error", r"\bthrow\s+new\s+\w*Error\b"),
    ("errors", "result object", r"\breturn\s*\{\s*(ok|success)\s*:"),
    ("caught", "swallow", r"\bcatch\s*(\([^)]*\))?\s*\{\s*(return\s+(null|undefined)\s*;?\s*)?\}"),
    ("caught", "console then rethrow", r"\bcatch[\s\S]{0,80}console\.(error|warn)[\s\S]{0,60}\bthrow\b"),
    ("async", "async/await", r"\bawait\s+"),
    ("async", "promise chain", r"\.then\s*\("),
    ("async", "node callback", r"function\s*\([^)]*\berr(or)?\b\s*,"),
    ("logging", "console", r"\bconsole\.(log|info|warn|error|debug)\s*\("),
    ("logging", "logger object", r"\b(logger|log)\.(info|warn|error|debug|trace)\s*\("),
    ("logging", "process.stdout", r"\bprocess\.(stdout|stderr)\.write\s*\(\s*(?![`'\"]\\r)"),
    ("exports", "named export", r"\bexport\s+(const|function|class|interface|type|async)\b"),
    ("exports", "default export", r"\bexport\s+default\b"),
    ("exports", "commonjs", r"\bmodule\.exports\b"),
    ("validation", "schema library", r"\b(z|yup|joi|v)\.(object|string|number|array)\s*\("),
    ("validation", "manual typeof guard", r"\btypeof\s+\w+\s*(===|!==)\s*['\"](string|number|boolean|object)['\"]"),
)
#: Files whose export form a framework decides, and code that does not ship.
EXEMPT = r"(^|/)(app|pages|src/app|src/pages)/.*/?(page|layout|route|loading|error|not-found|template|default|middleware|sitemap|robots|opengraph-image|icon)\.(tsx?|jsx?|mts)$|\.config\.(ts|js|mjs|cjs)$"
NON_PRODUCTION = r"(?i)(^|/)(bench|benchmark|benchmarks|perf|perf-measures|examples?|demo|playground|fixtures?|__fixtures__|docs?)/"


def dialect_uses(symbols: DataFrame) -> DataFrame:
    """(id, category, dialect): what each symbol of shipping code uses; it may use several."""
    source, file = F.col("source"), F.col("file")
    exempt = lambda c: file.rlike(EXEMPT) if c == "exports" else F.lit(False)
    hits = F.array_compact(F.array(*[F.when(source.rlike(p) & ~exempt(c), F.struct(F.lit(c).alias("category"), F.lit(d).alias("dialect"))) for c, d, p in DIALECTS]))
    made = symbols.where((F.col("kind") != "module") & ~file.rlike(NON_PRODUCTION))
    return made.select("id", F.explode(hits).alias("x")).select("id", "x.*")


def dialect_drift(g) -> DataFrame:
    """Minority conventions, see ``compare.drift``."""
    least = F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES for x in pair]), F.col("category"))
    return compare.drift(dialect_uses(g.symbols).select("category", "dialect"), least)


def unset_state(g) -> DataFrame:
    """(file, line, name, score): state that conditions read and nothing ever sets."""
    return g.facts.where("tab = 'unset'").select("file", "line", F.col("a").alias("name"), F.lit(0.85).alias("score"))


def stubs(g) -> DataFrame:
    """(file, line, name, score): functions that only say they are not implemented."""
    f = g.facts.where("tab = 'stub'")
    twice = g.symbols.where("kind = 'method'").groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("name").alias("a"))
    methods = f.where("b <> ''").join(twice, "a", "left_anti").select("file", "line", F.col("a").alias("name"))
    return f.where("b = ''").select("file", "line", F.col("a").alias("name")).unionByName(methods).withColumn("score", F.lit(0.9))
