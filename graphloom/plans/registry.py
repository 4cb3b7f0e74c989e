"""The registry of queries over the driver's tables, and their SQL oracles.

Each query applies one operator of the engine to graph tables that
``graphloom.sources.tables`` lays over the parquet tables; the SQL beside it says
the same independently of the Spark code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import compare, concepts, graph, lookup, similar, spans
from graphloom.plans.staging import Stage
from graphloom.sources import tables as S
from graphloom.sources.tables import EDGES_SQL, FINDINGS_SQL, RANGES_SQL, SITES_SQL, SYMBOLS_SQL, key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["reach_unreachable_parts"](spark, sf_dir)


def root(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("id"))


REACH_SQL = f"WITH RECURSIVE {EDGES_SQL}, reach(id) AS (SELECT 'n0' UNION SELECT dst FROM edges JOIN reach ON src = reach.id)"

# -- reachability ---------------------------------------------------------------


@query(
    f"""{REACH_SQL}
SELECT id, p_name AS name, loc, weight, row_number() OVER (ORDER BY weight DESC, id) AS place FROM (
  SELECT 'p' || p_partkey AS id, p_name, p_size::BIGINT AS loc, floor(0.95 * log2(p_size + 2) * 100 + 0.5) / 100 AS weight
  FROM part WHERE 'p' || p_partkey NOT IN (SELECT id FROM reach))"""
)
def reach_unreachable_parts(spark, sf):
    """Dead symbols: parts that nothing reaches from nation 0, ranked."""
    parts = table(spark, sf, "part").select(key("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("loc"))
    dead = graph.unreached(parts, S.edges(spark, sf), root(spark, "n0"), Stage(spark))
    dead = dead.withColumn("weight", T.round2(0.95 * F.log2(F.col("loc") + 2)))
    # a report of a few rows a part: ranks come from a range-partitioned sort
    ranked = dead.groupBy("weight").agg(F.count("*").alias("n"))
    above = ranked.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("weight").orderBy("id"))
    return dead.withColumn("r", within).join(above.select("weight", "above"), "weight").select("id", "name", "loc", "weight", (F.col("above") + F.col("r")).cast("long").alias("place"))


@query(
    f"""{REACH_SQL}, more(id) AS (
  SELECT 'n' || s_nationkey FROM supplier WHERE 's' || s_suppkey IN (SELECT id FROM reach)
  UNION SELECT dst FROM edges JOIN more ON src = more.id)
SELECT substr(id, 1, 1) AS kind, count(*) AS n FROM (SELECT id FROM reach UNION SELECT id FROM more) GROUP BY 1"""
)
def reach_two_stage_roots(spark, sf):
    """A second walk from roots that only the first walk reveals."""
    stage, edges = Stage(spark), S.edges(spark, sf)
    first = graph.reachable(edges, root(spark, "n0"), stage)
    sup = table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("id"), key("n", "s_nationkey").alias("nation"))
    more = sup.join(first, "id", "left_semi").select(F.col("nation").alias("id"))
    both = graph.reachable(edges, more, stage).unionByName(first).distinct()
    return both.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, back(id, hop) AS (SELECT 'p1', 0 UNION SELECT src, hop + 1 FROM edges JOIN back ON dst = back.id WHERE hop < 3)
SELECT id, min(hop) AS hop FROM back GROUP BY id HAVING min(hop) > 0"""
)
def blast_radius_part(spark, sf):
    """Who depends on part 1 within three hops."""
    return graph.blast_radius(S.edges(spark, sf), "p1", Stage(spark), 3)


@query(
    f"""{REACH_SQL}
SELECT file, count(*) AS n, sum(loc)::BIGINT AS loc FROM (
  SELECT p_brand || '/' || p_size AS file, p_size AS loc, 'p' || p_partkey IN (SELECT id FROM reach) AS reached, p_retailprice < 905 AS uncertain FROM part)
GROUP BY file HAVING count(*) >= 2 AND NOT bool_or(reached) AND NOT bool_or(uncertain)"""
)
def orphan_groups(spark, sf):
    """Files whose every symbol is unreached and none uncertain."""
    parts = table(spark, sf, "part").select(
        key("p", "p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("file"), F.col("p_size").alias("loc"), (F.col("p_retailprice") < 905).alias("uncertain")
    )
    seen = graph.reachable(S.edges(spark, sf), root(spark, "n0"), Stage(spark)).withColumn("hit", F.lit(True))
    return graph.orphan_files(parts.join(seen, "id", "left").withColumn("reached", F.coalesce("hit", F.lit(False))))


@query(
    f"""WITH {EDGES_SQL} SELECT dst AS id, count(*) AS callers, count(DISTINCT src) AS distinct_callers FROM edges GROUP BY dst"""
)
def callers_distinct(spark, sf):
    return graph.caller_counts(S.edges(spark, sf))


OWNER_SQL = """owner AS (
  SELECT 'c' || c_custkey AS id, c_mktsegment AS file FROM customer
  UNION ALL SELECT 'o' || o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_brand FROM part)"""


@query(
    f"""WITH {EDGES_SQL}, {OWNER_SQL}
SELECT a.file AS from_file, b.file AS to_file, count(*) AS links
FROM (SELECT DISTINCT src, dst FROM edges) e JOIN owner a ON a.id = src JOIN owner b ON b.id = dst WHERE a.file <> b.file GROUP BY 1, 2"""
)
def file_links(spark, sf):
    """File-level dependencies: distinct symbol pairs between two files."""
    own = lambda n, p, k, f: table(spark, sf, n).select(key(p, k).alias("id"), F.col(f).alias("file"))
    owner = own("customer", "c", "c_custkey", "c_mktsegment").unionByName(own("orders", "o", "o_orderkey", "o_orderpriority")).unionByName(own("part", "p", "p_partkey", "p_brand"))
    return graph.file_links(S.edges(spark, sf), owner)


@query(
    f"""WITH {EDGES_SQL} SELECT id, callers, floor(callers * log2(p_size + 2) * 100 + 0.5) / 100 AS weight FROM (
  SELECT dst AS id, count(*) AS callers FROM edges GROUP BY dst) JOIN part ON id = 'p' || p_partkey
WHERE p_size >= 4 ORDER BY weight DESC, id LIMIT 50"""
)
def load_bearing(spark, sf):
    """The parts that most depends on: callers times log of size (a top-50 report)."""
    parts = table(spark, sf, "part").select(key("p", "p_partkey").alias("id"), F.col("p_size").alias("loc"))
    return lookup.load_bearing(parts, S.edges(spark, sf))


@query(
    """SELECT b.l_orderkey || '.' || b.l_linenumber AS base_member, d.l_orderkey || '.' || d.l_linenumber AS derived_member
FROM (SELECT o_orderkey AS base, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS derived FROM orders) h
JOIN lineitem b ON b.l_orderkey = base JOIN lineitem d ON d.l_orderkey = derived AND b.l_shipdate = d.l_shipdate"""
)
def override_edges(spark, sf):
    """Members of one name in a base class and its successor (orders of a customer)."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    hierarchy = table(spark, sf, "orders").select(F.col("o_orderkey").alias("base"), after.alias("derived"))
    members = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_shipdate").alias("name"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"))
    return graph.override_edges(hierarchy, members)


@query(
    """SELECT e.event_type AS name, count(*) AS refs, count(DISTINCT e.user_id || ':' || s.s_suppkey) AS pairs
FROM events e JOIN supplier s ON e.user_id % 25 = s.s_nationkey GROUP BY 1"""
)
def name_many_to_many(spark, sf):
    """Unresolved calls reach every method of the name."""
    refs = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("src"), (F.col("user_id") % 25).cast("int").alias("name"))
    methods = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("dst"))
    hit = graph.name_edges(refs, methods)
    return hit.groupBy(F.col("kind").alias("name")).agg(F.sum("n").alias("refs"), F.countDistinct("src", "dst").alias("pairs"))


# -- text ----------------------------------------------------------------------

_SHORT = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.SHORT.items()) + "}"
_CUT = "CASE WHEN regexp_matches(w, 'ing$') AND length(w) > 5 THEN left(w, -3) WHEN regexp_matches(w, 'ed$') AND length(w) > 4 THEN left(w, -2) WHEN regexp_matches(w, '[^s]s$') AND length(w) > 3 THEN left(w, -1) ELSE w END"
STEM_SQL = f"list_transform(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: coalesce({_SHORT}[w], {_SHORT}[{_CUT}], {_CUT}))"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)


@query(
    f"""SELECT name, array_to_string({STEM_SQL}, ' ') AS words FROM (
  SELECT DISTINCT p_name || 'HTTPServerSettings_' || p_type AS name FROM part UNION SELECT DISTINCT c_mktsegment || 'LoadedItems' FROM customer UNION SELECT DISTINCT event_type FROM events)"""
)
def ident_split(spark, sf):
    """Identifier words: camel, acronym and snake boundaries, stemmed."""
    p = table(spark, sf, "part").select(F.concat("p_name", F.lit("HTTPServerSettings_"), "p_type").alias("name"))
    c = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("LoadedItems")).alias("name"))
    e = table(spark, sf, "events").select(F.col("event_type").alias("name"))
    names = p.distinct().unionByName(c.distinct()).unionByName(e.distinct()).distinct()
    return names.select("name", F.array_join(T.split_identifier(F.col("name")), " ").alias("words"))


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def token_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(
    f"""SELECT shingle, count(*) AS n FROM (
  SELECT unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) ELSE [] END) AS shingle
  FROM (SELECT {WORDS_SQL} AS w FROM documents)) GROUP BY 1 ORDER BY n DESC, shingle LIMIT 100"""
)
def shingle_top(spark, sf):
    """The commonest word 4-grams (a top-100 report)."""
    return similar.common_shingles(table(spark, sf, "documents").select(T.words(F.col("text")).alias("w")), 4, 100)


BAG_SQL = f"""{SYMBOLS_SQL}, bag AS (
  SELECT id, term, sum(w)::BIGINT AS w FROM (
    SELECT id, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+')) AS term, 3 AS w FROM symbols
    UNION ALL SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+')), 1 FROM symbols)
  WHERE length(term) >= 2 AND term NOT IN ({STOP_SQL}) GROUP BY 1, 2)"""


@query(f"WITH {BAG_SQL} SELECT term, count(*) AS docs, sum(w)::BIGINT AS weight FROM bag GROUP BY term")
def vocab_bag(spark, sf):
    """Weighted word bags, summed over all symbols."""
    return similar.weighted_bags(S.symbols(spark, sf)).groupBy("term").agg(F.count("*").alias("docs"), F.sum("w").alias("weight"))


@query(f"WITH {BAG_SQL} SELECT term, count(DISTINCT file) AS df FROM bag JOIN symbols USING (id) GROUP BY term HAVING count(DISTINCT file) >= 2")
def doc_frequency(spark, sf):
    """In how many files a word is used."""
    sym = S.symbols(spark, sf)
    return lookup.document_frequency(similar.weighted_bags(sym), sym)


@query(
    f"""WITH {BAG_SQL}, tf AS (
  SELECT lang, term, sum(round(log2(loc + 2) * 1000000)::BIGINT)::BIGINT AS tf FROM bag JOIN symbols USING (id) GROUP BY 1, 2
), df AS (SELECT term, count(DISTINCT lang) AS df FROM tf GROUP BY 1), ranked AS (
  SELECT lang, term, floor(tf / 1000000.0::DOUBLE * ln((SELECT count(DISTINCT lang) FROM tf) / df::DOUBLE + 1) * 100 + 0.5) / 100 AS score FROM tf JOIN df USING (term))
SELECT lang, term, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS place FROM ranked QUALIFY place <= 2"""
)
def tfidf_top2(spark, sf):
    """Distinctive names: the two best words of each group by size-weighted TF-IDF."""
    sym = S.symbols(spark, sf)
    # each row's part of the sum is rounded, so that its order does not matter
    tf = similar.weighted_bags(sym).join(sym.select("id", "lang", "loc"), "id").groupBy("lang", "term").agg(F.sum(F.round(F.log2(F.col("loc") + 2) * 1000000).cast("long")).alias("tf"))
    best = lookup.distinctive(Stage(spark).cut(tf.select(F.col("lang").alias("grp"), "term", (F.col("tf") / 1000000.0).alias("tf"))))
    return best.select(F.col("grp").alias("lang"), "term", "score", F.col("place").cast("long").alias("place"))


PAIRS_SQL = f"""{SYMBOLS_SQL}, bag AS (
  SELECT id, term, count(*) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM symbols) WHERE length(term) >= 2 GROUP BY 1, 2
), sized AS (SELECT term, id, seq, length(body) AS n FROM bag JOIN symbols USING (id)
), cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM sized x JOIN sized y USING (term) WHERE x.seq < y.seq AND greatest(x.n, y.n) <= 2.5 * least(x.n, y.n)
), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM bag GROUP BY 1
), pairs AS (
  SELECT a, b, dot / (na.norm * nb.norm) AS score FROM (
    SELECT a, b, sum(x.w * y.w) AS dot FROM cand JOIN bag x ON x.id = a JOIN bag y ON y.id = b AND x.term = y.term GROUP BY 1, 2) d
  JOIN norms na ON na.id = a JOIN norms nb ON nb.id = b WHERE dot / (na.norm * nb.norm) >= 0.9)"""


@query(f"WITH {PAIRS_SQL} SELECT a, b, floor(score * 10000 + 0.5) / 10000 AS score FROM pairs")
def cosine_pairs(spark, sf):
    """Re-implemented symbols: self-join of blocks, cosine of 0.9 or more."""
    return similar.similar_pairs(S.symbols(spark, sf), 0.9, Stage(spark)).select("a", "b", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


@query(
    f"""WITH RECURSIVE {PAIRS_SQL}, links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), walk(id, other) AS (SELECT a, a FROM links UNION SELECT walk.id, b FROM walk JOIN links ON a = other
), roots AS (SELECT id, min(other) AS root FROM walk GROUP BY 1)
SELECT root, members, floor(score * 100 + 0.5) / 100 AS score, floor(best * 100 + 0.5) / 100 AS best, removable FROM (
  SELECT root, count(*) AS members, (sum(loc) - min(loc))::BIGINT AS removable FROM roots JOIN symbols USING (id) GROUP BY 1)
JOIN (SELECT root, avg(score) AS score, max(score) AS best FROM pairs JOIN roots ON id = a GROUP BY 1) USING (root)"""
)
def dup_components(spark, sf):
    """Duplicate clusters: components of the pairs, their scores and removable lines."""
    stage = Stage(spark)
    symbols = S.symbols(spark, sf)
    return similar.clusters(similar.similar_links(symbols, 0.9, stage), symbols, stage)


@query(f"WITH {SYMBOLS_SQL} SELECT md5(body) AS body, count(*) AS members, (sum(loc) - min(loc))::BIGINT AS removable FROM symbols GROUP BY 1 HAVING count(*) >= 2")
def exact_dup_removable(spark, sf):
    g = S.symbols(spark, sf).groupBy(F.md5("body").alias("body")).agg(F.count("*").alias("members"), (F.sum("loc") - F.min("loc")).cast("long").alias("removable"))
    return g.where("members >= 2")


@query(
    f"""WITH RECURSIVE {SYMBOLS_SQL}, total AS (SELECT count(*) AS n FROM symbols
), draw(i, state) AS (
  SELECT 1, (42::BIGINT * 1664525 + 1013904223) % 4294967296 UNION ALL SELECT i + 1, (state * 1664525 + 1013904223) % 4294967296 FROM draw WHERE i < 800
), picked AS (SELECT i, floor(state / 4294967296.0::DOUBLE * n)::BIGINT AS at FROM draw, total
), drawn AS (SELECT DISTINCT x.at AS x, y.at AS y FROM picked x JOIN picked y ON y.i = x.i + 1 AND x.i % 2 = 1 WHERE x.at <> y.at
), bag AS (
  SELECT seq, term, count(*) AS w FROM (SELECT seq, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM symbols) WHERE length(term) >= 2 GROUP BY 1, 2
), norms AS (SELECT seq, sqrt(sum(w * w)) AS norm FROM bag GROUP BY 1
), dots AS (SELECT x, y, sum(a.w * b.w) AS dot FROM drawn JOIN bag a ON a.seq = x JOIN bag b ON b.seq = y AND a.term = b.term GROUP BY 1, 2
), scores AS (SELECT coalesce(dot / (p.norm * q.norm), 0) AS s FROM drawn LEFT JOIN dots USING (x, y) LEFT JOIN norms p ON p.seq = x LEFT JOIN norms q ON q.seq = y
), sorted AS (SELECT list_sort(list(s)) AS s FROM scores)
SELECT n AS candidates, greatest(0.72::DOUBLE, least(0.95::DOUBLE, s[least(len(s), floor(len(s) * 0.95::DOUBLE)::BIGINT + 1)] + 0.05::DOUBLE)) AS threshold FROM total, sorted"""
)
def calibrated_threshold(spark, sf):
    """The duplicate threshold, raised above random pairs of the corpus."""
    sym = S.symbols(spark, sf)
    n = sym.count()
    drawn = similar.random_pairs(n) if n >= 30 else []
    pairs = spark.createDataFrame(drawn, "x long, y long") if drawn else spark.createDataFrame([], "x long, y long")
    ids = sym.select("seq", "id")
    named = pairs.distinct().join(ids.select(F.col("seq").alias("x"), F.col("id").alias("a")), "x").join(ids.select(F.col("seq").alias("y"), F.col("id").alias("b")), "y").select("a", "b")
    scores = [r.score for r in similar.cosine(similar.bags(sym), named, 0.0).collect()]  # at most the 400 draws
    scores += [0.0] * (len(set(drawn)) - len(scores))
    return spark.range(1).select(F.lit(n).alias("candidates"), F.lit(similar.calibrated_threshold(scores, 0.72)).alias("threshold"))


@query(
    """WITH d AS (SELECT DISTINCT p_brand AS grp, p_name AS name FROM part), s AS (SELECT grp, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 8)
SELECT a.grp AS a, b.grp AS b, count(*) AS shared FROM d a JOIN s sa ON sa.grp = a.grp JOIN d b ON a.name = b.name AND a.grp < b.grp JOIN s sb ON sb.grp = b.grp
GROUP BY 1, 2 HAVING count(*) >= 8 AND count(*) >= 0.4 * min(least(sa.n, sb.n))"""
)
def parallel_sources(spark, sf):
    """Mirrored directories: groups that share many names."""
    return similar.parallel_groups(table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_name").alias("name")))


# -- compare -------------------------------------------------------------------

DRIFT_SQL = """n AS (SELECT category, dialect, count(*) AS n FROM uses GROUP BY 1, 2
), r AS (SELECT *, n / sum(n) OVER c AS share, sum(n) OVER c AS total, count(*) OVER c AS dialects, row_number() OVER (PARTITION BY category ORDER BY n DESC, dialect) AS rank,
  max(n) OVER c / sum(n) OVER c AS top FROM n WINDOW c AS (PARTITION BY category))
SELECT category, dialect, n, floor(share * 100 + 0.5) / 100 AS share, rank, CASE WHEN top >= 0.8 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS score
FROM r WHERE total >= 4 AND dialects >= 2 AND (share >= 0.02 OR n >= 3)"""


@query(f"WITH uses AS (SELECT o_orderpriority AS category, o_orderstatus AS dialect FROM orders), {DRIFT_SQL}")
def drift_priorities(spark, sf):
    return compare.drift(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("dialect")))


@query(
    f"""WITH uses AS (
  SELECT 'list' AS category, 'pipe' AS dialect FROM documents WHERE regexp_matches(text, ' \\| ')
  UNION ALL SELECT 'list', 'comma' FROM documents WHERE regexp_matches(text, ', ')
  UNION ALL SELECT 'emphasis', 'shout' FROM documents WHERE regexp_matches(text, '!!')
  UNION ALL SELECT 'emphasis', 'hash' FROM documents WHERE regexp_matches(text, '###')
  UNION ALL SELECT 'contact', 'mail' FROM documents WHERE regexp_matches(text, '@')
  UNION ALL SELECT 'contact', 'phone' FROM documents WHERE regexp_matches(text, '\\+[0-9]')), {DRIFT_SQL}"""
)
def drift_dialects(spark, sf):
    """Convention drift: one regular expression a dialect, a text may use several."""
    d = table(spark, sf, "documents")
    t = F.col("text")
    dialects = (("list", "pipe", r" \| "), ("list", "comma", ", "), ("emphasis", "shout", "!!"), ("emphasis", "hash", "###"), ("contact", "mail", "@"), ("contact", "phone", r"\+[0-9]"))
    hits = F.array(*[F.when(t.rlike(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("dialect"))) for c, n, p in dialects])
    return compare.drift(d.select(F.explode(F.array_compact(hits)).alias("x")).select("x.*"))


@query(
    """SELECT p_name AS key, count(DISTINCT p_type) AS n_values, count(*) AS n_sites, arg_min(p_type, p_partkey) AS first_value FROM part GROUP BY 1 HAVING count(DISTINCT p_type) >= 2"""
)
def conflict_part_types(spark, sf):
    """One setting, several values."""
    return compare.conflicting(table(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("value"), F.col("p_partkey").alias("seq")))


@query(
    """SELECT user_id AS grp, count(*) FILTER (event_type IN ('click', 'purchase')) AS n_a, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS n_b FROM events GROUP BY 1
HAVING least(n_a, n_b) >= 2 AND least(n_a, n_b) >= 0.15 * (n_a + n_b)"""
)
def two_population_split(spark, sf):
    return compare.split_population(table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_type").isin("click", "purchase").alias("side")))


WEIGHT_SQL = "CASE WHEN kind IN ('contradiction', 'unfinished') THEN score * 4 ELSE score * log2(loc + 2) END"
SEVERITY_SQL = f"""CASE WHEN kind = 'contradiction' THEN CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END
  WHEN kind = 'unfinished' THEN CASE WHEN score >= 0.5 THEN 'medium' ELSE 'low' END
  WHEN {WEIGHT_SQL} >= 3.5 THEN 'high' WHEN {WEIGHT_SQL} >= 1.8 THEN 'medium' ELSE 'low' END"""


@query(f"WITH {FINDINGS_SQL} SELECT id, kind, {SEVERITY_SQL} AS severity, floor({WEIGHT_SQL} * 1000 + 0.5) / 1000 AS weight FROM findings ORDER BY weight DESC, id LIMIT 20")
def rank_topk(spark, sf):
    """The worklist: the twenty heaviest findings."""
    return compare.rank(S.findings(spark, sf), 20)


@query(f"WITH {FINDINGS_SQL} SELECT kind, {SEVERITY_SQL} AS severity, count(*) AS n FROM findings GROUP BY ALL")
def severity(spark, sf):
    f = S.findings(spark, sf)
    return f.groupBy("kind", compare.severity(F.col("kind"), F.col("score"), F.col("loc")).alias("severity")).agg(F.count("*").alias("n"))


HEAD_SQL = """coalesce(sum(loc) FILTER (kind = 'dead' AND score >= 0.5), 0)::BIGINT AS dead_loc, coalesce(sum(loc) FILTER (kind = 'duplicate' AND score >= 0.5), 0)::BIGINT AS duplicate_loc,
  count(*) FILTER (kind = 'drift') AS drift_count, count(*) FILTER (kind = 'contradiction') AS contradiction_count, count(*) FILTER (kind = 'unfinished' AND score >= 0.5) AS unfinished_count"""
KEPT_SQL = "SELECT * FROM findings WHERE id NOT IN (SELECT 'p' || doc_id FROM labels WHERE toxic = 1)"


def _kept(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select(key("p", "doc_id").alias("id"))
    return S.findings(spark, sf).join(gone, "id", "left_anti")


@query(f"WITH {FINDINGS_SQL} SELECT {HEAD_SQL} FROM findings")
def headline_stats(spark, sf):
    return compare.headline(S.findings(spark, sf))


@query(
    f"""WITH {FINDINGS_SQL}, a AS (SELECT {HEAD_SQL} FROM findings), b AS (SELECT {HEAD_SQL} FROM ({KEPT_SQL}))
SELECT a.dead_loc - b.dead_loc AS dead_loc, a.duplicate_loc - b.duplicate_loc AS duplicate_loc, a.drift_count - b.drift_count AS drift_count,
  a.contradiction_count - b.contradiction_count AS contradiction_count, a.unfinished_count - b.unfinished_count AS unfinished_count FROM a, b"""
)
def headline_delta(spark, sf):
    """What dismissals took off the headline."""
    return compare.headline_delta(S.findings(spark, sf), _kept(spark, sf))


@query(
    f"""WITH {FINDINGS_SQL}, a AS (SELECT {HEAD_SQL} FROM findings), b AS (SELECT {HEAD_SQL} FROM ({KEPT_SQL}))
SELECT 'dead_loc' AS metric, b.dead_loc AS was, a.dead_loc AS now, a.dead_loc > b.dead_loc AS failed FROM a, b
UNION ALL SELECT 'duplicate_loc', b.duplicate_loc, a.duplicate_loc, a.duplicate_loc > b.duplicate_loc FROM a, b
UNION ALL SELECT 'drift_count', b.drift_count, a.drift_count, a.drift_count > b.drift_count FROM a, b
UNION ALL SELECT 'contradiction_count', b.contradiction_count, a.contradiction_count, a.contradiction_count > b.contradiction_count FROM a, b
UNION ALL SELECT 'unfinished_count', a.unfinished_count, a.unfinished_count, false FROM a"""
)
def budget_ratchet(spark, sf):
    """The budget fails on growth only; a metric that it lacks is met."""
    budget = compare.headline(_kept(spark, sf)).withColumn("unfinished_count", F.lit(None).cast("long"))
    return compare.ratchet(compare.headline(S.findings(spark, sf)), budget)


@query(f"WITH {FINDINGS_SQL} SELECT id, kind, score FROM ({KEPT_SQL})")
def dismissed_anti(spark, sf):
    return _kept(spark, sf).select("id", "kind", "score")


MEMBERS_SQL = "SELECT p_name || ':' || kind AS id, kind, findings.id AS member, file, loc FROM findings JOIN part ON findings.id = 'p' || p_partkey"


@query(
    f"""WITH {FINDINGS_SQL}, members AS ({MEMBERS_SQL}), cover AS (SELECT DISTINCT file, kind FROM findings WHERE score > 0.9
), s AS (SELECT id, m.kind, count(*) AS n, count(*) FILTER (c.file IS NULL) AS kept, coalesce(sum(loc) FILTER (c.file IS NULL), 0)::BIGINT AS loc
  FROM members m LEFT JOIN cover c ON c.file = m.file AND c.kind = m.kind GROUP BY 1, 2)
SELECT id, kind, kept AS members, loc FROM s WHERE CASE WHEN kind IN ('duplicate', 'drift', 'contradiction') THEN kept >= least(2, n) ELSE kept = n END"""
)
def ignores_member_anti(spark, sf):
    """Ignore directives: members go, groups shrink, other findings go whole."""
    f = S.findings(spark, sf)
    names = table(spark, sf, "part").select(key("p", "p_partkey").alias("pid"), "p_name")
    members = f.join(names, f["id"] == names["pid"]).select(F.concat_ws(":", "p_name", "kind").alias("id"), "kind", F.col("pid").alias("member"), "file", "loc")
    return compare.apply_ignores(members, f.where("score > 0.9").select("file", "kind"))


# -- ranges, time, paths -----------------------------------------------------------


@query(
    f"""WITH {RANGES_SQL}, {SITES_SQL} SELECT site, arg_max(seq, (line - seq / 1e12)) AS seq FROM (
  SELECT s.site, r.seq, r.line FROM sites s JOIN ranges r ON r.file = s.file AND s.line BETWEEN r.line AND r.end_line) GROUP BY 1"""
)
def innermost_range(spark, sf):
    """The innermost symbol around each site."""
    return spans.innermost(S.ranges(spark, sf), S.sites(spark, sf))


@query(
    f"""WITH {RANGES_SQL}, {SITES_SQL} SELECT file, count(*) AS executed FROM ranges r
WHERE EXISTS (SELECT 1 FROM sites s WHERE s.file = r.file AND s.line BETWEEN r.line AND r.end_line) GROUP BY 1"""
)
def coverage_semi(spark, sf):
    """Symbols with an executed line, by file."""
    return spans.executed(S.ranges(spark, sf), S.sites(spark, sf)).groupBy("file").agg(F.count("*").alias("executed"))


@query(
    """WITH lines AS (SELECT DISTINCT l_orderkey AS file, unnest(range(1, 13)) AS line FROM lineitem
), painters AS (SELECT l_orderkey AS file, l_linenumber * 10 + 3 AS start, l_linenumber * 10 + trunc(l_quantity)::INT AS stop, l_tax > 0.03 AS hit, l_linenumber::BIGINT * 1000000000 + l_partkey AS seq FROM lineitem
), a AS (SELECT l.file, l.line, p.hit, row_number() OVER (PARTITION BY l.file, l.line ORDER BY stop - start, seq DESC) AS r
  FROM lines l JOIN painters p ON p.file = l.file AND start <= line * 10 + 9 AND stop >= line * 10 AND (hit OR (start <= line * 10 AND stop >= line * 10 + 9)))
SELECT file, count(*) FILTER (hit) AS executed, count(*) AS painted FROM a WHERE r = 1 GROUP BY 1"""
)
def v8_paint(spark, sf):
    """Byte ranges over lines: the narrowest applicable range decides."""
    li = table(spark, sf, "lineitem")
    lines = li.select(F.col("l_orderkey").alias("file")).distinct().select("file", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("line"))
    lines = lines.withColumn("line_start", F.col("line") * 10).withColumn("line_stop", F.col("line") * 10 + 9)
    at = F.col("l_linenumber") * 10
    painters = li.select(F.col("l_orderkey").alias("file"), (at + 3).alias("start"), (at + F.col("l_quantity").cast("int")).alias("stop"), (F.col("l_tax") > 0.03).alias("hit"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("seq"))
    done = spans.paint(lines, painters)
    return done.groupBy("file").agg(F.count_if("executed").alias("executed"), F.count("*").alias("painted"))


@query(
    f"""WITH {SITES_SQL} SELECT file, count(*) AS lines FROM (
  SELECT s.file, s.line FROM sites s JOIN events e ON e.event_id = site WHERE event_type = 'click' UNION SELECT s.file, s.line FROM sites s JOIN events e ON e.event_id = site WHERE event_type = 'view') GROUP BY 1"""
)
def coverage_union(spark, sf):
    """Several coverage reports: the union of their lines."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("site"), "event_type")
    at = S.sites(spark, sf).join(e, "site")
    one = lambda kind: at.where(F.col("event_type") == kind).select("file", "line")
    return one("click").union(one("view")).distinct().groupBy("file").agg(F.count("*").alias("lines"))


@query(
    """WITH c AS (SELECT event_id AS sha, ts AS stamp FROM events WHERE event_type = 'signup'
), grid AS (SELECT unnest(generate_series(date_trunc('day', (SELECT min(stamp) FROM c)), (SELECT max(stamp) FROM c), INTERVAL 8 HOUR)) AS instant
), hit AS (SELECT instant, (SELECT arg_max(sha, stamp) FROM c WHERE stamp <= instant) AS sha FROM grid)
SELECT hit.sha, c.stamp, min(instant) AS instant FROM hit JOIN c USING (sha) GROUP BY 1, 2"""
)
def asof_commits(spark, sf):
    """The last commit at or before each point of a grid."""
    c = S.commits(spark, sf)
    grid = c.agg(F.date_trunc("day", F.min("stamp")).alias("a"), F.max("stamp").alias("b"))
    kind = c.schema["stamp"].dataType
    grid = grid.select(F.explode(F.sequence(F.col("a").cast(kind), F.col("b").cast(kind), F.expr("INTERVAL 8 HOURS"))).alias("instant"))
    return spans.asof(grid, c)


@query(
    """SELECT event_type AS metric, arg_min(value, ts) AS first, arg_max(value, ts) AS last, floor((arg_max(value, ts) - arg_min(value, ts)) * 100 + 0.5) / 100 AS delta FROM events GROUP BY 1"""
)
def trend_summary(spark, sf):
    """First, last and change of each metric over time."""
    return compare.trend_summary(table(spark, sf, "events").select(F.col("event_type").alias("metric"), F.col("ts").alias("at"), "value"))


PATH_SQL = r"regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '')"


@query(
    f"""WITH f AS (SELECT string_split({PATH_SQL}, '/') AS parts, length(html)::BIGINT AS value, page_id % 10 AS heat FROM pages
), up AS (SELECT array_to_string(parts[1:i], '/') AS folder, value, heat FROM (SELECT *, unnest(range(0, len(parts))) AS i FROM f))
SELECT folder, count(*) AS files, sum(value)::BIGINT AS value, floor(sum(heat * value)::DOUBLE / sum(value)::DOUBLE * 100 + 0.5) / 100 AS heat FROM up GROUP BY 1"""
)
def folder_rollup(spark, sf):
    """Sizes and size-weighted heat of every folder."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "")
    return spans.roll_up(table(spark, sf, "pages").select(path.alias("path"), F.length("html").cast("long").alias("value"), (F.col("page_id") % 10).alias("heat")))


# -- lookup ----------------------------------------------------------------------


@query(
    """WITH m(module) AS (VALUES ('example'), ('example.com'), ('example.com/en'), ('example.com/de'), ('example.org'), ('example.org/en/1')
), p AS (SELECT page_id, regexp_extract(url, '(example\\.[^?#]*)', 1) AS path FROM pages)
SELECT page_id, arg_max(module, length(module)) AS module FROM p JOIN m ON starts_with(path, module) GROUP BY 1"""
)
def longest_prefix_import(spark, sf):
    """Imports go to the longest module path that starts them."""
    modules = spark.range(1).select(F.explode(F.array(*map(F.lit, ("example", "example.com", "example.com/en", "example.com/de", "example.org", "example.org/en/1")))).alias("module"))
    paths = table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.regexp_extract("url", r"(example\.[^?#]*)", 1).alias("path"))
    return lookup.longest_prefix(paths, modules).withColumnRenamed("key", "page_id")


@query(
    f"""WITH {BAG_SQL}, req AS (
  SELECT item_id, term, count(*) AS w FROM (SELECT item_id, unnest({WORDS_SQL}) AS term FROM benchmark)
  WHERE length(term) >= 2 AND term NOT IN ({STOP_SQL}) GROUP BY 1, 2
), names AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM symbols), nn AS (SELECT id, count(*) AS n FROM names GROUP BY 1
), s AS (SELECT r.item_id, b.id, sum(r.w * b.w) AS dot, count(n.term) AS shared FROM req r JOIN bag b USING (term) LEFT JOIN names n ON n.id = b.id AND n.term = r.term GROUP BY 1, 2
), scored AS (SELECT item_id, s.id, floor((0.7 * dot / (sqrt(rn) * sqrt(bn)) + 0.3 * shared / greatest(coalesce(nn.n, 0), 1)) * 10000 + 0.5) / 10000 AS score
  FROM s JOIN (SELECT item_id, sum(w * w) AS rn FROM req GROUP BY 1) USING (item_id) JOIN (SELECT id, sum(w * w) AS bn FROM bag GROUP BY 1) b ON b.id = s.id LEFT JOIN nn ON nn.id = s.id)
SELECT item_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place, max(score) OVER (PARTITION BY item_id) AS best FROM scored WHERE score > 0.15)
WHERE place <= 5 AND best >= 0.3"""
)
def check_before_writing(spark, sf):
    """For each described need, the five symbols most like it."""
    needs = table(spark, sf, "benchmark").select(F.col("item_id").alias("need"), "text")
    return lookup.similar_code(S.symbols(spark, sf), needs).withColumnRenamed("need", "item_id")


@query(
    """SELECT conv_id, turn, (contains(lower(text), 'the') AND length(text) > 0)::INT + contains(lower(text), 'thing')::INT + CASE WHEN role = 'system' THEN 0.5 ELSE 0 END::DOUBLE AS score FROM conversations
WHERE contains(lower(text), 'the') OR contains(lower(text), 'thing') ORDER BY score DESC, conv_id, turn LIMIT 10"""
)
def intent_search(spark, sf):
    """Purposes that hold the words asked for, confirmed ones first (a top-10 report)."""
    told = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("symbol"), F.col("text").alias("purpose"), F.coalesce(F.col("role") == "system", F.lit(False)).alias("confirmed"))
    return lookup.intent_search(told, ("the", "thing")).select("symbol.conv_id", "symbol.turn", "score")


@query(r"""SELECT page_id, i AS place, length(s[i]) AS n_chars, md5(s[i]) AS script FROM (
  SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>', 1) AS s FROM pages))""")
def inline_scripts(spark, sf):
    """Script bodies of pages."""
    out = T.script_bodies(table(spark, sf, "pages").select("page_id", "html"), "html")
    return out.select("page_id", (F.col("place") + 1).cast("long").alias("place"), F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("script"))


@query(rf"SELECT page_id, path FROM (SELECT page_id, {PATH_SQL} AS path FROM pages) WHERE regexp_matches(path, '^([^/]*/)*(en|de)/[0-9][^/]*$')")
def glob_filter(spark, sf):
    """Paths that match a glob."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path")).where(F.col("path").rlike(T.glob_regex("**/{en,de}/[0-9]*")))


@query(
    f"""WITH {SYMBOLS_SQL}, q AS (SELECT 'THE AND' AS q) SELECT id, CASE WHEN id = q OR name = q THEN 0 WHEN lower(name) = lower(q) THEN 1 ELSE 2 END AS how FROM symbols, q
WHERE id = q OR lower(name) = lower(q) OR contains(lower(name), lower(q)) ORDER BY how, id LIMIT 8"""
)
def symbol_lookup(spark, sf):
    """A name in any case, else names that hold it (at most eight)."""
    return lookup.find_symbol(S.symbols(spark, sf), "THE AND")


def _passes(n: int) -> str:
    """The passes of label propagation, one after the other."""
    votes = "SELECT id, concept, sum(w) AS w FROM (SELECT b.id, l.concept, 1.0::DOUBLE AS w FROM ways b JOIN l{0} l ON l.id = b.other UNION ALL SELECT id, concept, 0.5 FROM l{0}) GROUP BY 1, 2"
    one = "l{1} AS MATERIALIZED (SELECT id, concept FROM (" + votes + ") WHERE id IN (SELECT id FROM sym) QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, concept) = 1)"
    return ", ".join(one.format(i, i + 1) for i in range(n))


@query(
    f"""WITH {EDGES_SQL}, sym AS (
  SELECT 'c' || c_custkey AS id, c_custkey AS seq, 'n' || c_nationkey AS dir FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderkey + 1000000000, o_orderpriority FROM orders
), ways AS (SELECT src AS id, dst AS other FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst
), l0 AS MATERIALIZED (SELECT id, min(seq) OVER (PARTITION BY dir) AS concept FROM sym), {_passes(5)} SELECT id, concept FROM l5"""
)
def concept_labels(spark, sf):
    """Concepts by synchronous label propagation over customers and their orders, seeded by nation."""
    own = table(spark, sf, "customer").select(key("c", "c_custkey").alias("id"), F.col("c_custkey").alias("seq"), key("n", "c_nationkey").alias("dir"))
    orders = table(spark, sf, "orders").select(key("o", "o_orderkey").alias("id"), (F.col("o_orderkey") + 1000000000).alias("seq"), F.col("o_orderpriority").alias("dir"))
    return concepts.scale_labels(own.unionByName(orders), S.edges(spark, sf), Stage(spark))


from graphloom.plans import code_queries  # noqa: E402, F401  (registers the queries that scan code)
