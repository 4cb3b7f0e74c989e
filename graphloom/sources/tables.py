"""Graph tables laid over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): region, nation, customer, order, part and supplier; a multiset."""
    t = lambda n: table(spark, sf_dir, n)
    link = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    return (
        link(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "imports")
        .unionByName(link(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "references"))
        .unionByName(link(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "calls"))
        .unionByName(link(t("lineitem"), key("o", "l_orderkey"), key("p", "l_partkey"), "calls"))
        .unionByName(link(t("lineitem"), key("o", "l_orderkey"), key("s", "l_suppkey"), "calls"))
    )


#: The same table in DuckDB SQL, for oracles.
EDGES_SQL = """edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'imports' AS kind FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'references' FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls' FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'calls' FROM lineitem
)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols: (id, seq, file, name, body, loc, lang)."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("#d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("seq"),
        F.col("source").alias("file"),
        F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ").alias("name"),
        F.col("text").alias("body"),
        (F.length(F.regexp_replace("text", r"[^\n]", "")) + 1).alias("loc"),
        "lang",
    )


SYMBOLS_SQL = r"""symbols AS (
  SELECT source || '#d' || doc_id AS id, doc_id AS seq, source AS file, text AS body,
    array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 3), ' ') AS name,
    length(regexp_replace(text, '[^\n]', '', 'g')) + 1 AS loc, lang
  FROM documents
)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings: (id, kind, score, loc, file)."""
    return table(spark, sf_dir, "part").select(
        key("p", "p_partkey").alias("id"),
        F.element_at(F.array(*map(F.lit, ("dead", "duplicate", "drift", "contradiction", "unfinished"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("kind"),
        (F.col("p_size") / 50.0).alias("score"),
        F.col("p_size").cast("int").alias("loc"),
        F.col("p_brand").alias("file"),
    )


FINDINGS_SQL = """findings AS (
  SELECT 'p' || p_partkey AS id,
    (['dead', 'duplicate', 'drift', 'contradiction', 'unfinished'])[(p_partkey % 5 + 1)::INT] AS kind,
    p_size / 50.0::DOUBLE AS score, p_size::INT AS loc, p_brand AS file
  FROM part
)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as line ranges of a file: (file, seq, line, end_line)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_linenumber").cast("long").alias("line"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int")).cast("long").alias("end_line"),
    )


RANGES_SQL = """ranges AS (
  SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS seq, l_linenumber::BIGINT AS line,
    (l_linenumber + trunc(l_quantity)::INT)::BIGINT AS end_line
  FROM lineitem
)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sites or executed lines: (file, line, site)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.get_json_object("props", "$.k").cast("long").alias("line"), F.col("event_id").alias("site")
    )


SITES_SQL = """sites AS (
  SELECT user_id AS file, json_extract_string(props, '$.k')::BIGINT AS line, event_id AS site FROM events
)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as commits: (sha, stamp)."""
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("sha"), F.col("ts").alias("stamp"))
