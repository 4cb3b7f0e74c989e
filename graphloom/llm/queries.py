"""The registered queries of this subpackage, and SQL for those SQL can express."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, chat, decontaminate, licenses, pii, simhash, suffixes, toxicity, urls
from graphloom.plans.staging import few_files


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_t(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _t(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_t(spark, sf_dir, "documents"), words_per_shingle=3)
    return out.select("doc_id", simhash.to_hex("fp").alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"),
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_t(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


#: The rules of the query, as (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_t(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hp AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM hp) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path
)
SELECT hp.page_id, hp.host, hp.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict
FROM hp LEFT JOIN hits USING (page_id)
"""


def op10_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.pair_neighbours(_t(spark, sf_dir, "conversations")))


OP10_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, conv_id, turn,
    coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t
), pairs AS (
  SELECT pair_id, min(conv_id) FILTER (chosen) AS chosen_conv, min(conv_id) FILTER (NOT chosen) AS rejected_conv FROM t GROUP BY 1
), lined AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
    coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM n WHERE chosen) a FULL JOIN (SELECT * FROM n WHERE NOT chosen) b ON a.pair_id = b.pair_id AND a.i = b.i
), lcp AS (
  SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n_prompt_turns FROM lined GROUP BY 1
), drawn AS (
  SELECT n.*, l.n_prompt_turns AS k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM n JOIN lcp l USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(CASE WHEN i > k THEN length(line) END) OVER (PARTITION BY conv_id ORDER BY i), 0) AS stop FROM drawn
), done AS (
  SELECT pair_id, chosen,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (i <= k), '') AS prompt,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (i > k), '') AS completion,
    coalesce(string_agg((stop - length(line) + 13 + length(role)) || ':' || stop, ',' ORDER BY i) FILTER (i > k AND role = 'assistant'), '') AS mask
  FROM placed GROUP BY 1, 2
)
SELECT p.pair_id, p.chosen_conv, p.rejected_conv, l.n_prompt_turns,
  coalesce(c.prompt, r.prompt) AS prompt, c.completion AS chosen, r.completion AS rejected,
  c.mask AS chosen_mask, r.mask AS rejected_mask
FROM pairs p JOIN lcp l USING (pair_id)
LEFT JOIN done c ON c.pair_id = p.pair_id AND c.chosen
LEFT JOIN done r ON r.pair_id = p.pair_id AND NOT r.chosen
"""

def _compact(query):
    """The query, its result in few files."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return few_files(query(spark, sf_dir))

    return run


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_nearest": op7_nearest,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_chat_preferences": op10_chat_preferences,
}

QUERIES = {name: _compact(query) for name, query in QUERIES.items()}

ORACLES = {"op9_url_filter": OP9_SQL, "op10_chat_preferences": OP10_SQL}
