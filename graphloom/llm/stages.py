"""The stages of the corpus pipeline: (spark, docs, sf_dir) to the rows that go on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, neardup, pii, toxicity
from graphloom.plans.columns import fresh, quoted

THRESHOLD = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold, all their columns.

    Null and empty texts have no clause and stay, repeated rows are judged alike,
    an empty table gives none. Columns of any name, ``score`` too, stay as they are.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "score")
    scored = toxicity.score_documents(docs, model, score=score)
    return scored.where(F.col(score) < THRESHOLD).select(*quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, see ``neardup.drop_near_copies``.

    Null and empty texts are copies of each other, repeated rows too; rows without
    an id lose exact copies only. Columns of any name stay; an empty table gives no row.
    """
    return neardup.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, all their columns.

    Null and empty texts have no passage and stay, as do rows without an id, which
    name no pair; rows of one id go together. An empty table gives none.
    """
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*quoted(docs.columns))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by ``[KIND]``; n_chars follows the text.

    Null texts stay null; rows without a span stay as they are, repeated rows
    too. Columns of any other name stay; an empty table gives none.
    """
    base, spans = fresh(docs, "base", "spans")
    found = pii.find_pii(docs, base=base, spans=spans)
    text = pii.redact(F.col("text"), spans)
    n_chars = F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": n_chars}
    return found.select(*[new[c].alias(c) if c in new else col for c, col in zip(docs.columns, quoted(docs.columns), strict=True)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the digests of its token ids and of their decoding.

    Null texts count as empty, repeated rows stay, an empty table gives none.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
