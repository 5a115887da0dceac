"""A training corpus from raw documents: five stages, each over all that the one before has kept.

toxicity       documents that score TOXIC or more go (learned from the labelled rows of the table `labels`)
line_dedup     later copies of runs of lines go; so does a document of which nothing is left by that
near_dedup     of each group of near copies (five words, similarity 0.8) the one with the least doc_id stays
decontaminate  documents that hold a passage within the error budget of a benchmark item go
byte_bpe       doc_id, n_tokens, ids, decoded_sha256 of each document

Every stage but the last returns the columns of documents, any others of the table with them. Null and empty texts
pass through all of them, and so do rows without a doc_id unless their own text is rejected. Each row is judged by
its own text: of a doc_id with several texts only those go that a stage rejects, and rows that repeat fare alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from waymark.llm.common import fresh, nested, small, stored, table

TOXIC = 0.7
ORACLE_SQL = None


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    name = fresh(docs, "toxicity")
    return toxicity.with_score(docs, model, name).where(F.col(name) < TOXIC).drop(name)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "deleted_lines")
    found, changed = line_dedup.dedup(docs, name=name), F.size(F.col(name)) > 0
    found = found.where(~changed | (F.btrim("text", F.lit(" \t\n\r\f\u000b")) != ""))
    return found.select(*(F.when(changed, F.length("text")).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = near_dedup.cluster(docs, width=5, least=80, tables=16, hashes=True).where(~F.col("kept")).select("doc_id", "h").distinct()
    copies = small(stored(copies, "copies"), 24).select(F.col("doc_id").alias("_wm_d"), F.col("h").alias("_wm_h"))
    same = (F.col("row.doc_id").cast("long") == F.col("_wm_d")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("_wm_h"))
    return docs.select(nested(docs).alias("row")).join(copies, same, "left_anti").select("row.*")


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True).drop("ids_sha256")


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("byte_bpe", _byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
