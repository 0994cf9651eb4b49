"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Every stage takes all rows that the stage before kept, and keeps all columns. Null and empty texts, null ids, repeated rows, very long
texts, empty tables and further columns of any name pass through every stage; what a stage does with them is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, contamination, neardup, pii, toxicity
from sparkloom.llm.common import fresh, remove, shared_dir, staging
from sparkloom.llm.queries import read, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by a classifier fitted on the labelled ones among ``docs``.

    Null and empty texts get the score of a text without n-grams, equal texts equal scores. Rows with a null id do not train.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = fresh("toxicity", docs.columns)
    rated = toxicity.score(docs, model, score)
    return rated.where(rated[score] < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8).

    Texts without words (null, empty, blank) and rows with a null id all stay. Rows with the id that stays are all kept.
    """
    return neardup.drop_near_duplicates(docs, words=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``, each judged by its own text; null and empty texts stay."""
    return contamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by <KIND> and n_chars counted anew. Null texts stay null, equal texts stay equal."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document that is left; null texts count as empty."""
    return bpe.encode_documents(docs, tokenizer("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact_pii), ("bpe", encode)]

#: No stage can be stated in SQL; the tests hold every stage of run() against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder.

    What a stage staged is removed after it, and its input after the next one's is written; the last table stays, as the result reads it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/sparkloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return docs
