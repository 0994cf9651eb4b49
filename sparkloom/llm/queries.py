"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, contamination, drake, htmltext, lattice, merkle, neardup, pii, sketch, suffix, toxicity, urlrules
from .common import held_out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out("doc_id", 5)))
    rated = toxicity.score(docs.select("doc_id", "text"), model)
    return rated.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), held_out("doc_id", 10))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"), keep_text=True)


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=4)


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_columns(read(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.visible_text(read(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.PATTERNS), F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(read(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(read(spark, sf_dir, "documents")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edit_trial(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", sketch.fingerprint(F.col("sketch")).alias("fingerprint"), sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op13_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.clusters(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lm_scoring, op3_suffix_dedup, op4_minhash_forest, op5_audio_features, op6_html_text, op7_pii, op8_decontamination, op9_url_rules, op10_bpe, op11_merkle, op12_fingerprints, op13_drake_clusters)}

#: What SQL can state; the others are tested against brute force, round trips and held-out rows.
ORACLE_SQL = {"op9_url_rules": urlrules.SQL, "op11_merkle": merkle.SQL, "op13_drake_clusters": drake.SQL}
