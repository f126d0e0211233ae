"""The driver's queries over this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import fingerprints, infilling, language, mixing, neardup, negatives, packing, quality, redaction, suffixes, tokenizing, toxicity, twins, vectors
from tallyloom.llm.common import held_out, read_table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.digests(read_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(read_table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= model.cut).alias("toxic"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out()), read_table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = language.fit(docs.where(~held_out()))
    return language.predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in redaction.BASE]
    return found.select("doc_id", *counts, F.sha2(redaction.listed(base), 256).alias("base_sha256"), redaction.listed(F.col("spans")).alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fingerprints.neighbours(read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = infilling.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    back = infilling.restore(turned)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_ngram_jaccard, op3_packing, op4_toxicity, op5_quality, op6_language, op7_embeddings, op8_suffix_dedup, op9_pii, op10_fingerprints, op11_negatives, op12_infilling, op13_mixing)}


def oracle_sql() -> dict[str, str]:
    return twins.oracle_sql()
