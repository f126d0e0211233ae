"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and read as the next one's input.

Toxic documents go, one of each group of near copies stays, repeated passages are cut, personal data is masked, and
what is left is packed into sequences. Every stage but the last returns the columns of `documents`, n_chars as it is
after the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import neardup, packing, redaction, suffixes, toxicity
from tallyloom.llm.common import Scratch, read_table
from tallyloom.llm.queries import vocabulary_path

#: Bytes of a passage that counts as repeated: some twenty words, so that common phrases stay.
PASSAGE = 120


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted to the labels of these documents, doesn't find toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, severity="__severity", chance="__toxic").where(F.col("__toxic") < model.cut).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join, that of least id; rows without a word stay."""
    return neardup.keep_one(docs, width=5, percent=80).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that an earlier document has are cut out; every row stays."""
    return suffixes.remove(docs, PASSAGE).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; every row stays."""
    return redaction.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard", keep_one_of_each_group), ("suffix_dedup", cut_repeats), ("pii", mask_personal_data), ("packing", pack_sequences)]
#: A fitted model, hashed sets and a tokeniser are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
