"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokens. See README.md."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, mixing, pii, quality, simhash
from scriptorium.session import prepared, removed, shared_folder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps; what it rejects goes.

    Null and empty texts have log weight 0 and are drawn like others; a text counts whole, however long. Of rows that are tied
    with the last one kept all stay; repeated rows share their key's noise and stay or go together, if their texts are
    equal. A null doc_id is a key. Other columns may be null or have any name. An empty table, or labels of one kind only: all
    stay.
    """
    prepared(spark)
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Null and empty texts are copies of each other; texts of fewer than five words are one shingle; long ones count whole. A
    null doc_id comes last. Ties (equal doc_ids) go by the text's hash, and of repeated rows one stays. Other columns may be
    null or have any name; an empty table stays empty.
    """
    prepared(spark)
    return simhash.distinct_texts(docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text.

    A null text stays null, an empty one empty, a long one is searched whole; a null n_chars stays null. Repeated rows are each
    redacted alike. Of overlapping spans the first and longest counts. Other columns aren't touched, whatever their names; an
    empty table stays empty.
    """
    prepared(spark)
    length = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return pii.redact(docs, pii.fitted(docs)).withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that sources come to their target weights.

    Null and empty texts have no words and are not taken; long ones count by their words. Null sources are one source, the
    last; null doc_ids are a key. Ties in the shuffled line go by the columns; repeated rows are one row with all their copies.
    Other columns may be null or have any name; an empty table stays empty.
    """
    prepared(spark)
    return mixing.mixed_rows(docs, "doc_id")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text and their number.

    A null or empty text has no ids and 0 as their number. Repeated rows and ties are encoded each, long texts whole; doc_id,
    lang and source may be null; other columns are left out. An empty table gives none.
    """
    prepared(spark)
    encoded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), ["doc_id", "lang", "source"])
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("personal_data", redact_personal),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]
#: No SQL expresses the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)  # nothing reads it any more
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
