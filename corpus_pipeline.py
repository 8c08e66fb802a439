"""A training corpus from `documents`: quality, near copies, repeated passages, personal data, packing.

Every stage works on all rows of its predecessor; run() writes each stage's rows as Parquet to the
shared folder and reads them again, as the driver does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import packing, pii, quality, simhash, substrings
from panelforge.llm.queries import tokenizer_path
from panelforge.llm.shared import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose importance weight the quality classifier keeps; rows with one doc_id (or none) stay or go together where any of them is kept.

    Null and empty texts have weight 0 like any other; ties, repeated rows, very long texts and empty tables as in
    quality.classified; all columns, whatever their names, stay as they are.
    """
    kept = quality.classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept"].cast("long")), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the least doc_id. Nulls, empty texts, ties, repeated rows and clashing columns as in simhash.one_of_each."""
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that a document with a smaller doc_id holds; null and empty texts, ties, repeated rows and other columns as in substrings.deduplicated."""
    return substrings.deduplicated(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; n_chars follows. Null texts stay null; repeated rows repeat; other columns stay; an empty table stays empty."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence that holds them; null and empty texts are one piece; ties, repeated rows and empty tables as in packing.pack; other columns end here."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("pii", mask_pii),
    ("packing", pack_sequences),
]

#: No stage after the first can be told in SQL (fingerprints, suffix arrays, token ids).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
