"""The operators of this package as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import divergence, rules, variants
from panelforge.llm.shared import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.langid import predict

    return predict(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.warc import capture_index

    return capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.omh import edited_likeness

    return edited_likeness(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.pii import find

    return find(documents(spark, sf_dir))


def op9_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.media import media_features

    return media_features(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.substrings import dedup_report

    return dedup_report(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.quality import sampled

    return sampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.bpe import roundtrip

    return roundtrip(documents(spark, sf_dir), tokenizer_path())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.divergence import audited

    return audited(documents(spark, sf_dir))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.rules import judged

    return judged(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.variants import grouped

    return grouped(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_warc": op2_warc,
    "op3_order_minhash": op3_order_minhash,
    "op4_simhash": op4_simhash,
    "op5_suffix_array": op5_suffix_array,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_motion_jpeg": op9_motion_jpeg,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_rules": op12_quality_rules,
    "op13_spelling_variants": op13_spelling_variants,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_source_divergence": divergence.SQL, "op12_quality_rules": rules.SQL, "op13_spelling_variants": variants.SQL}
