"""The queries of this subpackage over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vastlin.llm import bpe, decontaminate, jaccard, language, passages, pii, quality, simhash, suffix_tree, templates
from vastlin.llm.shared import small_batches

#: A public tokenizer file, found through its package so that every executor resolves its own copy.
WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.both_sides(passages.passages(table(spark, sf_dir, "documents")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.clean(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_passages": op1_passages,
    "op2_language": op2_language,
    "op3_templates": op3_templates,
    "op4_jaccard": op4_jaccard,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op4_jaccard": jaccard.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op7_simhash": simhash.ORACLE}
