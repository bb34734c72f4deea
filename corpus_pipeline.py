"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last returns tokens' digests.
Stages cope with nulls, empty tables and repeated rows as their operators do (see their docstrings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vastlin.llm import bpe, decontaminate, jaccard, language, templates
from vastlin.llm.queries import table, tokenizer_path
from vastlin.llm.shared import boxed, checkpointed, small_batches, unboxed


#: A language is taken only if it is likelier than all others together.
LEAST_POSTERIOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier gives no language: without a letter (a null text too), or with a posterior below ``LEAST_POSTERIOR``.

    Where no language can be learned, as all labels are null, documents stay.
    """
    small_batches(spark)
    model = language.train(docs.where(~language.held_out()))
    if not model.languages:
        return docs
    found = language.predict(boxed(docs, "text"), model, "_text")
    return unboxed(found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR)), docs.columns, text=F.col("_text"))


def _resized(docs: DataFrame, names: list[str]) -> DataFrame:
    return (docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else docs).select(*names)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines of recurring templates, but for their first document; a document that is left with nothing goes."""
    small_batches(spark)
    names = docs.columns
    cut = templates.dedup_lines(boxed(docs, "text", "text", doc_id=F.col("doc_id")))
    cut = cut.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return _resized(unboxed(cut, names, text=F.col("text")), names)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: of smallest id, and of rows that share it the one of smallest text hash.

    Rows without an id stay. Rows that share an id are told apart by their texts, so one of them goes only with its own component;
    of rows that share both one stays.
    """
    small_batches(spark)
    rows = boxed(docs, "text", "text", doc_id=F.col("doc_id"))
    identity = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    found = checkpointed(jaccard.join(rows.select(identity.alias("_id"), "text"), key="_id").where("_id.doc_id is not null"))
    gone = found.where("component_id <> _id").select("_id").distinct()
    again = found.groupBy("_id").agg(F.count("*").alias("rows")).where("rows > 1").select("_id")
    left = rows.withColumn("_id", identity).join(gone, "_id", "left_anti")
    if not again.isEmpty():
        left = left.join(again, "_id", "left_anti").unionByName(left.join(again, "_id", "left_semi").dropDuplicates(["_id"]))
    return unboxed(left, docs.columns, text=F.col("text"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the spans of benchmark windows from the texts."""
    small_batches(spark)
    return _resized(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes; the digests of both, per document."""
    small_batches(spark)
    return bpe.digest(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("BPE encoding and decoding", encode),
]

#: Language ID, line templates and tokens can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
