"""Token ids, leaked passages and sentences of documents.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import encoding, leakage, sentences
from siltstone.sources.shared import checkpointed, read_table, spread, stacked


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encoding.encode_texts(_documents(spark, sf_dir))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids do not decode to their text; expected to be empty."""
    documents = _documents(spark, sf_dir)
    back = encoding.decode_ids(encoding.encode_texts(documents))
    return (
        back.withColumnRenamed("text", "decoded")
        .join(documents, "doc_id")
        .where(F.coalesce("text", F.lit("")) != F.col("decoded"))
        .select("doc_id")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 words in a row of an evaluation item."""
    return leakage.leaked(
        _documents(spark, sf_dir), read_table(spark, sf_dir, "eval_items")
    )


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked passages."""
    return leakage.cleaned(
        _documents(spark, sf_dir), read_table(spark, sf_dir, "eval_items")
    ).select("doc_id", F.size("items").alias("n_items"), "clean_text")


def p7_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether p7_cleaned and p7_found agree: documents with items, and those with an item left in."""
    documents, items = _documents(spark, sf_dir), read_table(spark, sf_dir, "eval_items")
    clean = checkpointed(leakage.cleaned(documents, items))
    found = leakage.leaked(documents, items).groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("found"))
    both = clean.join(found, "doc_id", "left")
    differs = ~F.coalesce("found", F.array().cast("array<bigint>")).eqNullSafe(F.col("items"))
    untouched = documents.join(clean, "doc_id").where((F.size("items") == 0) & ~F.col("text").eqNullSafe(F.col("clean_text")))
    rows = [
        both.where(differs).select("doc_id", F.lit("items differ").alias("rule")),
        untouched.select("doc_id", F.lit("text without leak was altered").alias("rule")),
    ]
    return stacked(*rows)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document with their places."""
    return sentences.sentence_units(_documents(spark, sf_dir))


QUERIES = {
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p7_counted": p7_counted,
    "p8_found": p8_found,
}
#: Both queries look for contradictions: the ids decode to the texts, and nothing is cut but leaks.
ORACLE_SQL = {
    "p6_round_trip": "select doc_id from documents where false",
    "p7_counted": "select doc_id, '' as rule from documents where false",
}
