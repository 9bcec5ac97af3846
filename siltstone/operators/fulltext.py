"""Inverted index, Boolean and ranked search over documents (doc_id, document).

Document ids are distinct non-empty strings. Null documents are no documents; a
document without token counts as one of length 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.errors import Corrupted, InvalidInput
from siltstone.functions import bm25
from siltstone.functions.bm25 import Bm25Config
from siltstone.functions.text import checked_terms, with_tokens
from siltstone.sources.shared import stacked

MAX_LIMIT = 1000
#: Limits of one batch of documents.
MAX_BATCH_DOCUMENTS, MAX_BATCH_BYTES = 256, 4 << 20


@dataclass
class Index:
    """Tables derived from documents; a saved index also brings its sums."""

    documents: DataFrame  # doc_id, document
    lengths: DataFrame  # doc_id, doc_len, zero lengths included
    postings: DataFrame  # doc_id, term, tf, doc_len
    saved_frequencies: DataFrame | None = None
    saved_statistics: DataFrame | None = None

    @property
    def frequencies(self) -> DataFrame:
        """(term, df)."""
        if self.saved_frequencies is not None:
            return self.saved_frequencies
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def statistics(self) -> DataFrame:
        """One row (n, total): documents and the sum of their lengths."""
        if self.saved_statistics is not None:
            return self.saved_statistics
        return self.lengths.agg(
            F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total")
        )


def build(documents: DataFrame) -> Index:
    """The index of documents; nothing runs before it is queried."""
    docs = documents.where(F.col("document").isNotNull()).select("doc_id", "document")
    toks = with_tokens(docs, "document", "doc_id")
    doc_len = F.size("toks").cast("long").alias("doc_len")
    return Index(
        docs,
        toks.select("doc_id", doc_len),
        toks.select("doc_id", doc_len, F.explode("toks").alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len")),
    )


_SAVED = ("documents", "lengths", "postings")


def save(index: Index, folder: str) -> None:
    """Write an index so that a query reads no more than its terms and hits.

    Postings are range-partitioned and sorted by term, the other tables by document
    id: Parquet's statistics then leave only the row groups that hold them. The sums
    are taken from what was written.
    """
    spark = index.documents.sparkSession
    postings = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    postings.write.parquet(f"{folder}/postings")
    for name in ("documents", "lengths"):
        table = getattr(index, name).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        table.write.parquet(f"{folder}/{name}")
    written = Index(*[spark.read.parquet(f"{folder}/{n}") for n in _SAVED])
    written.frequencies.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/frequencies")
    written.statistics.write.parquet(f"{folder}/statistics")


def load(spark: SparkSession, folder: str) -> Index:
    """An index that ``save`` wrote."""
    return Index(*[spark.read.parquet(f"{folder}/{n}") for n in (*_SAVED, "frequencies", "statistics")])


def checked(spark, words: list[str], limit: int | None) -> list[str]:
    """Sorted distinct terms of a query, after the checks of its limit and its terms."""
    if limit is not None and limit > MAX_LIMIT:
        raise InvalidInput(f"the limit is more than {MAX_LIMIT}")
    if limit is not None and limit < 0:
        raise InvalidInput("the limit is negative")
    return checked_terms(spark, words)


def with_documents(documents: DataFrame, hits: DataFrame, limit: int | None) -> DataFrame:
    """``hits`` with their documents; a hit without document makes the query fail.

    The hits of a limited search are at most MAX_LIMIT short rows: their ids select the
    documents that are read at all. Without limit both sides meet in a shuffle.
    """
    if limit is not None:
        rows = hits.collect()
        hits = documents.sparkSession.createDataFrame(rows, hits.schema)
        documents = documents.where(F.col("doc_id").isin([r["doc_id"] for r in rows])) if rows else documents.limit(0)
    found = hits.join(documents.select("doc_id", "document", F.lit(True).alias("_there")), "doc_id", "left")
    lost = F.raise_error(F.concat(F.lit("a hit has no document: "), F.col("doc_id")))
    others = [c for c in hits.columns if c != "doc_id"]
    return found.select("doc_id", F.when(F.col("_there"), F.col("document")).otherwise(lost).alias("document"), *others)


def matching_ids(hits: DataFrame, terms: list[str], every: bool, limit: int | None) -> DataFrame:
    """(doc_id) of the documents that have all or any of the terms, the smallest ids if limited."""
    counted = hits.groupBy("doc_id").agg(F.count("*").alias("_n"))
    ids = counted.where(F.col("_n") >= (len(terms) if every else 1)).select("doc_id")
    return ids if limit is None else ids.orderBy("doc_id").limit(limit)


def search(index: Index, words: list[str], *, every: bool, limit: int | None = None) -> DataFrame:
    """(doc_id, document) of documents with all or any of the words, by doc_id."""
    terms = checked(index.documents.sparkSession, words, limit)
    hits = index.postings.where(F.col("term").isin(terms))
    return with_documents(index.documents, matching_ids(hits, terms, every, limit), limit).orderBy("doc_id")


def search_texts(documents: DataFrame, words: list[str], *, every: bool, limit: int | None = None) -> DataFrame:
    """Boolean search without an index: one scan, no shuffle but the final order."""
    terms = checked(documents.sparkSession, words, limit)
    cut = with_tokens(documents.where(F.col("document").isNotNull()), "document", "doc_id", "document")
    wanted = F.array(*map(F.lit, terms))
    need = F.size(F.array_intersect("toks", wanted)) == len(terms) if every else F.arrays_overlap("toks", wanted)
    found = cut.where(need).select("doc_id", "document").orderBy("doc_id")
    return found if limit is None else found.limit(limit)


def search_ranked(
    index: Index,
    words: list[str],
    *,
    every: bool,
    limit: int | None = None,
    config: Bm25Config = Bm25Config(),
) -> DataFrame:
    """(doc_id, document, score), score descending, then doc_id; the limit comes last.

    A score is the sum of the terms' contributions in ascending term order from 0.0.
    An empty corpus, or one without any token, gives no rows.
    """
    terms = checked(index.documents.sparkSession, words, limit)
    stats = index.statistics.first()
    return rank_hits(
        index.postings.where(F.col("term").isin(terms)), index.documents, terms, stats["n"], stats["total"],
        every=every, limit=limit, config=config,
    )


def rank_hits(
    hits: DataFrame, documents: DataFrame, terms: list[str], n: int, total: int,
    *, every: bool, limit: int | None, config: Bm25Config,
) -> DataFrame:
    """The ranked result from the postings (doc_id, term, tf, doc_len) of the terms."""
    none = documents.select("doc_id", "document").limit(0).withColumn("score", F.lit(0.0))
    if not n or not total:
        return none
    dfs = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
    if any(df > n for df in dfs.values()):
        raise Corrupted("a term is in more documents than there are")
    if not dfs or (every and len(dfs) < len(terms)):
        return none
    table = F.create_map(*[F.lit(x) for pair in sorted(dfs.items()) for x in pair])
    part = bm25.contribution(
        bm25.idf(F.lit(n), table[F.col("term")]), F.col("tf"), F.col("doc_len"),
        F.lit(total / n), F.lit(float(config.k1)), F.lit(float(config.b)),
    )
    scored = (
        hits.select("doc_id", F.struct("term", part.alias("c")).alias("p"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list("p")).alias("parts"))
        .where(F.size("parts") >= (len(terms) if every else 1))
        .select("doc_id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["c"]).alias("score"))
    )
    order = [F.desc("score"), F.asc("doc_id")]
    if limit is not None:
        scored = scored.orderBy(*order).limit(limit)
    return with_documents(documents, scored, limit).orderBy(*order)


def _occurrences(toks: str, term: str):
    return F.size(F.filter(toks, lambda x: x == F.lit(term)))


def rank_texts(
    documents: DataFrame,
    words: list[str],
    *,
    every: bool,
    limit: int | None = None,
    config: Bm25Config = Bm25Config(),
) -> DataFrame:
    """Ranked search without an index, in two scans and no shuffle of documents.

    The first scan counts documents, tokens and the documents of each query term;
    the second scores every document in place. Same rows as ``search_ranked``.
    """
    terms = checked(documents.sparkSession, words, limit)
    base = with_tokens(documents.where(F.col("document").isNotNull()), "document", "doc_id", "document")
    stats = base.agg(
        F.count("*").alias("n"),
        F.sum(F.size("toks").cast("long")).alias("total"),
        *[F.count(F.when(F.array_contains("toks", t), 1)).alias(f"df{i}") for i, t in enumerate(terms)],
    ).first()
    n, total = stats["n"], stats["total"]
    if not n or not total:
        return base.select("doc_id", "document").limit(0).withColumn("score", F.lit(0.0))
    counted = base.select(
        "doc_id", "document", F.size("toks").alias("dl"),
        *[_occurrences("toks", t).alias(f"tf{i}") for i, t in enumerate(terms)],
    )
    score, have = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        part = bm25.contribution(
            bm25.idf(F.lit(n), F.lit(stats[f"df{i}"])), tf, F.col("dl"), F.lit(total / n),
            F.lit(float(config.k1)), F.lit(float(config.b)),
        )
        score = F.when(tf > 0, score + part).otherwise(score)
        have = have + F.when(tf > 0, 1).otherwise(0)
    found = counted.where(have == len(terms) if every else have > 0)
    ranked = found.select("doc_id", "document", score.alias("score")).orderBy(
        F.desc("score"), F.asc("doc_id")
    )
    return ranked if limit is None else ranked.limit(limit)


def checked_documents(batch: list[tuple[str, bytes]]) -> list[tuple[str, str]]:
    """A batch of documents after all its checks; the last of equal ids stays.

    Sizes are those of the raw input. One bad id or text refuses the whole batch.
    """
    if len(batch) > MAX_BATCH_DOCUMENTS:
        raise InvalidInput(f"a batch holds at most {MAX_BATCH_DOCUMENTS} documents")
    if sum(len(i.encode()) + len(d) for i, d in batch) > MAX_BATCH_BYTES:
        raise InvalidInput(f"a batch holds at most {MAX_BATCH_BYTES} bytes")
    last: dict[str, str] = {}
    for doc_id, data in batch:
        if not doc_id:
            raise InvalidInput("a document id must not be empty")
        try:
            last[doc_id] = data.decode("utf-8")
        except UnicodeDecodeError as e:
            raise InvalidInput(f"document {doc_id!r} is not UTF-8") from e
    return list(last.items())


def apply_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents after changes (pos, doc_id, document): the last of an id holds, null deletes."""
    newest = W.partitionBy("doc_id").orderBy(F.desc("pos"))
    last = (
        changes.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("doc_id", "document")
    )
    kept = documents.select("doc_id", "document").join(last.select("doc_id"), "doc_id", "left_anti")
    return stacked(kept, last.where(F.col("document").isNotNull()))


def apply_delta(index: Index, changes: DataFrame) -> Index:
    """The index after changes (pos, doc_id, document), only changed documents being analysed."""
    newest = W.partitionBy("doc_id").orderBy(F.desc("pos"))
    last = (
        changes.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("doc_id", "document")
    )
    fresh = build(last)
    ids = last.select("doc_id")
    return Index(
        apply_documents(index.documents, changes),
        stacked(index.lengths.join(ids, "doc_id", "left_anti"), fresh.lengths),
        stacked(index.postings.join(ids, "doc_id", "left_anti").select(*fresh.postings.columns), fresh.postings),
    )


def frequency_delta(index: Index, changes: DataFrame) -> DataFrame:
    """(term, delta): how document frequencies change, only terms that do."""
    after = apply_delta(index, changes)
    ids = changes.select("doc_id").distinct()
    old = index.postings.join(ids, "doc_id", "left_semi").select("term", F.lit(-1).alias("d"))
    new = after.postings.join(ids, "doc_id", "left_semi").select("term", F.lit(1).alias("d"))
    return (
        stacked(old, new).groupBy("term").agg(F.sum("d").alias("delta")).where(F.col("delta") != 0)
    )


def violations(index: Index) -> DataFrame:
    """(rule, doc_id, term): rows of the index that contradict its documents; none if it is sound."""
    truth = build(index.documents)
    wrong = (
        truth.postings.withColumnRenamed("tf", "want")
        .join(index.postings.withColumnRenamed("tf", "have"), ["doc_id", "term"], "full_outer")
        .where(~F.col("want").eqNullSafe(F.col("have")))
        .select(F.lit("posting").alias("rule"), "doc_id", "term")
    )
    lengths = (
        truth.lengths.withColumnRenamed("doc_len", "want")
        .join(index.lengths.withColumnRenamed("doc_len", "have"), "doc_id", "full_outer")
        .where(~F.col("want").eqNullSafe(F.col("have")))
        .select(F.lit("length").alias("rule"), "doc_id", F.lit(None).cast("string").alias("term"))
    )
    doubled = (
        index.documents.groupBy("doc_id").count().where("count > 1")
        .select(F.lit("document").alias("rule"), "doc_id", F.lit(None).cast("string").alias("term"))
    )
    return stacked(wrong, lengths, doubled)
