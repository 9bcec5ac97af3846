"""How characteristic each term is of its record within the collection.

A record becomes a graph of words: its terms are nodes, an edge joins two different
terms that stand within a window of each other, and each token is a visit to its node.
A term's weight within the record is its degree, the number of its distinct
neighbours, so that a word repeated in one phrase gains little; or, as a setting, the
saturated number of its visits by BM25. Either is multiplied by the rarity of the term
in the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import InvalidInput
from siltstone.functions import bm25
from siltstone.functions.text import with_tokens
from siltstone.llm.terms import distinct_records
from siltstone.sources.shared import checkpointed, stacked

#: No more terms than this can hold more than 1/HEAVY_TERMS of all (record, term)
#: rows each, so the table of those that do is bounded whatever the data.
HEAVY_TERMS = 2_000
#: Stands between the two terms of an edge; no term holds it.
_BETWEEN = "\x00"


def graph_of_words(records: DataFrame, window: int = 4) -> DataFrame:
    """(id, dl, term, tf, degree): the nodes of each record's graph.

    ``tf`` is the number of visits to a node, ``degree`` the number of distinct terms
    that stand less than ``window`` places from it anywhere in the record, 0 where there
    are none. Records have distinct ids; one without term gives no row. A record's edges
    are listed once each where it lies, in time and space that grow with its length.
    """
    if window < 2:
        raise InvalidInput("a window holds at least two places")
    worded = with_tokens(records, "document", "id").where(F.size("toks") > 0)

    def at_distance(d: int) -> Column:
        n = F.greatest(F.size("toks") - d, F.lit(0))
        # an edge as one string, the smaller term first: sets of strings are hashed
        edge = lambda a, b: F.when(a < b, F.concat(a, F.lit(_BETWEEN), b)).when(a > b, F.concat(b, F.lit(_BETWEEN), a))
        return F.zip_with(F.slice("toks", 1, n), F.slice("toks", d + 1, n), edge)

    edges = F.array_compact(F.array_distinct(F.concat(*map(at_distance, range(1, window)))))
    parts = worded.select("id", "toks", F.explode_outer(F.array(edges)).alias("edges"))
    ends = F.flatten(F.transform("edges", lambda e: F.split(e, _BETWEEN)))
    seen = F.concat(
        F.transform("toks", lambda t: F.struct(t.alias("term"), F.lit(1).alias("visit"))),
        F.transform(ends, lambda t: F.struct(t.alias("term"), F.lit(0).alias("visit"))),
    )
    return (
        parts.select("id", F.size("toks").cast("long").alias("dl"), F.explode(seen).alias("s"))
        .groupBy("id", F.col("s.term").alias("term"))
        .agg(
            F.first("dl").alias("dl"),
            F.sum("s.visit").alias("tf"),
            F.sum(1 - F.col("s.visit")).alias("degree"),
        )
    )


def with_df(weights: DataFrame) -> DataFrame:
    """Rows of ``local_weights`` with df, the number of records that hold the term.

    Terms with a large share of all rows meet their df by a broadcast of bounded
    size instead of a shuffle; all other terms are small enough to be shuffled.
    """
    counts = checkpointed(weights.groupBy("term").agg(F.count("*").alias("df")))
    total = counts.agg(F.sum("df")).first()[0] or 0
    least = max(1, total // HEAVY_TERMS)
    heavy = counts.where(F.col("df") > least)
    marked = weights.join(F.broadcast(heavy), "term", "left")
    rest = (
        marked.where(F.col("df").isNull())
        .drop("df")
        .join(counts.where(F.col("df") <= least), "term")
    )
    return stacked(marked.where(F.col("df").isNotNull()), rest)


def record_terms(hits: DataFrame, window: int = 4) -> tuple[DataFrame, int, int]:
    """(id, dl, words) per record with terms; number of records; sum of their lengths.

    ``words`` is an array of (term, tf, degree, df) from the record's graph. Null ids and
    null documents make no record, documents without term count as records of length 0.
    """
    records = distinct_records(hits)
    nodes = checkpointed(graph_of_words(records, window))
    total = nodes.agg(F.sum("tf")).first()[0] or 0
    words = (
        with_df(nodes)
        .groupBy("id")
        .agg(
            F.first("dl").alias("dl"),
            F.collect_list(F.struct("term", "tf", "degree", "df")).alias("words"),
        )
    )
    return words, records.count(), int(total)


# The generators over these arrays are outer ones, though no array is empty: for
# others the optimiser adds a condition that computes every array twice.
def _top(scored: Column, k: int) -> Column:
    return F.slice(F.array_sort(scored), 1, k)


def top_terms(
    hits: DataFrame, configs: DataFrame | None = None, *, k: int = 3, window: int = 4
) -> DataFrame:
    """(id, place, term, tf, degree, weight): the k most characteristic terms per record.

    Without ``configs`` a term's weight is its degree times its rarity. With them it is
    BM25's contribution of its visits, and there is a ``config_id`` too: pairs of id and
    config_id come from ``hits``, each once; a setting that BM25 rejects or that is
    missing gives no rows. Of equal weights the smaller term in byte order comes first. A
    record without terms gives no rows.
    """
    words, n, total = record_terms(hits, window)
    if configs is None:
        weigh, keys, rows = lambda w: bm25.idf(F.lit(n), w["df"]) * w["degree"], ["id"], words
    else:
        settings = configs.select(
            "config_id", F.col("k1").cast("double").alias("k1"), F.col("b").cast("double").alias("b")
        ).where(bm25.accepted(F.col("k1"), F.col("b")))
        pairs = (
            hits.where(F.col("id").isNotNull() & F.col("config_id").isNotNull())
            .select("id", "config_id")
            .distinct()
            .join(settings.dropDuplicates(["config_id"]), "config_id")
        )
        avgdl = F.lit(total / n if n and total else 1.0)

        def weigh(w: Column) -> Column:
            rarity = bm25.idf(F.lit(n), w["df"])
            return bm25.contribution(rarity, w["tf"], F.col("dl"), avgdl, F.col("k1"), F.col("b"))

        keys, rows = ["id", "config_id"], pairs.join(words, "id")
    scored = F.transform(
        "words",
        lambda w: F.struct(
            (-weigh(w)).alias("less"), w["term"].alias("term"), w["tf"].alias("tf"), w["degree"].alias("degree")
        ),
    )
    return rows.select(*keys, F.posexplode_outer(_top(scored, k)).alias("at", "t")).select(
        *keys, (F.col("at") + 1).cast("int").alias("place"), "t.term", "t.tf", "t.degree", (-F.col("t.less")).alias("weight")
    )


def agreement(hits: DataFrame, configs: DataFrame, k: int = 3, window: int = 4) -> DataFrame:
    """(config_id, places, shared): how many of BM25's k terms per record are also the graph's."""
    graph = checkpointed(top_terms(hits, k=k, window=window).select("id", "term"))
    chosen = top_terms(hits, configs, k=k, window=window).select("id", "config_id", "term")
    both = chosen.join(graph.withColumn("also", F.lit(1)), ["id", "term"], "left")
    return both.groupBy("config_id").agg(F.count("*").alias("places"), F.count("also").alias("shared"))
