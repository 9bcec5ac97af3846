"""Full-text queries over documents; a document's id is its number padded to ten digits."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.bm25 import Bm25Config
from siltstone.functions.text import query_terms, tokens
from siltstone.operators import fulltext as ft
from siltstone.sources.shared import (
    file_versions, read_table, read_text, remove, replace_text, shared_dir, spread, stacked,
)

COMMON, PAIR, RARE, MISSING = ["the"], ["the", "bill"], ["pilots", "<|endoftext|>"], ["qzxqzx"]

#: Alphabetic marks of the scripts in the tables, which the SQL side's regular
#: expressions know no property for (fixed values).
_MARKS = (
    r"\x{0610}-\x{061A}\x{064B}-\x{0657}\x{0659}-\x{065F}\x{0670}"
    r"\x{0900}-\x{0903}\x{093A}\x{093B}\x{093E}-\x{094C}\x{094E}\x{094F}\x{0955}-\x{0957}\x{0962}\x{0963}"
    r"\x{0E31}\x{0E34}-\x{0E3A}\x{0E4D}"
)
_BASE = (
    """
with docs as (
    select lpad(doc_id::varchar, 10, '0') as doc_id, text as document from documents where text is not null
), toks as (
    select doc_id, document, list_transform(
        regexp_extract_all(document, '[\\p{L}\\p{N}"""
    + _MARKS
    + """]+'), lambda x: lower(x)) as toks from docs
), lens as (select doc_id, len(toks)::bigint as doc_len from toks),
postings as (
    select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from toks) group by all
), dfs as (select term, count(*) as df from postings group by term),
stats as (select count(*) as n, sum(doc_len)::bigint as total from lens)
"""
)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = _BASE + sql
        return run

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("doc_id"), F.col("text").alias("document")
    )


def _index(spark: SparkSession, sf_dir: str) -> ft.Index:
    return ft.build(_docs(spark, sf_dir))


def _saved_index(spark: SparkSession, sf_dir: str) -> ft.Index:
    """The index of the documents, written once for an application and its table's files."""
    files = file_versions(read_table(spark, sf_dir, "documents"))
    name = hashlib.md5(repr(files).encode()).hexdigest()
    folder = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/index-{name}"
    if read_text(spark, f"{folder}/DONE") is None:
        remove(spark, folder)
        ft.save(_index(spark, sf_dir), folder)
        replace_text(spark, f"{folder}/DONE", "")
    return ft.load(spark, folder)


@_query("fts_tokens", "select * from postings")
def fts_tokens(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("doc_id", "term", "tf")


@_query("fts_doc_len", "select * from lens")
def fts_doc_len(spark, sf_dir):
    return _index(spark, sf_dir).lengths


@_query("fts_df", "select * from dfs")
def fts_df(spark, sf_dir):
    return _index(spark, sf_dir).frequencies


@_query("fts_corpus_stats", "select *, total / n::double as avgdl from stats")
def fts_corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).statistics.withColumn("avgdl", F.col("total") / F.col("n"))


@_query("fts_forward_map", "select doc_id, count(*) as n_terms, max(tf) as max_tf from postings group by doc_id")
def fts_forward_map(spark, sf_dir):
    """Each document's bag of words as a map, summarised."""
    forward = _index(spark, sf_dir).postings.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("bag")
    )
    return forward.select(
        "doc_id", F.size("bag").cast("long").alias("n_terms"), F.array_max(F.map_values("bag")).alias("max_tf")
    )


@_query("fts_query_terms", "select unnest(['bill', 'the', 'école', '世界']) as term")
def fts_query_terms(spark, sf_dir):
    terms = query_terms(spark, ["The BILL", "École, 世界!", "the"])
    return spark.createDataFrame([(t,) for t in terms], "term string")


@_query("fts_idf", ", i as (select term, round(ln(n + 1.0::double) - ln(df + 0.5::double), 9) as idf from dfs, stats) select * from i")
def fts_idf(spark, sf_dir):
    from siltstone.functions import bm25

    index = _index(spark, sf_dir)
    n = index.statistics.first()["n"]
    return index.frequencies.select(
        "term", F.round(bm25.idf(F.lit(n), F.col("df")), 9).alias("idf")
    )


def _bool_sql(terms: list[str], every: bool, limit: int | None = None) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    need = len(terms) if every else 1
    return f"""
, ids as (
    select doc_id from postings where term in ({listed}) group by doc_id having count(*) >= {need}
    order by doc_id {"" if limit is None else f"limit {limit}"}
) select doc_id, document from docs where doc_id in (select doc_id from ids)
"""


def _bool(name: str, words: list[str], terms: list[str], every: bool, limit: int | None = None, index=False) -> None:
    @_query(name, _bool_sql(terms, every, limit))
    def run(spark, sf_dir):
        if index:
            return ft.search(_saved_index(spark, sf_dir), words, every=every, limit=limit)
        return ft.search_texts(_docs(spark, sf_dir), words, every=every, limit=limit)


_bool("fts_and", PAIR, PAIR, True)
_bool("fts_or", PAIR, PAIR, False)
_bool("fts_and_index", PAIR, PAIR, True, index=True)
_bool("fts_or_index", PAIR, PAIR, False, index=True)
_bool("fts_or_index_limit", PAIR, PAIR, False, 100, index=True)
_bool("fts_and_limit", PAIR, PAIR, True, 10)
_bool("fts_or_limit", PAIR, PAIR, False, 100)
_bool("fts_missing", MISSING, MISSING, False)
_bool("fts_rare", RARE, ["pilots", "endoftext"], False)
_bool("fts_common", COMMON, COMMON, True)


def _rank_sql(terms: list[str], every: bool, limit: int | None, k1: float = 1.2, b: float = 0.75, base: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    one = "1.0::double"
    k, bb = f"{k1!r}::double", f"{b!r}::double"
    lf = f"(({one} - {bb}) + {bb} * (doc_len::double / (total / n::double)))"
    part = (
        f"idf * (tf * ({one} + {k})) / (tf + {k} * {lf})"
        if k1 <= 1
        else f"idf * (tf * ({one} + {one} / {k})) / (tf * ({one} / {k}) + {lf})"
    )
    return f"""{base}
, parts as (
    select doc_id, term, ln(n + {one}) - ln(df + 0.5::double) as idf, tf::double as tf, doc_len, total, n
    from postings join dfs using (term) join lens using (doc_id), stats where term in ({listed})
), scored as (
    select doc_id, list_reduce(list_prepend(0.0::double, list({part} order by term)), lambda a, b: a + b) as score
    from parts group by doc_id having count(*) >= {len(terms) if every else 1}
), top as (select * from scored order by score desc, doc_id {"" if limit is None else f"limit {limit}"})
select doc_id, document, round(score, 9) as score from top join docs using (doc_id)
"""


def _rank(name: str, words: list[str], every: bool, limit: int | None, k1=1.2, b=0.75, index=False) -> None:
    @_query(name, _rank_sql(words, every, limit, k1, b))
    def run(spark, sf_dir):
        settings = {"every": every, "limit": limit, "config": Bm25Config(k1, b)}
        found = (
            ft.search_ranked(_saved_index(spark, sf_dir), words, **settings)
            if index
            else ft.rank_texts(_docs(spark, sf_dir), words, **settings)
        )
        return found.withColumn("score", F.round("score", 9))


_rank("fts_rank_and", PAIR, True, None)
_rank("fts_rank_or", PAIR, False, None)
_rank("fts_rank_and_index", PAIR, True, None, index=True)
_rank("fts_rank_or_index", PAIR, False, None, index=True)
_rank("fts_rank_index_top10", PAIR, False, 10, index=True)
_rank("fts_rank_index_and_top100", PAIR, True, 100, index=True)
_rank("fts_rank_top1", PAIR, False, 1)
_rank("fts_rank_top10", PAIR, False, 10)
_rank("fts_rank_top100", PAIR, False, 100)
_rank("fts_rank_k1_small", PAIR, False, None, k1=0.1, b=0.0)
_rank("fts_rank_b0", PAIR, False, None, b=0.0)
_rank("fts_rank_b1", PAIR, False, None, k1=2.0, b=1.0)


_TWICE = """
with docs as (
    select lpad(doc_id::varchar, 10, '0') || c as doc_id, text as document
    from documents, (select unnest(['a', 'b']) as c) where text is not null
)"""


@_query("fts_rank_ties")
def fts_rank_ties(spark, sf_dir):
    """Every document under two ids: equal scores, the smaller id first."""
    copies = F.explode(F.array(F.lit("a"), F.lit("b")))
    twice = _docs(spark, sf_dir).withColumn("c", copies).select(
        F.concat("doc_id", "c").alias("doc_id"), "document"
    )
    found = ft.rank_texts(twice, PAIR, every=False, limit=100)
    return found.withColumn("score", F.round("score", 9))


ORACLE_SQL["fts_rank_ties"] = _TWICE + _BASE[_BASE.index(", toks as") :] + _rank_sql(PAIR, False, 100)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reissues replace the document they point to; every document of speaker 1 is deleted."""
    docs = read_table(spark, sf_dir, "documents")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    replaced = docs.where(F.col("reissue_of").isNotNull()).select(
        F.col("doc_id").alias("pos"), pad("reissue_of").alias("doc_id"), F.col("text").alias("document")
    )
    deleted = docs.where(F.col("speaker_id") == 1).select(
        (F.col("doc_id") + 1_000_000_000).alias("pos"), pad("doc_id").alias("doc_id"),
        F.lit(None).cast("string").alias("document"),
    )
    return stacked(replaced, deleted)


_CHANGED = """
with changes as (
    select doc_id as pos, lpad(reissue_of::varchar, 10, '0') as doc_id, text as document
    from documents where reissue_of is not null
    union all
    select doc_id + 1000000000, lpad(doc_id::varchar, 10, '0'), null from documents where speaker_id = 1
), last as (
    select * from changes qualify row_number() over (partition by doc_id order by pos desc) = 1
), docs as (
    select lpad(doc_id::varchar, 10, '0') as doc_id, text as document from documents
    where text is not null and lpad(doc_id::varchar, 10, '0') not in (select doc_id from last)
    union all select doc_id, document from last where document is not null
)"""
_CHANGED_BASE = _CHANGED + _BASE[_BASE.index(", toks as") :]


@_query("fts_update")
def fts_update(spark, sf_dir):
    """Documents and their lengths after replacements and deletes, by delta."""
    return ft.apply_delta(_index(spark, sf_dir), _changes(spark, sf_dir)).lengths


ORACLE_SQL["fts_update"] = _CHANGED_BASE + "select * from lens"


@_query("fts_delete")
def fts_delete(spark, sf_dir):
    """Ranked search after replacements and deletes."""
    changed = ft.apply_delta(_index(spark, sf_dir), _changes(spark, sf_dir))
    found = ft.search_ranked(changed, PAIR, every=False, limit=100)
    return found.withColumn("score", F.round("score", 9))


ORACLE_SQL["fts_delete"] = _CHANGED_BASE + _rank_sql(PAIR, False, 100)


@_query("fts_frequency_delta")
def fts_frequency_delta(spark, sf_dir):
    """How document frequencies change."""
    return ft.frequency_delta(_index(spark, sf_dir), _changes(spark, sf_dir))


ORACLE_SQL["fts_frequency_delta"] = (
    _CHANGED_BASE
    + """, before as (
    select term, count(distinct doc_id) as df from (
        select doc_id, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}"""
    + _MARKS
    + """]+'))) as term from documents where text is not null
    ) group by term
)
select term, (coalesce(d.df, 0) - coalesce(b.df, 0))::bigint as delta
from before b full join dfs d using (term) where coalesce(d.df, 0) <> coalesce(b.df, 0)
"""
)


@_query("fts_put_batch_last_wins")
def fts_put_batch_last_wins(spark, sf_dir):
    """Every id put twice in one batch: the later text stays."""
    docs = _docs(spark, sf_dir).where(F.col("document").isNotNull())
    first = docs.select(F.lit(0).alias("pos"), "doc_id", F.lit("first text").alias("document"))
    second = docs.select(F.lit(1).alias("pos"), "doc_id", F.concat(F.lit("last "), "document").alias("document"))
    after = ft.apply_documents(docs, stacked(first, second))
    return after.select("doc_id", F.size(tokens("document")).cast("long").alias("doc_len"))


ORACLE_SQL["fts_put_batch_last_wins"] = _BASE + "select doc_id, doc_len + 1 as doc_len from lens"


@_query("fts_incremental_equals_rebuild")
def fts_incremental_equals_rebuild(spark, sf_dir):
    """What differs between the index kept by deltas and one rebuilt; no rows."""
    return ft.violations(ft.apply_delta(_index(spark, sf_dir), _changes(spark, sf_dir)))


@_query("fts_verify")
def fts_verify(spark, sf_dir):
    """What an index with one tampered frequency violates: the tampered postings."""
    index = _index(spark, sf_dir)
    tampered = index.postings.withColumn("tf", F.when(F.col("term") == "bill", F.col("tf") + 1).otherwise(F.col("tf")))
    return ft.violations(ft.Index(index.documents, index.lengths, tampered))


_NONE = "select '' as rule, '' as doc_id, '' as term where false"
ORACLE_SQL["fts_incremental_equals_rebuild"] = _NONE
ORACLE_SQL["fts_verify"] = _BASE + "select 'posting' as rule, doc_id, term from postings where term = 'bill'"
