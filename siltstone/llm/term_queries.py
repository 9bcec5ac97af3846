"""Term statistics of search_hits and ranked_hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import distinct_terms, terms
from siltstone.sources.shared import read_table


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and mark ('' for none)."""
    return terms.term_marks(read_table(spark, sf_dir, "search_hits")).na.fill("", ["mark"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    counts = terms.term_marks(read_table(spark, sf_dir, "search_hits"))
    return counts.where(F.col("mark").isNotNull()).select("term", "mark")


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "ranked_hits"), read_table(spark, sf_dir, "bm25_configs")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most characteristic terms of each record under each of its settings.

    From the graph of words, with BM25's contribution of a node's visits as its weight.
    """
    return distinct_terms.top_terms(*_ranked(spark, sf_dir)).select("id", "config_id", "place", "term")


def p5_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms of each record with the highest graph degree times rarity."""
    found = distinct_terms.top_terms(_ranked(spark, sf_dir)[0]).drop("tf")
    return found.withColumn("weight", F.round("weight", 9))


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each setting's places hold a term that the degrees choose too."""
    return distinct_terms.agreement(*_ranked(spark, sf_dir))


QUERIES = {
    "p3_found": p3_found, "p3_counts": p3_counts, "p5_found": p5_found, "p5_graph": p5_graph,
    "p5_agreement": p5_agreement,
}

_RECORDS = """
with records as (
    select id, min(document) as document from {table}
    where id is not null and document is not null group by id
), toks as (
    select id, list_transform(regexp_extract_all(document, '[\\p{{L}}\\p{{N}}]+'),
        lambda x: lower(x)) as toks
    from records
), words as (select id, unnest(toks) as term from toks),
pairs as (select id, term, count(*) as tf from words group by all),
n as (select count(*) as n from records)
"""

_COUNTS = (
    _RECORDS.format(table="search_hits")
    + """, counts as (
    select term, sum(tf)::bigint as occurrences, count(*) as records from pairs group by term
), marked as (
    select *, case when records <= 2 then 'rare'
        when records * 5 > (select n from n) * 2 then 'common' else '' end as mark
    from counts
)
"""
)

_RANKED = (
    _RECORDS.format(table="ranked_hits")
    + """, dfs as (select term, count(*) as df from pairs group by term),
lens as (select id, sum(tf)::double as dl from pairs group by id),
stats as (select n, (select sum(dl) from lens) / n as avgdl from n),
settings as (
    select distinct id, config_id, k1, b from ranked_hits join bm25_configs using (config_id)
    where isfinite(k1) and k1 > 0 and isfinite(b) and b between 0 and 1
), parts as (
    select id, config_id, term, k1, tf::double as tf,
        ln(n + 1.0::double) - ln(df + 0.5::double) as idf,
        (1.0::double - b) + b * (dl / avgdl) as lf
    from settings join pairs using (id) join dfs using (term) join lens using (id), stats
), weights as (
    select id, config_id, term, case
        when k1 <= 1 then idf * (tf * (1.0::double + k1)) / (tf + k1 * lf)
        else idf * (tf * (1.0::double + 1.0::double / k1)) / (tf * (1.0::double / k1) + lf)
        end as weight
    from parts
)
select id, config_id, place::int as place, term from (
    select *, row_number() over
        (partition by id, config_id order by weight desc, encode(term)) as place
    from weights)
where place <= 3
"""
)

_GRAPH = (
    _RECORDS.format(table="ranked_hits")
    + """, dfs as (select term, count(*) as df from pairs group by term),
places as (select id, unnest(toks) as term, generate_subscripts(toks, 1) as i from toks),
degrees as (
    select a.id, a.term, count(distinct case when b.term <> a.term then b.term end) as degree
    from places a join places b on a.id = b.id and b.i between a.i - 3 and a.i + 3
    group by all
), weights as (
    select id, term, degree, degree * (ln(n + 1.0::double) - ln(df + 0.5::double)) as weight
    from degrees join dfs using (term), n
)
select id, place::int as place, term, degree, round(weight, 9) as weight from (
    select *, row_number() over (partition by id order by weight desc, encode(term)) as place
    from weights)
where place <= 3
"""
)

ORACLE_SQL = {
    "p3_found": _COUNTS + "select term, mark from marked where mark <> ''",
    "p3_counts": _COUNTS + "select term, occurrences, records, mark from marked",
    "p5_found": _RANKED,
    "p5_graph": _GRAPH,
    "p5_agreement": f"""
select config_id, count(*) as places, count(g.term) as shared
from ({_RANKED}) r left join (select id, term from ({_GRAPH})) g using (id, term) group by config_id
""",
}
