"""Occurrences and records of every term, by an external sort and a run-length scan.

Each record is reduced to one row per distinct term where it lies. These rows are
range-partitioned by term and record identifier and sorted within the partitions,
with spill to disk; a term in a third of all records spreads over as many
partitions as its rows fill. A scan then measures the runs of equal terms. A run
that a partition boundary cuts leaves one part per partition, and the parts are
added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import with_tokens
from siltstone.sources.shared import checkpointed

RUNS = "term string, occurrences long, records long"


def distinct_records(hits: DataFrame, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """One row (id, document) for each distinct non-null id with a non-null document.

    If an id came with different documents, the smallest of them is taken.
    """
    return (
        hits.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(text_col).alias("document"))
    )


def term_pairs(records: DataFrame) -> DataFrame:
    """(id, term, tf): the distinct terms of each record with their occurrences.

    Records must have distinct ids. A record without term gives no row.
    """
    return (
        with_tokens(records, "document", "id")
        .select("id", F.explode("toks").alias("term"))
        .groupBy("id", "term")
        .agg(F.count("*").alias("tf"))
    )


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal terms in sorted (term, tf) rows: total of tf and number of rows."""
    open_term, open_sum, open_rows = None, 0, 0

    def row(terms, sums, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(sums, pa.int64()), pa.array(rows, pa.int64())],
            ["term", "occurrences", "records"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, tf = batch.column("term"), batch.column("tf").to_numpy()
        new = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], new)))
        sums, rows = np.add.reduceat(tf, starts), np.diff(np.append(starts, n))
        found = term.take(pa.array(starts)).to_pylist()
        if open_term == found[0]:
            sums[0] += open_sum
            rows[0] += open_rows
        elif open_term is not None:
            yield row([open_term], [open_sum], [open_rows])
        open_term, open_sum, open_rows = found[-1], int(sums[-1]), int(rows[-1])
        if len(found) > 1:
            yield row(found[:-1], sums[:-1], rows[:-1])
    if open_term is not None:
        yield row([open_term], [open_sum], [open_rows])


def term_counts(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(term, occurrences, records) from rows (id, term, tf) that are distinct in id and term."""
    by = [F.col("term"), F.col("id")]
    ranged = (
        pairs.repartitionByRange(partitions, *by) if partitions else pairs.repartitionByRange(*by)
    )
    runs = (
        ranged.sortWithinPartitions("term", "id")
        .select("term", "tf")
        .mapInArrow(run_lengths, RUNS)
    )
    return runs.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )


def marked(
    counts: DataFrame, n_records: int, *, rare_at_most: int = 2, common_above: tuple[int, int] = (2, 5)
) -> DataFrame:
    """Counts with mark: 'rare', 'common' or null.

    'rare' is a term in at most ``rare_at_most`` records, 'common' one of the others
    in more than the fraction ``common_above`` of all records. The fraction is
    compared in whole numbers.
    """
    above, of = common_above
    return counts.withColumn(
        "mark",
        F.when(F.col("records") <= rare_at_most, "rare").when(
            F.col("records") * of > F.lit(n_records) * above, "common"
        ),
    )


def term_marks(hits: DataFrame, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """Every term of the collection with its counts and mark.

    Null ids and null documents make no record; an empty document is a record
    without terms. Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    n_records = (
        hits.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(id_col)
        .distinct()
        .count()
    )
    # written out: the range partitioner reads its input twice
    pairs = checkpointed(term_pairs(distinct_records(hits, id_col, text_col)))
    return marked(term_counts(pairs), n_records)
