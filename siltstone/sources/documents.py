"""Documents and their inverted index, kept in a store under a reserved key prefix.

Each document has an entry with its text, one with its length and one for each of its
terms, keyed by term and id, with the term's frequency and the length; one entry holds
the number of documents and of all their tokens. Entries change by one write with the
document that they belong to. As keys are sorted in the store's files, a search reads
the files and row groups of its terms, and of the documents that it returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.errors import Corrupted, InvalidInput
from siltstone.functions.bm25 import Bm25Config
from siltstone.functions.bytes import successor
from siltstone.operators import changelog as cl
from siltstone.operators import fulltext as ft
from siltstone.operators.changelog import DELETE, PUT, Bound
from siltstone.sources.shared import checkpointed, stacked
from siltstone.sources.store import Delete, Put, Store

RESERVED = b"\x00documents\x00"
META, DOCUMENT = RESERVED + b"m", RESERVED + b"d"
LENGTH, POSTING, TOTALS = RESERVED + b"l", RESERVED + b"p", RESERVED + b"s"
#: Format and token rule of the stored documents.
VERSIONS = bytes([3, 1])
OLD_FORMATS = {bytes([1, 1]), bytes([2, 1])}


def _number(column: Column, width: int) -> Column:
    """A number as so many big-endian bytes, and back by ``_read_number``."""
    return F.unhex(F.lpad(F.hex(column), 2 * width, "0"))


def _read_number(column: Column, start: int, width: int) -> Column:
    return F.conv(F.hex(F.substring(column, start, width)), 16, 10).cast("long")


def _text_behind(prefix: bytes) -> Column:
    """What stands behind a prefix in a key, as text."""
    return F.substring("key", len(prefix) + 1, 1 << 30).cast("string")


def entries(documents: DataFrame) -> DataFrame:
    """(key, value): all entries of documents (doc_id, document) but the totals."""
    index = ft.build(documents)
    binary = lambda c: F.col(c).cast("binary")
    return stacked(
        index.documents.select(F.concat(F.lit(DOCUMENT), binary("doc_id")).alias("key"), binary("document").alias("value")),
        index.lengths.select(F.concat(F.lit(LENGTH), binary("doc_id")).alias("key"), _number(F.col("doc_len"), 8).alias("value")),
        index.postings.select(
            F.concat(F.lit(POSTING), binary("term"), F.lit(b"\x00"), binary("doc_id")).alias("key"),
            F.concat(_number(F.col("tf"), 8), _number(F.col("doc_len"), 8)).alias("value"),
        ),
    )


class DocumentStore:
    """Documents and ordinary keys of one store; reserved keys stay out of reach."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    @classmethod
    def open(cls, store: Store) -> "DocumentStore":
        """Check the stored versions; initialise where the reserved range is empty."""
        found = cls(store)
        meta = store.get(META)
        if meta is None:
            if store.prefix_scan(RESERVED).limit(1).count():
                raise Corrupted("there are documents but no metadata")
            store.put(META, VERSIONS)
        elif meta in OLD_FORMATS:
            raise Corrupted("the documents have an old format; rebuild them")
        elif meta != VERSIONS:
            raise Corrupted("the documents have a format that this version does not know")
        return found

    # documents

    def _live(self, *prefixes: bytes) -> DataFrame:
        """Live entries of some key prefixes, of the files that may hold them."""
        frames = []
        for prefix in prefixes:
            low, high = Bound(prefix), Bound(successor(prefix), False)
            frames.append(cl.latest(self.store.changes(low, high).where(cl.in_range(low, high))))
        return stacked(*frames)

    def documents(self) -> DataFrame:
        """(doc_id, document) of all live documents."""
        return self._live(DOCUMENT).select(
            _text_behind(DOCUMENT).alias("doc_id"),
            F.validate_utf8(F.col("value").cast("string")).alias("document"),
        )

    def _postings(self, terms: list[str] | None = None) -> DataFrame:
        """(doc_id, term, tf, doc_len) of some terms, or of all."""
        wanted = [POSTING] if terms is None else [POSTING + t.encode() + b"\x00" for t in terms]
        rows = self._live(*wanted).withColumn("k", _text_behind(POSTING))
        term = F.substring_index("k", "\x00", 1)
        return rows.select(
            F.substr("k", F.length(term) + 2).alias("doc_id"), term.alias("term"),
            _read_number(F.col("value"), 1, 8).alias("tf"), _read_number(F.col("value"), 9, 8).alias("doc_len"),
        )

    def _totals(self) -> tuple[int, int]:
        value = self.store.get(TOTALS) or bytes(16)
        if len(value) != 16:
            raise Corrupted("the totals of the documents cannot be read")
        return int.from_bytes(value[:8]), int.from_bytes(value[8:])

    def index(self) -> ft.Index:
        """The index as it is kept."""
        n, total = self._totals()
        lengths = self._live(LENGTH).select(
            _text_behind(LENGTH).alias("doc_id"), _read_number(F.col("value"), 1, 8).alias("doc_len")
        )
        sums = self.spark.createDataFrame([(n, total)], "n long, total long")
        return ft.Index(self.documents(), lengths, self._postings(), saved_statistics=sums)

    def verify(self) -> DataFrame:
        """(rule, doc_id, term): entries of the index that contradict the documents; none if it is sound."""
        return ft.violations(self.index())

    def apply_documents(self, changes: DataFrame) -> None:
        """Apply a table (pos, doc_id, document) of any size: the last of an id holds, null deletes.

        The entries of the documents before and after are compared, and those that
        differ are written at once. Null and empty ids and unpaired surrogates do not
        occur in a string column that comes from UTF-8; null and empty ids are refused.
        """
        newest = W.partitionBy("doc_id").orderBy(F.desc("pos"))
        last = changes.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("doc_id", "document")
        last = checkpointed(last)
        if last.where(F.coalesce(F.length("doc_id"), F.lit(0)) == 0).limit(1).count():
            raise InvalidInput("a document id must not be empty")
        with self.store._lock:
            self.store._drain()
            before = self.documents().join(last.select("doc_id"), "doc_id", "left_semi")
            self._replace(before, last)

    def _replace(self, before: DataFrame, after: DataFrame) -> None:
        """Write what changes when documents are replaced by others, those with null by none."""
        was = entries(before).withColumnRenamed("value", "was")
        now = entries(after).withColumnRenamed("value", "now")
        changed = was.join(now, "key", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
        rows = checkpointed(
            changed.select(F.when(F.col("now").isNull(), DELETE).otherwise(PUT).alias("op"), "key", F.col("now").alias("value"), "was")
        )
        lengths = rows.where(F.col("key").substr(1, len(LENGTH)) == F.lit(LENGTH))
        tokens = lambda c: F.coalesce(F.sum(_read_number(F.col(c), 1, 8)), F.lit(0))
        sums = lengths.agg(
            (F.count("value") - F.count("was")).alias("n"), (tokens("value") - tokens("was")).alias("total")
        ).first()
        n, total = self._totals()
        n, total = n + sums["n"], total + sums["total"]
        if n < 0 or total < 0:
            raise Corrupted("the totals of the documents are below what is deleted")
        line = [(PUT, TOTALS, n.to_bytes(8) + total.to_bytes(8))]
        rows = rows.select(F.col("op").cast("int").alias("op"), "key", "value")
        self.store.write_at_once(stacked(rows, self.spark.createDataFrame(line, "op int, key binary, value binary")))

    def put_document(self, doc_id: str, data: bytes) -> None:
        self.put_documents([(doc_id, data)], single=True)

    def put_documents(self, batch: list[tuple[str, bytes]], *, single: bool = False) -> None:
        """Store a batch at once; the last of equal ids stays, an empty batch does nothing."""
        if single:  # one document may be larger than a batch
            doc_id, data = batch[0]
            if not doc_id:
                raise InvalidInput("a document id must not be empty")
            try:
                checked = [(doc_id, data.decode("utf-8"))]
            except UnicodeDecodeError as e:
                raise InvalidInput("the document is not UTF-8") from e
        else:
            checked = ft.checked_documents(batch)
        if checked:
            self._put(checked)

    def _put(self, last: list[tuple[str, str | None]]) -> None:
        """Replace a few documents, of which the store's are found by their keys."""
        with self.store._lock:
            self.store._drain()
            keys = [DOCUMENT + i.encode() for i, _ in last]
            before = self.documents_of(keys)
            self._replace(before, self.spark.createDataFrame(last, "doc_id string, document string"))

    def documents_of(self, keys: list[bytes]) -> DataFrame:
        """(doc_id, document) of the live documents under some keys."""
        files = self.store.changes(Bound(min(keys)), Bound(max(keys)))
        rows = cl.latest(files.where(F.col("key").isin(keys)))
        return rows.select(_text_behind(DOCUMENT).alias("doc_id"), F.col("value").cast("string").alias("document"))

    def delete_document(self, doc_id: str) -> bool:
        """Whether the document existed."""
        if not doc_id:
            raise InvalidInput("a document id must not be empty")
        with self.store._lock:
            self.store._drain()
            existed = self.store.get(DOCUMENT + doc_id.encode()) is not None
            if existed:
                self._put([(doc_id, None)])
        return existed

    def get_document(self, doc_id: str) -> bytes | None:
        return self.store.get(DOCUMENT + doc_id.encode())

    def search(self, words: list[str], *, every: bool, limit: int = 100) -> DataFrame:
        """(doc_id, document) by doc_id, from the entries of the terms and of the documents found."""
        terms = ft.checked(self.spark, words, limit)
        ids = ft.matching_ids(self._postings(terms), terms, every, limit)
        return ft.with_documents(self.documents(), ids, limit).orderBy("doc_id")

    def search_ranked(
        self, words: list[str], *, every: bool, limit: int = 100, config: Bm25Config = Bm25Config()
    ) -> DataFrame:
        """(doc_id, document, score), by the totals and the entries of the terms."""
        terms = ft.checked(self.spark, words, limit)
        n, total = self._totals()
        return ft.rank_hits(
            self._postings(terms), self.documents(), terms, n, total, every=every, limit=limit, config=config
        )

    # ordinary keys

    @staticmethod
    def _guard(key: bytes) -> None:
        if key.startswith(RESERVED):
            raise InvalidInput("the key lies in the reserved range")

    def get(self, key: bytes) -> bytes | None:
        self._guard(key)
        return self.store.get(key)

    def put(self, key: bytes, value: bytes) -> None:
        self.write_batch([Put(key, value)])

    def delete(self, key: bytes) -> None:
        self.write_batch([Delete(key)])

    def write_batch(self, ops: list[Put | Delete]) -> None:
        for op in ops:
            self._guard(op.key)
        self.store.write_batch(ops)

    def scan(self, low: Bound = Bound(), high: Bound = Bound()) -> DataFrame:
        return cl.outside_namespace(self.store.scan(low, high), RESERVED).orderBy("key")

    def await_pending_writes(self) -> None:
        self.store.await_pending_writes()

    def close(self) -> None:
        self.store.close()
