"""Passages of evaluation items inside training documents.

The items' word n-grams form a set of hashes that every task gets by broadcast. A
document's words are numbered by the items' vocabulary, a rolling hash of each
window of n words is looked up in the set, and each hit is verified word for word.
A word is a run of letters and digits; letter case, accents, invisible characters
and a hyphen that parts a word at a line end are removed first.

An n-gram that many items share is kept and verified once; which items hold it is told
apart from that.

The set is only broadcast while the items hold at most ``MAX_GRAMS`` n-grams. Beyond
that a filter of bounded size over the items' n-grams is broadcast: windows that it
rules out, nearly all of them, end where they are, and the others meet the items'
n-grams in a join, with the same result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import InvalidInput
from siltstone.sources.shared import checkpointed

#: N-grams of items that are broadcast, and characters of item text held by a task.
MAX_GRAMS, MAX_CHARS = 2_000_000, 50_000_000

#: Soft hyphen, zero-width space, word joiner, zero-width no-break space (fixed values).
INVISIBLE = "\u00ad\u200b\u2060\ufeff"
_DELETE = {ord(c): None for c in INVISIBLE}

#: A word where it stands: letters and digits, with marks and invisible characters
#: among them, across a hyphen at a line end if a letter follows.
_HYPHENS = "-\u2010\u2011"
_BREAK = rf"[^\S\n\r\u2028\u2029]*(?:\r\n|[\n\r\u2028\u2029\u0085])[\s{INVISIBLE}]*(?=\p{{L}})"
_LINE_END = rf"[{_HYPHENS}][{INVISIBLE}]*{_BREAK}"
#: A run of invisible characters is taken as a whole; with a soft hyphen among them it may part a word.
_SOFT_END = rf"[{INVISIBLE.replace('\u00ad', '')}]*+\u00ad[{INVISIBLE}]*+{_BREAK}"
WORD = (
    rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\p{{M}}]|(?<=[\p{{L}}\p{{M}}]){_SOFT_END}|[{INVISIBLE}]++"
    rf"|(?<=[\p{{L}}\p{{M}}{INVISIBLE}]){_LINE_END})*"
)

_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(word: str) -> str:
    """A word's normal form: letters and digits only, without accents and case."""
    if word.isascii() and word.isalnum():
        return word.lower()
    bare = unicodedata.normalize("NFD", word.translate(_DELETE).casefold())
    return "".join(c for c in bare if unicodedata.category(c)[0] in "LN")


class Words:
    """Cuts texts into words, keeping the normal forms of recent ones."""

    def __init__(self):
        import regex

        self.find = regex.compile(WORD).finditer
        self.forms: dict[str, str] = {}

    def __call__(self, text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
        """Normal forms and places of a text's words."""
        if not text:
            return [], []
        words, places = [], []
        for m in self.find(text):
            raw = m.group()
            form = self.forms.get(raw)
            if form is None:
                form = plain(raw)
                if len(self.forms) > 200_000:
                    self.forms.clear()
                if len(raw) <= 64:
                    self.forms[raw] = form
            if form:
                words.append(form)
                places.append(m.span())
        return words, places


def _codes(ids: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit code per word number."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words by their numbers."""
    return _polynomial(_codes(ids), n)


def _polynomial(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each window of n codes, by n shifted additions."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    count = len(codes) - n + 1
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + codes[i : i + count]
    return out


class ItemSet:
    """The items' distinct n-grams: vocabulary, hashes, and the items that hold each."""

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        self.n = n
        cut = Words()
        self.vocabulary: dict[str, int] = {}
        self.item_ids = [item_id for item_id, _ in items]
        words, hashes, owners = [], [], []
        for k, (_, text) in enumerate(items):
            forms, _ = cut(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in forms], np.int64)
            h = window_hashes(ids, n)
            words.append(np.lib.stride_tricks.sliding_window_view(ids, n) if len(h) else np.zeros((0, n), np.int64))
            hashes.append(h)
            owners.append(np.full(len(h), k, np.int64))
        grams = np.concatenate(words) if words else np.zeros((0, n), np.int64)
        grams, number = np.unique(grams, axis=0, return_inverse=True)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        of = np.zeros(len(grams), np.uint64)
        of[number] = every
        order = np.argsort(of, kind="stable")
        self.hashes, self.grams = of[order], grams[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # (gram, item) pairs by gram: the items of gram g are members[starts[g]:starts[g + 1]]
        pairs = np.unique(np.stack([place[number.ravel()], np.concatenate(owners or [np.zeros(0, np.int64)])]), axis=1)
        self.members = pairs[1]
        self.starts = np.searchsorted(pairs[0], np.arange(len(grams) + 1))

    def hits(self, forms: list[str]) -> dict[int, list[int]]:
        """The n-grams among these words, by number, and at which words they begin."""
        if len(forms) < self.n or not len(self.hashes):
            return {}
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in forms), np.int64, len(forms))
        known = np.convolve(ids >= 0, np.ones(self.n, np.int64), "valid") == self.n
        if not known.any():
            return {}
        at = np.flatnonzero(known)
        h = window_hashes(ids, self.n)[at]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        found: dict[int, list[int]] = {}
        for place, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
            window = ids[place : place + self.n]
            for g in range(a, b):  # as a rule one
                if np.array_equal(self.grams[g], window):
                    found.setdefault(int(g), []).append(int(place))
        return found

    def items_of(self, hits: dict[int, list[int]]) -> list[int]:
        """Ids of the items that hold any of the n-grams found."""
        held = {k for g in hits for k in self.members[self.starts[g] : self.starts[g + 1]].tolist()}
        return sorted({self.item_ids[k] for k in held})


def _bounded_items(items: DataFrame, id_col: str, text_col: str, n: int) -> ItemSet | None:
    """The items' n-grams, or None if they are more than a broadcast may hold."""
    chosen = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    if (chosen.agg(F.sum(F.length(text_col))).first()[0] or 0) > MAX_CHARS:
        return None
    rows = chosen.select(F.col(id_col), F.col(text_col)).distinct().collect()
    found = ItemSet([(r[0], r[1]) for r in rows], n)
    return found if len(found.hashes) <= MAX_GRAMS else None


def _scan(documents: DataFrame, items: ItemSet, id_col: str, text_col: str, outside: bool):
    """Per document the items found; with ``outside`` also the text without the hits."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(items)
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = shared.value, Words()
        for batch in batches:
            at, found, texts = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                forms, places = cut(text)
                hits = own.hits(forms)
                if outside:
                    at.append(row)
                    found.append(own.items_of(hits))
                    texts.append(without(text, places, hits, own.n))
                else:
                    for k in own.items_of(hits):
                        at.append(row)
                        found.append(k)
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            if outside:
                arrays = [ids, pa.array(found, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "items", "clean_text"])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int64())], [id_col, "item_id"])

    more = "items array<bigint>, clean_text string" if outside else "item_id bigint"
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, {more}")


def without(text: str | None, places: list, hits: dict[int, list[int]], n: int) -> str | None:
    """``text`` without the words of all hits and what stands between them."""
    if not hits:
        return text
    out, upto = [], 0
    for w in sorted({w for ws in hits.values() for w in ws}):
        lo, hi = places[w][0], places[w + n - 1][1]
        if lo > upto:
            out.append(text[upto:lo])
        upto = max(upto, hi)
    return "".join([*out, text[upto:]])


#: Bits of the filter over the items' n-grams.
FILTER_BITS = 1 << 26


def _word_windows(forms: list[str], known: dict[str, int], n: int) -> np.ndarray:
    """A hash of each window of n words by the words themselves, the same for all tasks."""
    import xxhash

    if len(known) > 200_000:
        known.clear()
    codes = np.empty(len(forms), np.uint64)
    for i, w in enumerate(forms):
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = code
    return _polynomial(codes, n)


def _gram_rows(df: DataFrame, id_col: str, text_col: str, name: str, n: int, keep=None) -> DataFrame:
    """(name, hash, gram, place): every window of n words, or those that a filter lets pass."""
    chosen = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, codes = Words(), {}
        passes = None if keep is None else keep.value
        for batch in batches:
            for row, text in enumerate(batch.column("text").to_pylist()):
                forms, _ = cut(text)
                hashes = _word_windows(forms, codes, n)
                at = np.arange(len(hashes))
                if passes is not None:
                    bit = hashes & np.uint64(FILTER_BITS - 1)
                    at = at[(passes[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                for lo in range(0, len(at), 5_000):
                    some = at[lo : lo + 5_000]
                    ids = batch.column("id").slice(row, 1).take(pa.array(np.zeros(len(some), np.int64)))
                    grams = pa.array([" ".join(forms[i : i + n]) for i in some], pa.string())
                    own = pa.array(hashes[some].view(np.int64))
                    yield pa.RecordBatch.from_arrays([ids, own, grams, pa.array(some.astype(np.int32))], names)

    names = [name, "hash", "gram", "place"]
    return chosen.mapInArrow(run, f"`{name}` {kind}, hash bigint, gram string, place int")


def _filter_of(grams: DataFrame):
    """A broadcast bit array over the hashes of n-grams; its size does not depend on them."""
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = grams.groupBy(F.shiftright(bit, 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")
    )
    rows = words.toArrow()  # at most FILTER_BITS / 64 of them
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return grams.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _met(documents: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str):
    """(doc, place, gram number) of the windows that items hold, and (gram number, item).

    Each n-gram has one row on the items' side, so that one shared by many items meets a
    window once.
    """
    own = items.where(F.col(item_col).isNotNull())
    there = checkpointed(_gram_rows(own, item_col, item_text_col, "item", n).select("item", "hash", "gram").distinct())
    numbered = checkpointed(
        there.select("hash", "gram").distinct().withColumn("number", F.monotonically_increasing_id())
    )
    here = _gram_rows(documents, id_col, text_col, "doc", n, _filter_of(numbered))
    hits = here.join(numbered, ["hash", "gram"]).select("doc", "place", "number")
    return hits, there.join(numbered, ["hash", "gram"]).select("number", "item")


def leaked(
    documents: DataFrame,
    items: DataFrame,
    *,
    n: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast: bool | None = None,
) -> DataFrame:
    """(doc id, item id), each pair once: n words in a row of the item stand in the document.

    Null and empty texts leak nothing, nor do items of fewer than n words. Items
    with equal texts are all reported. Rows with null ids are kept for documents and
    ignored for items. ``broadcast`` forces or forbids the broadcast set.
    """
    if n < 1:
        raise InvalidInput("n must be at least 1")
    found = None if broadcast is False else _bounded_items(items, item_col, item_text_col, n)
    if found is not None:
        pairs = _scan(documents, found, id_col, text_col, outside=False)
        return pairs.withColumnRenamed("item_id", item_col).distinct()
    if broadcast:
        raise InvalidInput("the items are too large to be broadcast")
    hits, members = _met(documents, items, n, id_col, text_col, item_col, item_text_col)
    pairs = hits.select("doc", "number").distinct().join(members, "number")
    return pairs.select(F.col("doc").alias(id_col), F.col("item").alias(item_col)).distinct()


def cleaned(
    documents: DataFrame,
    items: DataFrame,
    *,
    n: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast: bool | None = None,
) -> DataFrame:
    """(doc id, items, clean_text): every document without its leaked spans.

    Documents without a hit keep their text, null texts stay null. ``broadcast``
    forces or forbids the broadcast set.
    """
    if n < 1:
        raise InvalidInput("n must be at least 1")
    found = None if broadcast is False else _bounded_items(items, item_col, item_text_col, n)
    if found is not None:
        return _scan(documents, found, id_col, text_col, outside=True)
    if broadcast:
        raise InvalidInput("the items are too large to be broadcast")
    return _cut_by_join(documents, items, n, id_col, text_col, item_col, item_text_col)


def _cut_by_join(
    documents: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> DataFrame:
    """``cleaned`` for any number of items: the places of hits come from the join.

    Rows are numbered, as ids may be null or stand in several rows, and written out,
    so that a row keeps its number.
    """
    numbered = checkpointed(
        documents.select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")
        )
    )
    met, members = _met(numbered, items, n, "row", "text", item_col, item_text_col)
    met = checkpointed(met)
    held = met.select("doc", "number").distinct().join(members, "number").groupBy(F.col("doc").alias("row"))
    found = held.agg(F.sort_array(F.collect_set(F.col("item").cast("long"))).alias("items"))
    places = met.groupBy(F.col("doc").alias("row")).agg(F.collect_set("place").alias("places"))
    hits = found.join(places, "row")
    rows = numbered.join(hits, "row", "left").select("id", "text", "items", "places")
    kind = numbered.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Words()
        for batch in batches:
            texts = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                texts.append(without(text, cut(text)[1], {0: at}, n) if at else text)
            found = [x or [] for x in batch.column("items").to_pylist()]
            arrays = [batch.column("id"), pa.array(found, pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "items", "clean_text"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, items array<bigint>, clean_text string")
