"""Sentence units of whole texts, in all scripts of the corpus.

Sites where a sentence may end are found once in every text (sentence_sites) and
written as a table of arrays, with the places that a unit may begin and end at. Their
evidence is counted from that table over the whole corpus; the hidden-event model
(sentence_model) is estimated from the counts and broadcast; the table is decoded.
All other gaps between words stand beside the sites in a form of a few bytes each, as
their events hang on no other; what tells of them are the counted pairs of words and signs.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import sentence_model as sm
from siltstone.llm.sentence_sites import GAP, SIGN, sites_and_gaps, span_at
from siltstone.sources.shared import checkpointed, shared_dir

KEY = ["last", "mark", "one", "gap", "next"]
COUNTED = "last string, mark string, one boolean, gap string, next string, n long"

#: Per site: its key, how it is settled (-1 for not), the quote it lies in, whether it closes that,
#: and how many cuts it stands for.
_SITE = [("last", pa.string()), ("mark", pa.string()), ("one", pa.bool_()), ("gap", pa.string()), ("next", pa.string()),
         ("settled", pa.int8()), ("quote", pa.int32()), ("closes", pa.bool_()), ("cuts", pa.int32())]
#: Per cut, those of the text before those of its sites: where the text before it ends and that
#: behind it begins, without white space. Per quote: the site before it, whether nothing stands between,
#: and its places. Per plain gap: characters from the gap before, and its own; its tokens are in ``words``.
_ARRAYS = [*_SITE, ("ends", pa.int32()), ("begins", pa.int32()), ("quote_site", pa.int32()), ("quote_first", pa.bool_()),
           ("quote_start", pa.int32()), ("quote_end", pa.int32()), ("steps", pa.int32())]
_TYPES = {pa.string(): "string", pa.bool_(): "boolean", pa.int8(): "tinyint", pa.int32(): "int"}
FOUND = ", ".join(f"{n} array<{_TYPES[t]}>" for n, t in _ARRAYS) + ", opening int, words string"


def _bare(text: str, at: int) -> tuple[int, int]:
    """Where the text before a place ends, and the text behind it begins."""
    lo, hi, n = at, at, len(text)
    while lo and text[lo - 1].isspace():
        lo -= 1
    while hi < n and text[hi].isspace():
        hi += 1
    return lo, hi


def _row(text: str) -> tuple[list[list], int, str]:
    """A text's arrays by ``_ARRAYS``, how many of its cuts belong to no site, and the words around its gaps."""
    found, quotes, opening, words, plain = sites_and_gaps(text)
    out: list[list] = [[] for _ in _ARRAYS]
    last, mark, one, gap, nxt, settled, quote, closes, cuts, ends, begins, quote_site, quote_first, quote_start, quote_end, steps = out
    steps += plain
    places = [0, len(text), *(p for span in opening for p in span)]
    of_text = len(places)
    for s in found:
        last.append(s.last)
        mark.append(s.mark)
        one.append(s.one)
        gap.append(s.gap)
        nxt.append(s.next)
        settled.append(-1 if s.settled is None else int(s.settled))
        quote.append(s.quote)
        closes.append(s.closes)
        cuts.append(1 + 2 * len(s.remarks))
        places.append(s.at)
        for span in s.remarks:
            places += span
    for p in places:
        lo, hi = _bare(text, p)
        ends.append(lo)
        begins.append(hi)
    if quotes:
        at = [s.at for s in found]
        for start, end in quotes:
            quote_start.append(start)
            quote_end.append(end)
            i = bisect.bisect_right(at, start) - 1
            behind = max([found[i].at, *(r[1] for r in found[i].remarks)]) if i >= 0 else 0
            quote_site.append(i)
            quote_first.append(_bare(text, behind)[1] >= start)
    return out, of_text, words


def found_sites(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, arrays of ``FOUND``): the sites of every text that is not blank, as ``decoded`` takes them."""
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, min(1_000, batch.num_rows - start))
                at, opening, words = [], [], []
                values: list[list] = [[] for _ in _ARRAYS]
                offsets: list[list] = [[0] for _ in _ARRAYS]
                for row, text in enumerate(part.column("text").to_pylist()):
                    if not text or text.isspace():
                        continue
                    at.append(row)
                    arrays, of_text, around = _row(text)
                    opening.append(of_text)
                    words.append(around)
                    for mine, upto, more in zip(values, offsets, arrays):
                        mine += more
                        upto.append(len(mine))
                columns = [
                    pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, t))
                    for (_, t), v, o in zip(_ARRAYS, values, offsets)
                ]
                ids = part.column("id").take(pa.array(at, pa.int64()))
                names = ["id", *(n for n, _ in _ARRAYS), "opening", "words"]
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(opening, pa.int32()), pa.array(words, pa.string())], names)

    return chosen.mapInArrow(run, f"id {kind}, {FOUND}")


def counted_sites(found: DataFrame) -> DataFrame:
    """(last, mark, one, gap, next, n): all sites that are not settled, counted.

    Of gaps between words the counted pairs tell.
    """
    rows = found.select(F.explode(F.arrays_zip(*KEY, "settled")).alias("s")).where((F.col("s.settled") < 0) & (F.col("s.mark") != GAP))
    return rows.groupBy(*[F.col(f"s.{k}").alias(k) for k in KEY]).agg(F.count("*").alias("n"))


#: A word with what parts it from the next one.
_WORD_AND_GAP = r"((?:\p{L}[\p{L}\p{M}]*(?:['’\-.]\p{L}[\p{L}\p{M}]*)*|\p{N}+(?:[.,:/]\p{N}+)*)[^\p{L}\p{N}]{0,2})"
_BEHIND_WORD = r"[^\p{L}\p{M}\p{N}]+$"
_SIGN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def counted_pairs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(last, next, n): words that follow one another by a single space, counted over all texts.

    Where white space itself may end a sentence, as after Thai, it tells nothing.
    """
    cut = F.regexp_extract_all(F.col(text_col), F.lit(_WORD_AND_GAP), F.lit(1))
    parts = documents.select(F.explode_outer(F.array(cut)).alias("w")).where(F.size("w") > 1)
    space = F.lit(" ")
    pair = lambda a, b: F.when(F.right(a, F.lit(1)) == space, F.struct(F.rtrim(a).alias("last"), F.regexp_replace(b, _BEHIND_WORD, "").alias("next")))
    n = F.size("w") - 1
    pairs = parts.select(F.explode(F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), pair)).alias("p"))
    bare = F.col("p").isNotNull() & ~F.col("p.last").rlike(_BEHIND_WORD + r"|\p{IsThai}")
    return pairs.where(bare).groupBy("p.last", "p.next").agg(F.count("*").alias("n"))


def counted_signs(found: DataFrame, mark: str = SIGN) -> DataFrame:
    """(last, next, n): the tokens around places beside signs of Han and kana, counted, or with GAP
    those around gaps there."""
    cut = F.split(F.col("words"), " ", -1)
    held = F.col("words").contains(SIGN) if mark == SIGN else F.col("words").rlike(_SIGN)
    parts = found.where(held).select(cut.alias("w"))
    n = F.size("w") - 1
    both = F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.struct(a.alias("last"), b.alias("next")))
    pairs = parts.select(F.explode(both).alias("p")).select("p.last", "p.next")
    beside = F.col("last").startswith(SIGN) & (F.length("last") > 1)
    if mark == SIGN:
        pairs = pairs.where(beside).withColumn("last", F.substring("last", 2, 1_000_000))
    else:
        pairs = pairs.where(~beside & (F.col("last") != "") & (F.col("next") != "") & F.concat("last", "next").rlike(_SIGN))
    return pairs.groupBy("last", "next").agg(F.count("*").alias("n"))


def train(documents: DataFrame, text_col: str = "text") -> sm.HiddenEventModel:
    """The model of a corpus of texts."""
    found = found_sites(documents, text_col, text_col)
    return _estimated(found, documents, text_col)


def _estimated(found: DataFrame, documents: DataFrame, text_col: str) -> sm.HiddenEventModel:
    beside = [counted_signs(found, mark) for mark in (SIGN, GAP)]
    return estimated(counted_sites(found), counted_pairs(documents, text_col), *beside)


def estimated(counted: DataFrame, pairs: DataFrame | None = None, signs: DataFrame | None = None, apart: DataFrame | None = None) -> sm.HiddenEventModel:
    """The model of counted sites, pairs, signs and gaps beside signs. What comes to the driver is bounded by KNOWN and
    KNOWN_ROWS.

    Both bounds are shares of the sites of one script, so that a script with few sites
    keeps tokens of its own next to a large one. Nothing counted is left out: rows below
    the bound are added to coarser rows.
    """
    counts = checkpointed(counted)
    total = counts.agg(F.sum("n")).first()[0] or 0
    token_kind, extra = "token string, script string, n long", ["script", "last1", "next1", "last2", "next2"]

    def known(column: str) -> set[str]:
        def scripted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = pa.array([sm.script(t) for t in batch.column("token").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("token"), of, batch.column("n")], ["token", "script", "n"]
                )

        tokens = counts.groupBy(F.col(column).alias("token")).agg(F.sum("n").alias("n"))
        tokens = checkpointed(tokens.mapInArrow(scripted, token_kind))
        totals = {r[0]: r[1] for r in tokens.groupBy("script").agg(F.sum("n")).collect()}
        if not totals:
            return set()
        own = F.greatest(_of_script(totals) / sm.KNOWN, F.lit(float(sm.LEAST_KNOWN)))
        # a token longer than this is no word that comes again and again
        enough = (F.col("n") >= F.least(own, F.lit(total / sm.KNOWN))) & (F.length("token") <= 40) & (F.col("n") > 1)
        return {r[0] for r in tokens.where(enough).select("token").collect()}

    before, behind = known("last"), known("next")
    shared = counted.sparkSession.sparkContext.broadcast((before, behind))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            d = batch.to_pydict()
            keys = [sm.known_key(k, *own) for k in zip(*(d[c] for c in KEY))]
            columns = list(zip(*((*k, *sm.coarser(k[0], k[4])) for k in keys))) or [()] * 10
            kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.string()] * 7]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("n")], [*KEY, *extra, "n"])

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY, *extra).agg(F.sum("n").alias("n"))

    rows = counts.mapInArrow(shaped, COUNTED.replace("n long", "") + "".join(f"{c} string, " for c in extra) + "n long")
    rows = checkpointed(summed(rows))
    totals = {r[0]: r[1] for r in rows.groupBy("script").agg(F.sum("n")).collect()}
    if totals:
        fits = F.col("n") * sm.KNOWN_ROWS >= _of_script(totals)
        for coarse in ({"next": "next1"}, {"last": "last1"}, {"last": "last2", "next": "next2"}):
            rows = summed(rows.withColumns({c: F.when(fits, F.col(c)).otherwise(F.col(to)) for c, to in coarse.items()}))
    kept = rows.groupBy(*KEY).agg(F.sum("n").alias("n")).orderBy(*KEY).collect()
    beside = [[] if of is None else _kept_pairs(of, shared) for of in (pairs, signs, apart)]
    return sm.estimate([(tuple(r[:5]), float(r[5])) for r in kept], before, behind, *beside)


def _kept_pairs(pairs: DataFrame, shared) -> list[tuple[str, str, float]]:
    """Counted pairs with known tokens and shapes, small ones added to coarser ones."""
    kinds = "last string, next string, script string, last1 string, next1 string, n long"

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, behind = shared.value
        for batch in batches:
            last, nxt = batch.column("last").to_pylist(), batch.column("next").to_pylist()
            own = [t if t in before else sm.shape(t) for t in last]
            then = [t if t in behind else sm.shape(t) for t in nxt]
            columns = [own, then, [sm.script(t) for t in own], [sm.shape(t) for t in own], [sm.shape(t) for t in then]]
            arrays = [pa.array(c, pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("n")], ["last", "next", "script", "last1", "next1", "n"])

    key = ["last", "next", "script", "last1", "next1"]
    rows = checkpointed(pairs.mapInArrow(shaped, kinds).groupBy(*key).agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in rows.groupBy("script").agg(F.sum("n")).collect()}
    if not totals:
        return []
    for column, to in (("next", "next1"), ("last", "last1")):
        fits = F.col("n") * sm.KNOWN_ROWS >= _of_script(totals)
        rows = rows.withColumn(column, F.when(fits, F.col(column)).otherwise(F.col(to)))
        rows = rows.groupBy(*key).agg(F.sum("n").alias("n"))
    kept = rows.groupBy("last", "next").agg(F.sum("n").alias("n")).orderBy("last", "next").collect()
    return [(r[0], r[1], float(r[2])) for r in kept]


def _of_script(totals: dict[str, int]) -> Column:
    """The total of a row's script."""
    return F.create_map(*(F.lit(x) for pair in totals.items() for x in pair))[F.col("script")]


def _units(keys: list, settled: list, quote: list, closes: list, cuts: list, ends: list, begins: list,
           quote_site: list, quote_first: list, quote_start: list, quote_end: list, steps: list,
           opening: int, words: str, model: sm.HiddenEventModel) -> list[tuple[int, int]]:
    """Places of a text's units from its arrays."""
    decided = [p > 0.5 for p in model.decode(keys, settled)]
    chosen = list(range(opening))
    # sentences within a quote are units only if the quote begins and ends as one
    final = {q: d for q, d, c in zip(quote, decided, closes) if c}

    def parted(q: int) -> bool:
        return final.get(q, False) and quote_first[q] and (quote_site[q] < 0 or decided[quote_site[q]])

    at = opening
    for d, q, c, n in zip(decided, quote, closes, cuts):
        if d and (q < 0 or c or parted(q)):
            chosen.extend(range(at, at + n))
        at += n
    # a cut is known by where the text behind it begins and that before it ends
    cut = {(begins[i], ends[i]) for i in chosen}
    split = words.split(" ")
    around = model.around
    gaps = [i for i, pair in enumerate([pair for pair in zip(split, split[1:]) if pair[0] and pair[1]]) if around[pair]]
    if gaps:
        places = list(accumulate(steps))
        spans = list(zip(quote_start, quote_end))
        for i in gaps:
            lo, hi = places[2 * i : 2 * i + 2]
            q = span_at(spans, lo)
            if q < 0 or parted(q):
                cut.add((hi, lo))
    places = sorted(cut)
    out = []
    for (lo, _), (_, hi) in zip(places, places[1:]):
        if lo < hi:
            out.append((lo, hi))
    return out


def units(text: str | None, model: sm.HiddenEventModel) -> list[tuple[int, int]]:
    """Places of a text's sentence units."""
    if not text or text.isspace():
        return []
    arrays, opening, words = _row(text)
    return _units(list(zip(*arrays[:5])), *arrays[5:], opening, words, model)


def decoded(found: DataFrame, model: sm.HiddenEventModel, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_no, start_char, end_char) from the table of ``found_sites``."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists = []
            for name, _ in _ARRAYS:
                column = batch.column(name)
                values, upto = column.flatten().to_pylist(), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
                lists.append([values[a:b] for a, b in zip(upto, upto[1:])])
            at, number, start, end = [], [], [], []
            scalars = (batch.column(name).to_pylist() for name in ("opening", "words"))
            for row, (opening, words, *arrays) in enumerate(zip(*scalars, *lists)):
                placed = _units(list(zip(*arrays[:5])), *arrays[5:], opening, words, own)
                at += [row] * len(placed)
                number += range(1, len(placed) + 1)
                start += [s for s, _ in placed]
                end += [e for _, e in placed]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64()))]
                + [pa.array(c, pa.int32()) for c in (number, start, end)],
                [id_col, "sent_no", "start_char", "end_char"],
            )

    return found.mapInArrow(run, f"`{id_col}` {kind}, sent_no int, start_char int, end_char int")


def split_sentences(
    documents: DataFrame, model: sm.HiddenEventModel, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, sent_no, start_char, end_char): each text's units from 1 in text order.

    Places are code points from 0, the end exclusive, white space around a unit
    excluded. Null, empty and blank texts give no rows.
    """
    return decoded(found_sites(documents, id_col, text_col), model, id_col)


def sentence_units(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all texts, then split them all; the sites are found once."""
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/sites-{uuid.uuid4().hex}"
    found_sites(documents, id_col, text_col).write.parquet(folder)
    found = spark.read.parquet(folder)
    return decoded(found, _estimated(found, documents, text_col), id_col)
