"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern, each pre-token is mapped
byte by byte to printable characters and encoded by a sentencepiece model that is
written from the rank file (see sp_model). Decoding maps the pieces back.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie; a parameter of all functions here.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: The pre-token pattern that belongs to the rank files (a fixed value).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Distinct pre-tokens whose ids a worker keeps; longer ones than this are not kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, name: str = DEFAULT, folder: str = VOCABULARIES):
        import regex
        import sentencepiece

        from siltstone.llm import sp_model

        self.ranks = sp_model.read_ranks(os.path.join(folder, f"{name}.tiktoken"))
        self.model = sentencepiece.SentencePieceProcessor(
            model_proto=sp_model.model_bytes(self.ranks)
        )
        self.cut = regex.compile(PATTERN).findall
        self.table = str.maketrans({i: c for i, c in enumerate(sp_model.byte_characters())})
        self.known: dict[str, list[int]] = {}

    def _mapped(self, part: str) -> str:
        return part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, no special tokens; null and empty texts give empty lists."""
        parts = [self.cut(t) if t else [] for t in texts]
        known, fresh = self.known, {}
        new = list({p for ps in parts for p in ps if p not in known})
        if new:
            ids = self.model.encode([self._mapped(p) for p in new], num_threads=1)
            fresh = dict(zip(new, ids))
        out = [[i for p in ps for i in (known.get(p) or fresh[p])] for ps in parts]
        if len(known) + len(fresh) > CACHE_ENTRIES:
            known.clear()
        known.update((p, i) for p, i in fresh.items() if len(p) <= CACHE_CHARS)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the inverse of ``encode``."""
        return b"".join(self.ranks[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(name: str = DEFAULT, folder: str = VOCABULARIES) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    return ByteBpe(name, folder)


def encode_texts(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    name: str = DEFAULT,
    folder: str = VOCABULARIES,
) -> DataFrame:
    """(id, ids): the token ids of every row's text.

    Null and empty texts give an empty list. The strings of special tokens are
    ordinary text. Rows are neither merged nor dropped; other columns are ignored.
    """
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(name, folder)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = bpe.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"]
                )

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(
    encoded: DataFrame, *, id_col: str = "doc_id", name: str = DEFAULT, folder: str = VOCABULARIES
) -> DataFrame:
    """(id, text) from (id, ids); null ids give a null text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(name, folder)
        for batch in batches:
            texts = [None if i is None else bpe.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"]
            )

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
