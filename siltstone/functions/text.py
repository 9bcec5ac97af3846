"""The full-text token rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import InvalidInput

#: A token is a maximal run of alphabetic or numeric characters.
TOKEN = r"([\p{IsAlphabetic}\p{N}]+)"
MAX_TERMS = 32


def tokens(text: Column | str) -> Column:
    """Array of a text's tokens in order, each lower-cased character by character.

    Lower-casing the whole text first gives the same tokens, with two exceptions that
    are seen to: the JVM would make Σ at a word's end ς, which depends on its
    neighbours, so it is mapped before; and İ gains a combining dot, which is no token
    character, so texts with it are cut before lower-casing. A null text gives null,
    an empty one or one without token an empty array.
    """
    text = F.col(text) if isinstance(text, str) else text
    cut = F.transform(_cut(text), fold)
    return F.when(F.contains(text, F.lit("İ")), cut).otherwise(_cut(fold(text)))


def with_tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``toks``, the tokens of a text column.

    They come out of a generator of one row, since conditions on a plain expression
    would be pushed below it and every text be cut again for each of them.
    """
    return df.select(*keep, F.explode_outer(F.array(tokens(text))).alias("toks"))


def _cut(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def fold(token: Column) -> Column:
    """A string without İ lower-cased character by character, or any one token."""
    return F.lower(F.translate(token, "Σ", "σ"))


def query_terms(spark, words: list[str]) -> list[str]:
    """Sorted distinct tokens of all words of a query, by the rule of ``tokens``."""
    if not words:
        return []
    df = spark.createDataFrame([(words,)], "words array<string>")
    every = F.array_sort(F.array_distinct(F.flatten(F.transform("words", tokens))))
    return list(df.select(every.alias("terms")).first()["terms"])


def checked_terms(spark, words: list[str]) -> list[str]:
    """Query terms, refused if there are none or more than 32."""
    terms = query_terms(spark, words)
    if not terms:
        raise InvalidInput("the query holds no term")
    if len(terms) > MAX_TERMS:
        raise InvalidInput(f"the query holds more than {MAX_TERMS} distinct terms")
    return terms
