"""Helpers shared by the corpus operators: row packing and words; frames are materialized by the library's helper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mkpulse.session import materialize  # noqa: F401 - used by the operators

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes in an Arrow batch of whole texts (a longer text is a batch of its own).
TEXT_BATCH = "4m"


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct column ``row``, so that no added column can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def text_of(col: str | Column) -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is not inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
