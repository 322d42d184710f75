"""What the operators share: words, rows that carry any columns, and the tables between their steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop_staged, numbered, running, scratch, shared_dir, staged, written

__all__ = ["NOT_SPACE", "SPACE", "as_row", "drop_staged", "numbered", "running", "scratch", "shared_dir", "staged", "unpacked", "word_count", "word_list", "written"]

#: White space that separates words: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct: columns added beside it can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(df: DataFrame, columns: list[str], new: dict[str, Column] | None = None, row: str = "row") -> DataFrame:
    """The columns of a struct made by ``as_row``, some of them replaced."""
    new = new or {}
    return df.select(*[(new[c] if c in new else F.col(row)[c]).alias(c) for c in columns])


def word_list(text: Column) -> Column:
    """The words of a text in order; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")).cast("long"), F.lit(0).cast("long"))
