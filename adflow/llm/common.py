"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is deleted before exact comparison.
SPACE = r"[\x20\x09-\x0D]"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_row(df: DataFrame) -> Column:
    """The whole input row as one struct, so that no working column can clash
    with a column of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside ``SPACE``; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(trimmed, SPACE, "")).cast("long")


def pieces(text: str | None, limit: int = 1 << 20):
    """A text in pieces of about ``limit`` characters, cut at white space."""
    text = text or ""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(" ", at, at + limit), text.rfind("\n", at, at + limit))
        cut = cut if cut > at else at + limit
        yield text[at:cut]
        at = cut
    yield text[at:]


def slices(batch, limit: int = 4 << 20):
    """An Arrow batch in slices of about ``limit`` bytes, so that a worker turns only
    so much text into Python objects at a time."""
    if not batch.num_rows:
        return
    rows = max(1, batch.num_rows * limit // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
