"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source has a weight; the weights share a budget of ``share`` times all
words. A target stops at ``max_epochs`` times its source's size and the excess is
shared again by weight (water filling). A source's target is met by complete
epochs first, which take every document, and then by a weighted sample without
replacement: each document draws the exponential key ``-ln(u) / quality`` with u
from a hash of its id, the keys are sorted within the source, and documents are
taken while their prefix sum fits the rest of the budget. The gap that is left
goes to the one remaining document that fills it best, if that brings the source
nearer to its target.

Scale: the order of keys is cut into ``KEY_BUCKETS`` ranges, so a source is
first summed by (source, range), and only the range in which the budget runs
out is sorted row by row. What comes out is one row per source with the last key
taken, and every document is decided against that row alone. No task holds a
whole source, and only tables of one row per source (and range) are small.

Defined results: sources are ordered by code point, null last; null is a source
like any other. A null text has no words and is taken with none. Equal keys are
ordered by id, a null id last; repeated rows have equal keys and are taken together.
Very long texts are counted whole. An empty table gives an empty result. Columns are
taken by name into fresh ones, so that other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import checkpoint
from .common import as_row, word_count

KEY_BUCKETS = 4096
SEED = "mix"


def quality_weight(text: Column, words: Column) -> Column:
    """Weight of a document in the sample: 2 where its words have 3 to 10
    characters on average, as prose has, else 1."""
    mean = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")) / F.nullif(words, F.lit(0))
    return F.when(mean.between(3, 10), F.lit(2.0)).otherwise(F.lit(1.0))


def sample_key(doc_id: Column, quality: Column) -> Column:
    """Exponential key; the smaller, the earlier the document is taken."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def _bucket(key: Column) -> Column:
    """Range of a key: monotone, and even for keys of quality 1."""
    return F.floor((F.lit(1.0) - F.exp(-key)) * KEY_BUCKETS).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.
    Sorted by cap / weight, the sources that stop at their cap come first; from
    the first one that does not, all share what is left by weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    caps = sizes.withColumn("w", turn).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = (caps.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
              .withColumn("level", (F.col("budget") - filled) / rest)
              .withColumn("pos", F.row_number().over(order)))
    below = F.col("level") * F.col("w") < F.col("cap")
    first = F.min(F.when(below, F.struct("pos", "level"))).over(everything)
    return levels.withColumn("first", first).select(
        "source", "source_size",
        F.when(F.col("first").isNull() | (F.col("pos") < F.col("first.pos")), F.col("cap").cast("double"))
        .otherwise(F.col("first.level") * F.col("w")).alias("target"))


def _measured(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    words = word_count(F.col(f"`{text}`"))
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"),
                       words.alias("size"), F.col(f"`{text}`").alias("text")).select(
        "id", "source", "size",
        sample_key(F.col("id"), quality_weight(F.col("text"), F.col("size"))).alias("key"))


def _at(key: str = "key", doc_id: str = "id", size: str = "size") -> Column:
    """Place of a document in the order of its source, null ids last."""
    return F.struct(F.col(key).alias("key"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"),
                    F.col(size).alias("size"))


def mixing_plan(measured: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                max_epochs: int = 2) -> DataFrame:
    """One row per source: source, source_size, target, epochs, last (place of the
    last document of the fractional epoch) and fill (the document that closes the
    gap). ``measured`` is (id, source, size, key)."""
    ranges = checkpoint(measured.groupBy("source", _bucket(F.col("key")).alias("bucket"))
                        .agg(F.sum("size").alias("words")))
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    plan = checkpoint(source_targets(sizes, weights, share, max_epochs)
                      .withColumn("epochs", epochs.cast("int"))
                      .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (ranges.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
           .join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
           .filter((F.col("before") <= F.col("rest")) & (F.col("rest") > 0))
           .groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("cut")))
    cut = checkpoint(plan.join(cut.select(F.col("source").alias("s"), "cut"),
                               F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    rows = measured.join(cut.select(F.col("source").alias("s"), "rest", "cut"), F.col("source").eqNullSafe(F.col("s")))
    # Only the range in which the budget runs out is put in order.
    prefix = Window.partitionBy("source").orderBy(_at()).rowsBetween(Window.unboundedPreceding, 0)
    last = (rows.filter(_bucket(F.col("key")) == F.col("cut.bucket"))
            .withColumn("sum", F.col("cut.before") + F.sum("size").over(prefix))
            .filter(F.col("sum") <= F.col("rest"))
            .groupBy("source").agg(F.max(F.struct(_at().alias("last"), F.col("sum"))).alias("got")))
    reached = checkpoint(cut.join(last.select(F.col("source").alias("s"), "got"),
                                  F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
                         .withColumn("gap", F.col("rest") - F.coalesce(F.col("got.sum"), F.col("cut.before"))))
    left = measured.join(reached.select(F.col("source").alias("s"), "gap", "got", "cut"),
                         F.col("source").eqNullSafe(F.col("s")))
    miss = F.abs(F.col("size") - F.col("gap"))
    fill = (left.filter(~_taken_by_place() & (miss < F.col("gap")))
            .groupBy("source").agg(F.min(F.struct(miss.alias("miss"), _at().alias("place"))).alias("fill")))
    return checkpoint(reached.join(fill.select(F.col("source").alias("s"), F.col("fill.place").alias("fill")),
                                   F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _taken_by_place() -> Column:
    """Is the document before the cut? Needs columns cut and got of its source."""
    bucket = _bucket(F.col("key"))
    at_cut = (bucket == F.col("cut.bucket")) & F.col("got.last").isNotNull() & (_at() <= F.col("got.last"))
    return F.coalesce((bucket < F.col("cut.bucket")) | at_cut, F.lit(False))


def _copies(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """``measured`` with its source's plan and the number of copies to take."""
    joined = measured.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    extra = _taken_by_place() | F.coalesce(_at() == F.col("fill"), F.lit(False))
    return joined.withColumn("copies", F.coalesce(F.col("epochs"), F.lit(0)) + extra.cast("int"))


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
                weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target (its source's),
    taken (words the mix takes, repeats counted), copies."""
    measured = checkpoint(_measured(docs, text, doc_id, source))
    out = _copies(measured, mixing_plan(measured, weights, share, max_epochs))
    return out.select(F.col("id").alias(doc_id), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
                    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The rows of the mix: the columns of ``docs``, a row for each copy taken.
    Every row is decided against the plan of its source, so texts never move."""
    plan = mixing_plan(checkpoint(_measured(docs, text, doc_id, source)), weights, share, max_epochs)
    words = word_count(F.col(f"row.`{text}`"))
    rows = (docs.select(as_row(docs)).select("row", F.col(f"row.`{doc_id}`").alias("id"),
                                             F.col(f"row.`{source}`").alias("source"), words.alias("size"))
            .withColumn("key", sample_key(F.col("id"), quality_weight(F.col(f"row.`{text}`"), F.col("size")))))
    taken = _copies(rows, plan).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
