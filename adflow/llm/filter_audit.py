r"""Filter interaction audit: what every order of five filters would remove.

1. Sketch. The XXH64 of every text is written once (8 bytes a row). Tasks count the
   hashes in a counting Bloom filter whose counters stop at two; chunks of the
   counters are merged by chunk on the executors. A text that has a counter of one
   to itself occurs once: it is cleared. There are no false clearances, since equal
   texts raise the same counters.
2. Flags. One pass over the texts gives every row its failing filters A to D as a
   mask, and keeps the text of the rows that the sketch could not clear.
3. Exact repeats. Only those texts are shuffled, pre-aggregated before the shuffle,
   to the smallest id of every full text. A row fails E if it is not cleared and not
   the row with that smallest id.
4. Mask counts. Rows collapse to (part, mask) -> rows, good, toxic: at most 32 rows
   a part. Whatever an order of filters does follows from sums over masks, so the
   120 orders are never run.

Scale: texts are read twice and only possible repeats move. A hot text, source or
part is pre-aggregated in its own task. The sketch has 16 counters a row up to
``MOST_COUNTERS`` (a merged sketch of 16 MB, which is what is collected and
broadcast, whatever the size of the input); from there on the number of probes falls
with the load, fewer texts are cleared and more are shuffled, and results stay exact.

Defined results: a null text counts as empty; empty texts equal each other and have
no words, so they fail A only (and E if repeated). A null part is the empty string.
A null id never fails E and is nobody's smaller id; rows of one id with one text are
no smaller ids of each other. Repeated rows count each. Very long texts are read
whole; one text and its words have to fit into a task. Labels repeated for one id
count as good or toxic if any of them says so; labels of unknown or null ids count
nowhere. An empty table gives an empty result. Columns are taken by name into fresh
ones, so that other columns of the inputs cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import checkpoint
from .common import SPACE, text_or_empty

#: The filters in the order of their bits in a mask.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT, JUNK = 200, 50, 2, r"[#$%&*|]"
#: Bounds of the sketch: counters in all, and counters that travel in one row.
COUNTERS_A_ROW, MOST_COUNTERS, CHUNK = 16, 1 << 27, 1 << 16
MOST_PROBES = 4


def sketch_size(rows: int, most: int = MOST_COUNTERS) -> tuple[int, int]:
    """(counters, probes) for so many rows: a power of two and the best number of probes."""
    counters = CHUNK
    while counters < min(most, COUNTERS_A_ROW * rows):
        counters *= 2
    return counters, min(MOST_PROBES, max(1, round(0.69 * counters / max(1, rows))))


def _probes(hashes, counters: int, probes: int):
    """Positions (rows x probes) of 64-bit hashes. The step is odd and the number of
    counters a power of two, so a row's own probes differ."""
    h = hashes.astype(np.uint64)
    start, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    at = start[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)[None, :]
    return (at & np.uint64(counters - 1)).astype(np.int64)


def _count(counters: int, probes: int):
    """A task's own counters, as two bit planes (at least one, at least two) for each
    chunk in use."""

    def count(batches: Iterator) -> Iterator:
        seen = np.zeros(counters, dtype=np.uint8)
        for batch in batches:
            at, n = np.unique(_probes(batch.column(0).to_numpy(), counters, probes), return_counts=True)
            seen[at] = np.minimum(2, seen[at] + np.minimum(2, n).astype(np.uint8))
        for k in range(0, counters, CHUNK):
            part = seen[k:k + CHUNK]
            if part.any():
                planes = [np.packbits(part >= c, bitorder="little").tobytes() for c in (1, 2)]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()),
                                                  "once": pa.array(planes[:1], pa.binary()),
                                                  "twice": pa.array(planes[1:], pa.binary())})

    return count


def _merge(chunks):
    """The sum of the counters of one chunk; a group has a row for each sketch task."""
    once = np.zeros(CHUNK // 8, dtype=np.uint8)
    twice = once.copy()
    for a, b in zip(chunks["once"], chunks["twice"], strict=True):
        a, b = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
        twice |= b | (once & a)
        once |= a
    return pd.DataFrame({"chunk": chunks["chunk"].iloc[:1], "twice": [twice.tobytes()]})


def repeat_sketch(hashes: DataFrame, rows: int, most: int = MOST_COUNTERS):
    """(broadcast bit plane of counters at two, counters, probes) of one column of hashes."""
    spark = hashes.sparkSession
    counters, probes = sketch_size(rows, most)
    # A task's sketch should not outweigh the hashes it counts.
    tasks = max(spark.sparkContext.defaultParallelism, 8 * rows // counters)
    chunks = hashes.coalesce(tasks).mapInArrow(_count(counters, probes), "chunk int, once binary, twice binary")
    merged = chunks.groupBy("chunk").applyInPandas(_merge, "chunk int, twice binary")
    plane = np.zeros(counters // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():  # at most MOST_COUNTERS / 8 bytes in all
        plane[r["chunk"] * CHUNK // 8:(r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["twice"], dtype=np.uint8)
    return spark.sparkContext.broadcast(plane), counters, probes


def may_repeat(sketch) -> Column:
    """A function of a hash column: false if the sketch clears the text."""
    plane, counters, probes = sketch

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        at = _probes(h.to_numpy(), counters, probes)
        return pd.Series((((plane.value[at >> 3] >> (at & 7).astype("uint8")) & 1) == 1).all(axis=1))

    return test


def text_mask(text: Column) -> Column:
    """The bits of the failing filters A to D of a text."""
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    counts = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(n: Column) -> Column:
        few = n["all"] < LEAST_WORDS
        dull = n["distinct"].cast("long") * 100 < n["all"].cast("long") * LEAST_DISTINCT_PERCENT
        loud = upper.cast("long") * 100 > F.length(text).cast("long") * MOST_UPPER_PERCENT
        return sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate((few, dull, loud, text.rlike(JUNK)))),
                   F.lit(0))

    return F.transform(F.array(counts), bits)[0]


def filter_masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source",
                 most_counters: int = MOST_COUNTERS) -> DataFrame:
    """id, part and mask (bit k: fails filter k of ``FILTERS``) of every row of ``docs``."""
    body = text_or_empty(f"`{text}`")
    hashes = checkpoint(docs.select(F.xxhash64(body).alias("h")))
    possible = may_repeat(repeat_sketch(hashes, hashes.count(), most_counters))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       body.alias("body")).withColumn("h", F.xxhash64("body")).withColumn("possible", possible("h"))
    flags = checkpoint(rows.select("id", "part", "h", "possible", text_mask(F.col("body")).alias("mask"),
                                   F.when(F.col("possible"), F.col("body")).alias("again")))
    first = (flags.filter("possible").groupBy("again").agg(F.min("id").alias("first_id"))
             .select("first_id", F.xxhash64("again").alias("first_h"), F.lit(True).alias("is_first")))
    first = first.filter("first_id IS NOT NULL").distinct()
    own = (F.col("id") == F.col("first_id")) & (F.col("h") == F.col("first_h"))
    repeat = F.col("possible") & F.col("id").isNotNull() & F.col("is_first").isNull()
    return flags.drop("again").join(first, own, "left").select(
        "id", "part", (F.col("mask") + F.when(repeat, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality",
                toxic: str = "toxic") -> DataFrame:
    """part, mask, n, good, toxic: the additive counts that every order is made of."""
    said = (labels.select(F.col(f"`{doc_id}`").alias("label_id"), (F.col(f"`{quality}`") == 1).cast("int").alias("g"),
                          (F.col(f"`{toxic}`") == 1).cast("int").alias("t"))
            .filter("label_id IS NOT NULL").groupBy("label_id").agg(F.max("g").alias("g"), F.max("t").alias("t")))
    return (masks.join(said, masks["id"] == said["label_id"], "left").groupBy("part", "mask")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("g"), F.lit(0)).alias("good"),
                 F.coalesce(F.sum("t"), F.lit(0)).alias("toxic")))


def _orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, bit (of the step's filter) and before (mask of the earlier ones): 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            rows.append(("".join(order), step, 1 << FILTERS.index(letter), before))
            before |= rows[-1][2]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit_orders(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from ``mask_counts``. A step depends on its
    filter and the set of those before it, so 80 states a part are summed and dealt
    to the orders."""
    states = [(1 << k, sum(1 << o for o in others)) for k in range(len(FILTERS))
              for r in range(len(FILTERS)) for others in combinations([o for o in range(len(FILTERS)) if o != k], r)]
    state = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(m).alias("before")) for b, m in states]))
    each = counts.select("*", state.alias("s")).select("part", "mask", "n", "good", "toxic", "s.bit", "s.before")
    mask, bit = F.col("mask"), F.col("bit")
    fails, alive = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("before")) == 0
    removed = fails & alive

    def total(when: Column, of: Column) -> Column:
        return F.sum(F.when(when, of).otherwise(0)).cast("long")

    n = F.col("n")
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k
    # A row goes by one of its failing filters: by each of them in an equal share of the orders.
    share = (n * orders / F.bit_count(mask)).cast("long")
    sums = each.groupBy("part", "bit", "before").agg(
        total(alive & ~fails, n).alias("kept"), total(removed, n).alias("removed"),
        total(fails & ~alive, n).alias("redundant"), total(mask == bit, n).alias("unique_fails"),
        total(removed, F.col("good")).alias("good_lost"), total(removed, F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"))
    return sums.join(F.broadcast(_orders(counts.sparkSession)), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source",
          most_counters: int = MOST_COUNTERS) -> DataFrame:
    return audit_orders(mask_counts(filter_masks(docs, text, doc_id, part, most_counters), labels, doc_id))
