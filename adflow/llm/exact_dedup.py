"""Exact de-duplication by content sort.

1. Normalise every text (delete white space) and range-partition the rows on
   (leading bytes, digest, preference, id). Spark samples the keys and cuts the
   splitters from the sample; the key is of bounded size, since every splitter
   passes through the driver, and it still orders by content: equal texts have
   equal leading bytes and digests.
2. Each partition is sorted on the same key (Spark's external, spilling sort),
   so equal texts are neighbours.
3. Neighbours are compared in full. A run of equal texts yields its size and
   its first row, which is the preferred one.
4. A run may cross partition borders (a hot text covers many partitions, as id
   is part of the range key). The last text of a partition is compared in full
   with the first of the next one; the two runs at each border are then added
   up in a table of two rows per partition.

The text is shuffled once. What step 4 handles grows with the number of
partitions, not with the rows or the size of a group.

Defined results: a null text counts as empty; empty texts equal each other. A
null id sorts after every other id. Repeated rows (same id and text) are one
group of which one row stays. Very long texts are hashed and compared whole. An empty
table gives an empty result. Columns of the input keep their names and values whatever
they are called.

The range key is bounded, so equal texts become neighbours by their leading characters
and digest; what decides is the comparison of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import checkpoint
from .common import SPACE, as_row, shuffle_partitions, slices, text_or_empty

#: Characters of the normalised text at the front of the range key.
LEAD_CHARS = 16


def normalised(text: str = "text"):
    return F.regexp_replace(text_or_empty(text), SPACE + "+", "")


def _sorted(df: DataFrame, partitions: int | None) -> DataFrame:
    """Range-partition and sort on (lead, digest, longest text first, id)."""
    n = partitions or shuffle_partitions(df.sparkSession)
    key = [F.col("lead"), F.col("sha"), F.col("chars").desc(), F.col("id").asc_nulls_last()]
    return df.repartitionByRange(n, *key).sortWithinPartitions(*key)


def _starts(batch, previous):
    """Flags of the rows whose full text differs from their neighbour's before."""
    import numpy as np
    import pyarrow.compute as pc

    norm = batch.column("norm")
    new = np.ones(batch.num_rows, dtype=bool)
    new[0] = previous is None or norm[0].as_py() != previous
    if batch.num_rows > 1:
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return new, norm[0].as_py(), norm[batch.num_rows - 1].as_py()


def _table(schema, rows: int, **columns):
    """An Arrow batch of ``schema``; columns that are not given are null."""
    import pyarrow as pa

    arrays = []
    for field in schema:
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(rows, field.type))
        else:
            value = value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value
            value = value if isinstance(value, pa.Array) else pa.array(value)
            arrays.append(value.cast(field.type) if value.type != field.type else value)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _mark_runs(schema_of):
    """One output row per input row with its run, plus two border rows."""

    def mark(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = schema_of()
        pid = TaskContext.get().partitionId()
        run, last, held = -1, None, []

        def closed(parts):
            rows = pa.concat_tables(parts)
            runs = rows.column("run").to_numpy()
            at = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            sizes = np.diff(np.r_[at, len(runs)])
            head = np.repeat(at, sizes)
            return _table(schema, len(runs), id=rows.column("id"), sha=rows.column("sha"),
                          pid=np.full(len(runs), pid, dtype="int32"), run=runs,
                          head=head == np.arange(len(runs)), run_size=np.repeat(sizes, sizes),
                          head_id=rows.column("id").take(pa.array(head)))

        def border(side, text):
            return _table(schema, 1, pid=[pid], run=[max(run, 0)], side=[side], edge=[text])

        for batch in (part for whole in batches for part in slices(whole)):
            new, first_text, last_text = _starts(batch, last)
            if last is None:
                yield border("first", first_text)
            runs = run + np.cumsum(new)
            rows = pa.table({"id": batch.column("id"), "sha": batch.column("sha"), "run": runs})
            at = np.flatnonzero(new)
            if len(at):
                done = held + [rows.slice(0, at[-1])]
                if sum(len(x) for x in done):
                    yield closed(done)
                held = [rows.slice(at[-1])]
            else:
                held.append(rows)
            run, last = int(runs[-1]), last_text
        if last is not None:
            yield closed(held)
            yield border("last", last)

    return mark


def _mark_heads(schema_of):
    """The first row of every run, whole, plus two border rows."""

    def mark(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = schema_of()
        pid = TaskContext.get().partitionId()
        run, last = -1, None
        for batch in (part for whole in batches for part in slices(whole)):
            new, first_text, last_text = _starts(batch, last)
            if last is None:
                yield _table(schema, 1, pid=[pid], run=[0], side=["first"], edge=[first_text])
            runs = run + np.cumsum(new)
            rows = batch.column("row").filter(pa.array(new))
            if len(rows):
                yield _table(schema, len(rows), row=rows, run=runs[new],
                             pid=np.full(len(rows), pid, dtype="int32"), head=np.ones(len(rows), dtype=bool))
            run, last = int(runs[-1]), last_text
        if last is not None:
            yield _table(schema, 1, pid=[pid], run=[run], side=["last"], edge=[last])

    return mark


def _arrow_schema(schema: T.StructType):
    def build():
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema)

    return build


_RUN_FIELDS = [T.StructField("pid", T.IntegerType()), T.StructField("run", T.LongType()),
               T.StructField("head", T.BooleanType()), T.StructField("side", T.StringType()),
               T.StructField("edge", T.StringType())]


def _continued(marked: DataFrame) -> DataFrame:
    """(pid, anchor_pid, anchor_run) for each partition whose first run carries
    on a run of an earlier partition; the anchor is where that run began. One
    row per partition goes through the windows, without any text."""
    first = marked.filter(F.col("side") == "first").select("pid", F.col("edge").alias("first_text"))
    last = marked.filter(F.col("side") == "last")
    order = Window.orderBy("pid")
    pids = last.select("pid", F.col("run").alias("last_run")).withColumn("before", F.lag("pid").over(order))
    ends = last.select(F.col("pid").alias("before"), F.col("edge").alias("last_text"))
    met = (pids.join(first, "pid").join(ends, "before", "left")
           .select("pid", "last_run", F.coalesce(F.col("first_text") == F.col("last_text"), F.lit(False)).alias("more")))
    own = F.when(~F.col("more") | (F.col("last_run") > 0), F.struct("pid", "last_run"))
    return (met.withColumn("open", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("anchor", F.lag("open").over(order)).filter("more")
            .select("pid", F.col("anchor.pid").alias("anchor_pid"), F.col("anchor.last_run").alias("anchor_run")))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (of the row that stays), group_size,
    kept, text_sha256 (of the normalised text). Of equal texts the row with the
    most code points stays, then the one with the smallest id."""
    id_type = docs.schema[doc_id].dataType
    keyed = (docs.select(F.col(f"`{doc_id}`").alias("id"), F.length(text_or_empty(f"`{text}`")).alias("chars"),
                         normalised(f"`{text}`").alias("norm"))
             .withColumns({"lead": F.substring("norm", 1, LEAD_CHARS), "sha": F.sha2("norm", 256)}))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("sha", T.StringType()), *_RUN_FIELDS,
                           T.StructField("run_size", T.LongType()), T.StructField("head_id", id_type)])
    marked = checkpoint(_sorted(keyed, partitions).select("id", "sha", "norm")
                        .mapInArrow(_mark_runs(_arrow_schema(schema)), schema))
    rows = marked.filter(F.col("side").isNull())
    more = checkpoint(_continued(marked))
    # The border runs of a group that crosses partitions: the anchor and what carries it on.
    members = (more.select("pid", F.lit(0).cast("long").alias("run"), "anchor_pid", "anchor_run")
               .unionByName(more.select(F.col("anchor_pid").alias("pid"), F.col("anchor_run").alias("run"),
                                        "anchor_pid", "anchor_run").distinct()))
    heads = rows.filter("head").select("pid", "run", "run_size", "head_id").join(members, ["pid", "run"])
    at_anchor = (F.col("pid") == F.col("anchor_pid")) & (F.col("run") == F.col("anchor_run"))
    whole = heads.groupBy("anchor_pid", "anchor_run").agg(
        F.sum("run_size").alias("all_size"), F.max(F.when(at_anchor, F.col("head_id"))).alias("all_head"))
    fixes = members.join(whole, ["anchor_pid", "anchor_run"]).select(
        "pid", "run", "all_size", "all_head", at_anchor.alias("anchor"))
    crossed = F.col("all_size").isNotNull()
    return rows.join(fixes, ["pid", "run"], "left").select(
        F.col("id").alias(doc_id),
        F.when(crossed, F.col("all_head")).otherwise(F.col("head_id")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("head") & F.coalesce("anchor", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                partitions: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with exactly the columns of ``docs``. The
    whole row travels through the one sort, so no join back is needed."""
    keyed = (docs.select(as_row(docs), F.col(f"`{doc_id}`").alias("id"),
                         F.length(text_or_empty(f"`{text}`")).alias("chars"), normalised(f"`{text}`").alias("norm"))
             .select("row", "id", "chars", F.substring("norm", 1, LEAD_CHARS).alias("lead"),
                     F.sha2("norm", 256).alias("sha")))
    schema = T.StructType([T.StructField("row", docs.schema), *_RUN_FIELDS])
    marked = checkpoint(_sorted(keyed, partitions).select("row", normalised(f"row.`{text}`").alias("norm"))
                        .mapInArrow(_mark_heads(_arrow_schema(schema)), schema))
    carried_on = checkpoint(_continued(marked)).select("pid", F.lit(0).cast("long").alias("run"))
    return marked.filter("head").join(carried_on, ["pid", "run"], "left_anti").select("row.*")
