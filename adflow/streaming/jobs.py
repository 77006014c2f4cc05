"""Structured Streaming forms of ingest, state and auctions.

Exactly-once sinks: either the built-in file sink with a checkpoint, or
``foreachBatch`` writing each micro-batch to its own ``batch_id=N`` folder
with overwrite, so a retried batch replaces its own output and nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import constants as K
from ..functions import expr as X
from ..operators.money import to_micros
from ..sources import files

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS_SCHEMA, file_glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream (tests and replays); ``file_glob``
    selects the files of one table when the folder holds several."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(folder)


def with_event_time(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (session-zone, UTC here), not TIMESTAMP_NTZ."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def _batch_writer(path: str, fmt: str = "parquet", partition_by: list[str] | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite").format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


# X1 -- continuous ingest to a day-partitioned log (file sink, checkpointed).
def start_ingest(parsed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                 partition_col: str = "event_date") -> StreamingQuery:
    w = (parsed.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).partitionBy(partition_col))
    w = w.trigger(**(trigger or {"processingTime": "30 seconds"}))
    return w.start(path)


# X2 -- streaming de-duplication with bounded state.
def dedup_stream(df: DataFrame, key: str | list[str], delay: str = "2 hours", ts_col: str = "ts") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(keys)


# X3 -- incremental pair CTR state: each micro-batch appends its partial
# (day, ad, placement) sums; readers merge by summing (additive state).
def pair_partials(imps: DataFrame, clicks: DataFrame) -> DataFrame:
    i = imps.select(X.utc_day("ts").alias("day"), "ad_id", "placement_id",
                    F.lit(1).alias("i"), F.lit(0).alias("c"))
    c = clicks.select(X.utc_day("ts").alias("day"), "ad_id", "placement_id",
                      F.lit(0).alias("i"), F.lit(1).alias("c"))
    return i.unionByName(c)


def stream_ctr_pair(events: DataFrame, to_partials: Callable[[DataFrame], DataFrame], path: str,
                    checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """``to_partials(batch)`` maps a micro-batch of raw events to
    (day, ad_id, placement_id, i, c) rows; the batch is pre-aggregated
    before it is written, like an insert block of an aggregating table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        part = (to_partials(batch).groupBy("day", "ad_id", "placement_id")
                .agg(F.sum("i").cast("bigint").alias("impressions"), F.sum("c").cast("bigint").alias("clicks")))
        part.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{FRESH}/batch_id={batch_id}")
    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


# X3 -- compaction. Batches lie under FRESH, day partitions under FOLDED/upto=N, where N
# is the last batch they hold. A run of the fold counts once its _SUCCESS mark is there;
# each day is read from its newest run, and a batch only for days whose run ends before
# it. So nothing is counted twice or lost wherever the job dies: before the mark the new
# run does not exist, after it the old files are merely in the way.
FRESH, FOLDED = "fresh", "folded"
CTR_STATE = "day date, ad_id bigint, placement_id string, impressions bigint, clicks bigint"


def _done(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the sub-folders ``prefix=N`` that were written to their end."""
    found = []
    for path in files.children(spark, folder):
        name = path.rsplit("/", 1)[1]
        if name.startswith(f"{prefix}=") and files.exists(spark, f"{path}/_SUCCESS"):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def _numbered(spark: SparkSession, folder: str, prefix: str, numbers: list[int], schema: str) -> DataFrame:
    """The rows of these sub-folders with their number as column ``prefix``."""
    if not numbers:
        return spark.createDataFrame([], f"{schema}, {prefix} int")
    return (spark.read.schema(f"{schema}, {prefix} int").option("basePath", folder)
            .parquet(*[f"{folder}/{prefix}={n}" for n in numbers]))


def _ctr_parts(spark: SparkSession, path: str, schema: str = CTR_STATE) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rows of the newest fold of each day, rows of batches not folded yet, batch numbers)."""
    fresh, folded = (f"{path.rstrip('/')}/{x}" for x in (FRESH, FOLDED))
    batches = _done(spark, fresh, "batch_id")
    runs = _numbered(spark, folded, "upto", _done(spark, folded, "upto"), schema)
    newest = runs.groupBy("day").agg(F.max("upto").alias("last"))  # a row for each day
    held = runs.join(newest, (runs["day"] == newest["day"]) & (F.col("upto") == F.col("last"))).select(runs["*"])
    new = _numbered(spark, fresh, "batch_id", batches, schema)
    new = new.join(newest, "day", "left").filter(F.col("batch_id") > F.coalesce("last", F.lit(-1))).drop("last")
    return held, new, batches


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "ad_id", "placement_id").agg(
        F.sum("impressions").cast("bigint").alias("impressions"), F.sum("clicks").cast("bigint").alias("clicks"))


def read_ctr_state(spark: SparkSession, path: str) -> DataFrame:
    held, new, _ = _ctr_parts(spark, path)
    return _summed(held.drop("upto").unionByName(new.drop("batch_id")))


def fold_ctr_state(spark: SparkSession, path: str) -> int | None:
    """Write the days that new batches touch anew, with those batches; the other days stay
    where they are. Returns the number of the last batch folded, None if there is none."""
    held, new, batches = _ctr_parts(spark, path)
    if not batches or new.isEmpty():
        return None
    touched = new.select("day").distinct()
    rows = held.drop("upto").join(touched, "day", "left_semi").unionByName(new.drop("batch_id"))
    (_summed(rows).hint("rebalance", F.col("day")).sortWithinPartitions("day", "ad_id")
     .write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/{FOLDED}/upto={batches[-1]}"))
    return batches[-1]


def clear_folded(spark: SparkSession, path: str) -> int:
    """Delete what no reader looks at any more: batches that every day of theirs has folded
    and days that a newer run holds. Can be repeated; returns the number of folders gone."""
    fresh, folded = (f"{path.rstrip('/')}/{x}" for x in (FRESH, FOLDED))
    runs = _done(spark, folded, "upto")
    old = [f"{fresh}/batch_id={n}" for n in _done(spark, fresh, "batch_id") if runs and n <= runs[-1]]
    seen: set[str] = set()
    for n in reversed(runs):
        for day in files.children(spark, f"{folded}/upto={n}"):
            name = day.rsplit("/", 1)[1]
            if name.startswith("day="):
                old += [day] if name in seen else []
                seen.add(name)
    return files.delete(spark, old)


# X3 (event-time form) / X7 -- windowed counts with a watermark; late rows
# beyond it are dropped and counted by the query progress.
def windowed_pair_counts(partials: DataFrame, delay: str = "2 hours") -> DataFrame:
    return (partials.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day").alias("w"), "ad_id", "placement_id")
            .agg(F.sum("i").cast("bigint").alias("impressions"), F.sum("c").cast("bigint").alias("clicks")))


# X5 -- running campaign spend per UTC day; 48 h watermark = the key TTL.
def stream_spend(imps: DataFrame, delay: str = f"{K.BUDGET_KEY_TTL_SECONDS // 3600} hours") -> DataFrame:
    return (imps.filter(F.col("campaign_id").isNotNull())
            .withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day").alias("w"), "campaign_id")
            .agg(F.sum(F.round(F.col("win_price") * 1000).cast("bigint")).alias("micros"),
                 F.count(F.lit(1)).alias("impressions")))


def start_latest_wins(agg: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Update-mode aggregate -> per-batch folders; ``read_latest`` keeps the
    newest value per key (a retried batch overwrites its own folder)."""
    w = (agg.writeStream.outputMode("update").foreachBatch(_batch_writer(path))
         .option("checkpointLocation", checkpoint))
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in cols])


# X4 -- labels once the attribution window has closed (stream-stream join).
# A click inside the window labels its impression 1 as soon as both are there. An
# impression without one is labelled 0 when the watermark has passed the end of
# its window; until then it is open, stays in state, and is in no output.
def stream_labels(imps: DataFrame, clicks: DataFrame, window_hours: int = K.ATTRIBUTION_WINDOW_HOURS,
                  delay: str = f"{K.LABEL_CUTOFF_HOURS} hours") -> DataFrame:
    """Left outer interval join of impressions and clicks. An impression with
    several clicks in its window has a row for each; ``read_labels`` keeps the
    earliest, so the order of arrival does not matter."""
    i = imps.withWatermark("ts", delay).alias("i")
    c = clicks.select(F.col("impression_id").alias("c_imp"), F.col("ts").alias("c_ts")).withWatermark(
        "c_ts", delay).alias("c")
    cond = ((F.col("c_imp") == F.col("impression_id")) & (F.col("c_ts") >= F.col("ts"))
            & (F.col("c_ts") <= F.col("ts") + F.expr(f"INTERVAL {window_hours} HOURS")))
    j = i.join(c, cond, "leftOuter")
    return j.select("impression_id", "ts", "ad_id", "placement_id", F.col("c_ts").alias("click_ts"),
                    F.col("c_ts").isNotNull().cast("int").alias("label"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row per emitted impression, labelled by its earliest click in the window."""
    return (spark.read.parquet(path).groupBy("impression_id", "ts", "ad_id", "placement_id")
            .agg(F.min("click_ts").alias("click_ts"), F.max("label").alias("label")))


# X6 -- streaming auctions against snapshots re-read for every micro-batch.
SPEND_STATE = "campaign_id bigint, day date, spent_usd double"


def add_spend(ledger: DataFrame, spend: DataFrame) -> DataFrame:
    """The ledger with further spend added to its keys."""
    both = ledger.select("campaign_id", "day", "spent_usd").unionByName(spend.select("campaign_id", "day", "spent_usd"))
    return both.groupBy("campaign_id", "day").agg((F.sum(to_micros("spent_usd")) / 1e6).alias("spent_usd"))


def batch_spend(results: DataFrame) -> DataFrame:
    """(campaign_id, day, spent_usd) of auction results."""
    return (results.filter(F.col("campaign_id").isNotNull()).groupBy("campaign_id", "day")
            .agg((F.sum(to_micros("cost_usd")) / 1e6).alias("spent_usd")))


def spend_before(spark: SparkSession, state: str, batch_id: int, schema: str = SPEND_STATE) -> DataFrame:
    """What the batches before ``batch_id`` have spent: the state that the last one left."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/batch_id={batch_id - 1}")


def stream_auctions(requests: DataFrame, run_batch: Callable[[DataFrame, DataFrame], DataFrame], path: str,
                    checkpoint: str, trigger: dict | None = None, state_schema: str = SPEND_STATE) -> StreamingQuery:
    """``run_batch(batch, spent)`` re-reads the current inventory, statistics and
    ledger, adds ``spent`` (what the earlier batches of this stream have spent) and
    runs the batch auction (R1). Its result has campaign_id, day and cost_usd.
    Budgets are checked as of the batch start: overspend is bounded by one batch
    and visible to W6.

    Spend is a state table beside the results: state n is state n - 1 plus batch n,
    in a folder named by n. A retried batch reads state n - 1 again and replaces its
    own results and state. A micro-batch reads one state and its own rows, however
    old the stream; states before n - 1 are deleted."""
    state = f"{path.rstrip('/')}-spend"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{path.rstrip('/')}/batch_id={batch_id}"
        spent = spend_before(spark, state, batch_id, state_schema)
        results = run_batch(batch, spent)
        results.write.mode("overwrite").parquet(own)
        done = spark.read.schema(results.schema).parquet(own)
        add_spend(spent, batch_spend(done)).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        files.delete(spark, [f"{state}/batch_id={batch_id - 2}"])

    w = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


# X7 -- late rows dropped by the watermark, summed over every micro-batch.
class LateRows(StreamingQueryListener):
    """Counts late rows of all queries of a session from the progress of each
    micro-batch (``recentProgress`` keeps only the last ones)."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, wait_s: float = 60.0) -> int:
        """Late rows of a query that has ended. Events arrive a little later than
        the end itself; a count that does not become complete is an error."""
        until = time.monotonic() + wait_s
        while str(query.runId) not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError("the query's last progress has not arrived")
            time.sleep(0.05)
        return self.dropped.get(str(query.runId), 0)


def count_late_rows(spark: SparkSession, run: Callable[[], StreamingQuery]) -> int:
    """Run a stream to its end and return how many rows its watermarks dropped."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        return listener.of(run())
    finally:
        spark.streams.removeListener(listener)


def run_available_now(start: Callable[[dict], StreamingQuery], timeout_s: float | None = None) -> StreamingQuery:
    """Start with ``availableNow`` and wait until everything present is processed.
    With ``timeout_s`` a stream that is still running then is stopped and reported
    as an error, never read half-written."""
    q = start({"availableNow": True})
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream still running after {timeout_s} s; its output is incomplete")
    return q

