"""Streaming queries (X1-X7), each run to completion with ``availableNow``
over the events table as a file stream, then read back from its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...session import ensure_checkpoint_dir
from ...streaming import jobs as J
from ..registry import query
from .auction import AUCTION_SQL
from .common import fx, round6, with_views


def _scratch(spark, name):
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/stream-{name}-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/checkpoint"


def _events(spark, d):
    return J.event_stream(spark, d, file_glob="events.parquet")


def _click_topic(spark, d):
    """The click events as they are published, with ad and placement, as a stream."""
    path = f"{_scratch(spark, 'clicks')[0]}-topic"
    clicks = fx.clicks(spark, d).select("impression_id", "ts", "ad_id", "placement_id")
    clicks.write.parquet(path)
    return J.event_stream(spark, path, clicks.schema)


@query("stream_ctr_pair", ("X3", "A1"), with_views(("pair_daily_v",), """
    SELECT CAST(day AS VARCHAR) AS day, ad_id, placement_id, impressions, clicks FROM pair_daily_v"""))
def stream_ctr_pair(spark, d):
    out, ck = _scratch(spark, "ctr")
    both = J.pair_partials(fx.impressions(spark, d, events=_events(spark, d)), _click_topic(spark, d))
    J.run_available_now(lambda trig: J.stream_ctr_pair(both, lambda batch: batch, out, ck, trig))
    J.fold_ctr_state(spark, out)
    J.clear_folded(spark, out)
    return J.read_ctr_state(spark, out).withColumn("day", F.col("day").cast("string"))


@query("stream_ingest", ("X1", "S7"), with_views(("impressions_v",), """
    SELECT impression_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM impressions_v"""))
def stream_ingest(spark, d):
    out, ck = _scratch(spark, "ingest")
    imps = fx.impressions(spark, d, events=_events(spark, d)).withColumn("event_date", F.to_date("ts"))
    J.run_available_now(lambda trig: J.start_ingest(imps, out, ck, trig))
    return spark.read.parquet(out).select("impression_id", F.col("event_date").cast("string").alias("event_date"))


@query("impression_log", ("S7",), with_views(("impressions_v",), """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS n_rows, min(ad_id) AS first_ad,
           round(sum(win_price), 3) AS win_price FROM impressions_v GROUP BY 1"""))
def impression_log(spark, d):
    from ...sources.sinks import write_log

    out, _ = _scratch(spark, "log")
    write_log(fx.impressions(spark, d).withColumn("event_date", F.to_date("ts")), out)
    log = spark.read.parquet(out)
    return log.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ad_id").alias("first_ad"),
        F.round(F.sum("win_price"), 3).alias("win_price"))


# One event in fifty arrives after all others have been processed.
@query("late_events", ("X7",), with_views(("impressions_v",), """
    SELECT count(*) FILTER (WHERE impression_id % 50 = 7
                            AND CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 2 HOUR FROM impressions_v
                                                         WHERE impression_id % 50 <> 7)) AS dropped
    FROM impressions_v"""))
def late_events(spark, d):
    out, ck = _scratch(spark, "late")
    topic = f"{out}-topic"
    imps = J.with_event_time(fx.impressions(spark, d)).select(
        "impression_id", "ts", F.col("impression_id").alias("ad_id"), "placement_id",  # counted one by one
        F.lit(1).alias("i"), F.lit(0).alias("c"))
    late = F.col("impression_id") % 50 == 7
    dropped = 0
    for part in (imps.filter(~late), imps.filter(late)):
        part.write.mode("append").parquet(topic)
        # The stream goes on from its checkpoint and sees the new files only.
        counts = J.windowed_pair_counts(J.event_stream(spark, topic, imps.schema), "2 hours")
        dropped += J.count_late_rows(spark, lambda: J.run_available_now(
            lambda trig: J.start_latest_wins(counts, out, ck, trig)))
    return spark.createDataFrame([(dropped,)], "dropped bigint")


def _in_turns(spark, name, parts, start):
    """Delivers ``parts`` one after another to a stream that goes on from its checkpoint:
    ``start(topic rows, output, checkpoint)`` makes the stream of each turn."""
    out, ck = _scratch(spark, name)
    topic = f"{out}-topic"
    for part in parts:
        part.write.mode("append").parquet(topic)
        J.run_available_now(lambda trig: start(J.event_stream(spark, topic, part.schema), out, ck, trig))
    return out


# The first half of the time, the second half, then one event in fifty of all days: what
# is behind the watermark (48 h before the newest event) is not counted any more.
@query("stream_spend", ("X5", "A5"), with_views(("impressions_v",), """
    SELECT campaign_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
           CAST(sum(CAST(round(win_price * 1000) AS BIGINT)) AS DOUBLE) / 1000000.0 AS spent_usd, count(*) AS impressions
    FROM impressions_v
    WHERE campaign_id IS NOT NULL
      AND (impression_id % 50 <> 7 OR CAST(ts AS DATE) + 1 > (SELECT max(ts) - INTERVAL 48 HOUR FROM impressions_v
                                                              WHERE impression_id % 50 <> 7))
    GROUP BY campaign_id, CAST(ts AS DATE)"""))
def stream_spend(spark, d):
    imps = J.with_event_time(fx.impressions(spark, d)).select("impression_id", "campaign_id", "ts", "win_price")
    late, early = F.col("impression_id") % 50 == 7, F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    parts = (imps.filter(~late & early), imps.filter(~late & ~early), imps.filter(late))
    out = _in_turns(spark, "spend", parts, lambda rows, out, ck, trig: J.start_latest_wins(J.stream_spend(rows), out, ck, trig))
    latest = J.read_latest(spark, out, ["w", "campaign_id"])
    return latest.select("campaign_id", F.to_date(F.col("w.start")).cast("string").alias("day"),
                         (F.col("micros") / 1e6).alias("spent_usd"), "impressions")


# At-least-once delivery: a third of the events comes twice, and one in eleven again at
# the end. What the state still knows is dropped; an event whose state has been let go
# (its time plus the delay is behind the watermark) passes again.
@query("stream_dedup", ("X2", "S12"), with_views(("impressions_v",), """
    SELECT impression_id, 'first' AS delivery FROM impressions_v
    UNION ALL
    SELECT impression_id, 'again' FROM impressions_v
    WHERE impression_id % 11 = 5 AND ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM impressions_v)"""))
def stream_dedup(spark, d):
    imps = J.with_event_time(fx.impressions(spark, d)).select("impression_id", "ts")
    newest = imps.select(F.max("ts")).scalar()
    first = imps.withColumn("delivery", F.lit("first"))
    again = imps.filter(F.col("impression_id") % 11 == 5).select(
        "impression_id", (newest + F.expr("INTERVAL 1 MINUTE")).alias("ts"), F.lit("again").alias("delivery"))
    parts = (first.unionByName(first.filter(F.col("impression_id") % 3 == 0)), again)

    def start(rows, out, ck, trig):
        return (J.dedup_stream(rows, "impression_id", "2 hours").writeStream.format("parquet")
                .option("checkpointLocation", ck).trigger(**trig).start(out))
    out = _in_turns(spark, "dedup", parts, start)
    return spark.read.parquet(out).select("impression_id", "delivery")


@query("stream_labels", ("X4",), with_views(("impressions_v", "raw_clicks_v"), """
    SELECT i.impression_id, CAST(strftime(min(c.ts), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS click_ts,
           CAST(count(c.ts) > 0 AS INTEGER) AS label
    FROM impressions_v i LEFT JOIN raw_clicks_v c
      ON c.impression_id = i.impression_id AND c.ts >= i.ts AND c.ts <= i.ts + INTERVAL 1 HOUR
    GROUP BY i.impression_id, i.ts
    HAVING count(c.ts) > 0 OR i.ts + INTERVAL 1 HOUR <
      (SELECT least((SELECT max(ts) FROM impressions_v), (SELECT max(ts) FROM raw_clicks_v)) - INTERVAL 2 HOUR)"""))
def stream_labels(spark, d):
    """Labels of closed windows; what is still open at the end of input is not in it."""
    out, ck = _scratch(spark, "labels")
    ev = _events(spark, d)
    imps = J.with_event_time(fx.impressions(spark, d, events=ev))
    clicks = J.with_event_time(fx.raw_clicks(spark, d, events=ev))
    labels = J.stream_labels(imps, clicks)

    def start(trig):
        return (labels.writeStream.format("parquet").outputMode("append").option("checkpointLocation", ck)
                .trigger(**trig).start(out))
    J.run_available_now(start)
    return J.read_labels(spark, out).select(
        "impression_id", F.date_format("click_ts", "yyyy-MM-dd HH:mm:ss").alias("click_ts"), "label")


def auction_batches(spark, d):
    """run_batch of X6: the snapshots are read anew for each micro-batch."""
    from .. import auction as AU
    from .auction import SEED, _snapshots, _stats

    def run_batch(batch, spent):
        inventory, ledger = _snapshots(spark, d)
        res, _ = AU.run_auctions(fx.requests(spark, d, events=batch), inventory, _stats(spark, d),
                                 ledger=J.add_spend(ledger, spent), epsilon=0.0, seed=SEED)
        return res.withColumn("day", F.to_date("request_ts")).drop("features")

    return run_batch


@query("stream_auction_results", ("X6", "R1"), AUCTION_SQL)
def stream_auction_results(spark, d):
    from .auction import _result_columns

    out, ck = _scratch(spark, "auction")
    J.run_available_now(lambda trig: J.stream_auctions(_events(spark, d), auction_batches(spark, d), out, ck, trig))
    return _result_columns(spark.read.parquet(out))


del round6
