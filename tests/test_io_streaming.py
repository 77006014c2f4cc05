"""Sinks, snapshots, streaming ingest, late data and the model registry."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from adflow import constants as K
from adflow.sources import ingest as G
from adflow.sources import sinks as SK
from adflow.streaming import jobs as J
from conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="adflow-test-", dir="/tmp")


def test_write_log_partitions_and_expiry(spark):
    rows = [(f"i{i}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "a", 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "impression_id string, ts timestamp, ad_id string, win_price double") \
        .withColumn("event_date", F.to_date("ts"))
    path = os.path.join(_tmp(), "log")
    SK.write_log(df, path)
    assert spark.read.parquet(path).count() == 5
    removed = SK.expire_partitions(spark, path, "2024-04-02", days=90)  # cutoff 2024-01-03
    assert sorted(removed) == ["event_date=2024-01-01", "event_date=2024-01-02"]
    assert spark.read.parquet(path).count() == 3
    kept = SK.apply_retention(spark.read.parquet(path), "2024-04-02", 90)
    assert kept.count() == 3


def test_snapshot_pointer_flip_and_failed_refresh(spark):
    base = os.path.join(_tmp(), "inv")
    v1 = SK.refresh_snapshot(spark.createDataFrame([("a",)], "ad_id string"), base)
    assert [r.ad_id for r in SK.read_snapshot(spark, base).collect()] == ["a"]
    bad = spark.createDataFrame([("x",)], "s string").select(F.raise_error("boom").alias("ad_id"))
    with pytest.raises(Exception):
        SK.refresh_snapshot(bad, base)
    assert [r.ad_id for r in SK.read_snapshot(spark, base).collect()] == ["a"]  # old one still served
    SK.refresh_snapshot(spark.createDataFrame([("b",)], "ad_id string"), base)
    assert [r.ad_id for r in SK.read_snapshot(spark, base).collect()] == ["b"]
    assert os.path.exists(v1)


def test_json_parse_tolerance(spark):
    msgs = [
        json.dumps({"impression_id": "0b7f5d8e-2b8a-4a53-9a4f-1b2c3d4e5f60", "ts": "2024-01-01T00:00:01+00:00",
                    "ad_id": "a1", "feature_version": 2, "features": [0.1, 0.2], "win_price": 2.5,
                    "is_exploration": 1, "unknown": "x"}),
        json.dumps({"impression_id": "0b7f5d8e-2b8a-4a53-9a4f-1b2c3d4e5f61", "ts": "2024-01-01T00:00:02Z",
                    "filled": False}),
        '{"impression_id": "0b7f5d8e',
        json.dumps({"impression_id": "not-a-uuid", "ts": "2024-01-01T00:00:02Z", "ad_id": "a"}),
        json.dumps({"impression_id": "0b7f5d8e-2b8a-4a53-9a4f-1b2c3d4e5f62", "ts": "yesterday", "ad_id": "a"}),
    ]
    raw = spark.createDataFrame([(m,) for m in msgs], "value string")
    served, no_fill, bad = G.parse_impressions(raw)
    s = served.collect()
    assert len(s) == 1 and s[0].is_exploration is True and s[0].model_version == "baseline"
    assert no_fill.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["bad_impression_id", "bad_timestamp", "malformed_json"]
    clicks = spark.createDataFrame([('{"impression_id": "", "clicked_at_ms": 1}',),
                                    ('{"impression_id": "0b7f5d8e-2b8a-4a53-9a4f-1b2c3d4e5f60", '
                                     '"clicked_at_ms": 1704067200123, "ad_id": "a1"}',)], "value string")
    good, bad = G.parse_clicks(clicks)
    g = good.collect()
    assert len(g) == 1 and g[0].ts == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert bad.count() == 1


def test_streaming_ingest_from_json_files(spark):
    src = os.path.join(_tmp(), "topic")
    os.makedirs(src)
    with open(os.path.join(src, "part-0.json"), "w") as fh:
        for i in range(20):
            fh.write(json.dumps({"impression_id": f"0b7f5d8e-2b8a-4a53-9a4f-1b2c3d4e{i:04d}",
                                 "ts": f"2024-01-0{1 + i % 3}T00:00:00Z", "ad_id": "a",
                                 "feature_version": 2, "features": [0.5], "win_price": 1.0}) + "\n")
        fh.write("{broken\n")
    served, _, _ = G.parse_impressions(G.read_events(spark, "impressions", path=src))
    out, ck = os.path.join(_tmp(), "log"), os.path.join(_tmp(), "ck")
    J.run_available_now(lambda trig: J.start_ingest(served, out, ck, trig))
    log = spark.read.parquet(out)
    assert log.count() == 20
    assert sorted(r.event_date for r in log.select("event_date").distinct().collect()) == \
        [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def test_late_rows_are_dropped_and_counted(spark):
    src = os.path.join(_tmp(), "late")
    os.makedirs(src)
    schema = "ts timestamp, ad_id string, placement_id string, i int, c int"
    batches = [
        [(dt.datetime(2024, 1, 10, 12), "a", "p", 1, 0)],
        [(dt.datetime(2024, 1, 12, 12), "a", "p", 1, 0)],  # advances the watermark to 2024-01-12 10:00
        [(dt.datetime(2024, 1, 10, 13), "a", "p", 1, 0)],  # behind the watermark: dropped
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).write.mode("overwrite").parquet(os.path.join(src, f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(os.path.join(src, "*"))
    agg = J.windowed_pair_counts(stream, "2 hours")
    out, ck = os.path.join(_tmp(), "out"), os.path.join(_tmp(), "ck")
    late = J.count_late_rows(spark, lambda: J.run_available_now(
        lambda trig: J.start_latest_wins(agg, out, ck, trig)))
    assert late == 1
    latest = J.read_latest(spark, out, ["w", "ad_id", "placement_id"])
    day10 = latest.filter(F.to_date(F.col("w.start")) == F.lit("2024-01-10")).first()
    assert day10.impressions == 1


def test_model_training_registry_and_scoring(spark):
    from adflow.plans import training as T
    from adflow.plans import auction as AU
    from adflow.plans.catalog import training as CT
    from adflow.plans.catalog import auction as CA
    from adflow.operators.materialize import snapshot
    from adflow.sources import fixtures as fx

    d = "/root/testdata/sf0.01"
    res = T.run_training(CT.labelled(spark, d), T.TrainConfig(num_rounds=4, patience=2, max_depth=3))
    assert res.metadata["feature_version"] == K.FEATURE_VERSION
    assert set(res.metadata["metrics"]) == {"model", "model_uncalibrated", "model_raw", "baseline"}
    assert isinstance(res.gate_failures, list)
    out = _tmp()
    vdir = T.save_model(res, out)
    T.promote(spark, out, vdir)
    scorer, meta = T.load_model(spark, out)
    assert scorer is not None and meta["n_features"] == K.N_FEATURES
    # a model trained on another feature contract is refused
    bad = dict(meta, feature_version=1)
    spark.createDataFrame([(json.dumps(bad),)], "m string").coalesce(1).write.mode("overwrite").text(
        os.path.join(vdir, "metadata"))
    refused, reason = T.load_model(spark, out)
    assert refused is None and "feature_version" in reason
    # score a batch auction with the model (M7)
    inv = snapshot(CA.servable(spark, SF_SMALL).select(*AU.SCORING_COLUMNS))
    results, _ = AU.run_auctions(fx.requests(spark, SF_SMALL), inv, CA._stats(spark, SF_SMALL),
                                 ledger=fx.ledger(spark, SF_SMALL), scorer=scorer, epsilon=0.0)
    rows = results.select("predicted_ctr", "model_version", F.size("features").alias("n")).collect()
    assert rows and all(K.MIN_CTR <= r.predicted_ctr <= K.MAX_CTR and r.n == K.N_FEATURES for r in rows)
    assert {r.model_version for r in rows} == {meta["model_version"]}


def test_a_stream_that_does_not_end_is_an_error(spark):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    out, ck = os.path.join(_tmp(), "out"), os.path.join(_tmp(), "ck")

    def start(trigger):  # ignores the trigger and goes on
        return (rate.writeStream.format("parquet").option("checkpointLocation", ck)
                .trigger(processingTime="1 second").start(out))
    with pytest.raises(TimeoutError):
        J.run_available_now(start, timeout_s=3)
    assert not spark.streams.active


def test_streamed_auctions_draw_budgets_down(spark):
    """Two micro-batches of the same requests: what the first spent is in the second's ledger."""
    from adflow.plans.catalog.streaming import auction_batches

    d = SF_SMALL
    src, out, ck = (os.path.join(_tmp(), x) for x in ("src", "out", "ck"))
    events = spark.read.parquet(f"{d}/events.parquet").coalesce(1)
    for _ in range(2):
        events.write.mode("append").parquet(src)
    stream = J.event_stream(spark, src, max_files_per_trigger=1)
    J.run_available_now(lambda trig: J.stream_auctions(stream, auction_batches(spark, d), out, ck, trig))
    res = spark.read.parquet(out)
    first = res.filter("batch_id = 0").groupBy("campaign_id", "day").agg(F.sum("cost_usd").alias("s"))
    budget = res.select("campaign_id", "daily_budget_usd").distinct()
    over = first.join(budget, "campaign_id").filter("s >= daily_budget_usd")
    again = res.filter("batch_id = 1").join(over, ["campaign_id", "day"], "left_semi")
    assert over.count() > 0 and again.count() == 0


def test_labels_do_not_depend_on_the_order_of_clicks(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    src_i, src_c, out, ck = (os.path.join(_tmp(), x) for x in ("i", "c", "out", "ck"))
    imps = [("a", t0), ("b", t0), ("z", t0 + dt.timedelta(days=1))]
    clicks = [("a", t0 + dt.timedelta(minutes=50)), ("a", t0 + dt.timedelta(minutes=5)),
              ("b", t0 + dt.timedelta(hours=2)), ("q", t0 + dt.timedelta(days=1))]
    spark.createDataFrame([(i, t, "ad", "pl") for i, t in imps],
                          "impression_id string, ts timestamp, ad_id string, placement_id string").write.parquet(src_i)
    spark.createDataFrame(clicks, "impression_id string, ts timestamp").write.parquet(src_c)
    i = spark.readStream.schema(spark.read.parquet(src_i).schema).parquet(src_i)
    c = spark.readStream.schema(spark.read.parquet(src_c).schema).parquet(src_c)
    labels = J.stream_labels(i, c)
    J.run_available_now(lambda trig: labels.writeStream.format("parquet").outputMode("append")
                        .option("checkpointLocation", ck).trigger(**trig).start(out))
    got = {r.impression_id: (r.label, r.click_ts) for r in J.read_labels(spark, out).collect()}
    assert got == {"a": (1, t0 + dt.timedelta(minutes=5)), "b": (0, None)}  # z is still open
