"""State of streams: folds that survive a crash, spend carried from batch to batch, exact retention."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from adflow.sources import files
from adflow.sources import ingest as G
from adflow.sources import sinks as SK
from adflow.streaming import jobs as J


def _write_batch(spark, path, n, rows):
    spark.createDataFrame(rows, J.CTR_STATE).write.mode("overwrite").parquet(f"{path}/{J.FRESH}/batch_id={n}")


def _day(k):
    return dt.date(2024, 1, k)


BATCHES = [[(_day(1), 1, "p", 5, 1), (_day(2), 1, "p", 2, 0)], [(_day(2), 1, "p", 3, 1), (_day(2), 2, "q", 1, 0)],
           [(_day(3), 1, "p", 7, 2)], [(_day(2), 1, "p", 4, 1)]]


def _total(batches):
    out = {}
    for rows in batches:
        for d, a, p, i, c in rows:
            x = out.setdefault((d, a, p), [0, 0])
            x[0] += i
            x[1] += c
    return {k: tuple(v) for k, v in out.items()}


def _state(spark, path):
    return {(r.day, r.ad_id, r.placement_id): (r.impressions, r.clicks) for r in J.read_ctr_state(spark, path).collect()}


def test_folds_keep_the_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert J.read_ctr_state(spark, path).count() == 0 and J.fold_ctr_state(spark, path) is None
    for n, rows in enumerate(BATCHES):
        _write_batch(spark, path, n, rows)
        assert _state(spark, path) == _total(BATCHES[:n + 1])
        if n != 1:
            assert J.fold_ctr_state(spark, path) == n
            assert _state(spark, path) == _total(BATCHES[:n + 1])
            J.clear_folded(spark, path)
            assert _state(spark, path) == _total(BATCHES[:n + 1])
    assert J.fold_ctr_state(spark, path) is None  # nothing new
    # One file for each day, however many batches there were.
    assert files.children(spark, f"{path}/{J.FRESH}") == []
    parts = [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert len(parts) == 3


def test_a_fold_that_dies_counts_nothing_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    for n, rows in enumerate(BATCHES[:2]):
        _write_batch(spark, path, n, rows)
    J.fold_ctr_state(spark, path)
    for n, rows in enumerate(BATCHES[2:], 2):
        _write_batch(spark, path, n, rows)
    want = _total(BATCHES)
    # It dies while it writes: files of the new run are there, its mark is not.
    J.fold_ctr_state(spark, path)
    os.remove(f"{path}/{J.FOLDED}/upto=3/_SUCCESS")
    assert _state(spark, path) == want
    # It is run again, and dies between write and delete, and half-way through the delete.
    assert J.fold_ctr_state(spark, path) == 3
    assert _state(spark, path) == want
    monkeypatch.setattr(J.files, "delete", _first_two)
    with pytest.raises(RuntimeError):
        J.clear_folded(spark, path)
    assert _state(spark, path) == want
    monkeypatch.undo()
    J.clear_folded(spark, path)
    assert _state(spark, path) == want


def _first_two(spark, paths):
    import shutil

    for p in paths[:2]:
        shutil.rmtree(p.removeprefix("file:"))
    raise RuntimeError("killed")


def test_a_batch_that_did_not_finish_is_not_read(spark, tmp_path):
    path = str(tmp_path / "state")
    _write_batch(spark, path, 0, BATCHES[0])
    _write_batch(spark, path, 1, BATCHES[1])
    os.remove(f"{path}/{J.FRESH}/batch_id=1/_SUCCESS")
    assert _state(spark, path) == _total(BATCHES[:1])


def _auction_stream(spark, tmp_path, batches, run_batch):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for _ in range(batches):
        spark.createDataFrame([(1, dt.date(2024, 1, 1), 0.25), (None, dt.date(2024, 1, 1), 9.0)],
                              "campaign_id long, day date, cost_usd double").coalesce(1).write.mode("append").parquet(src)
    stream = J.event_stream(spark, src, "campaign_id bigint, day date, cost_usd double", max_files_per_trigger=1)
    J.run_available_now(lambda trig: J.stream_auctions(stream, run_batch, out, ck, trig))
    return out


def test_spend_is_carried_by_one_state(spark, tmp_path):
    """Every batch sees the sum of all earlier ones, though their results and states are gone."""
    seen = []

    def run_batch(batch, spent):
        seen.append([tuple(r) for r in spent.collect()])
        for path in [p for p in files.children(batch.sparkSession, str(tmp_path / "out")) if "batch_id=" in p]:
            files.delete(batch.sparkSession, [path])  # nothing but the state is needed
        return batch

    out = _auction_stream(spark, tmp_path, 4, run_batch)
    day = dt.date(2024, 1, 1)
    assert seen == [[], [(1, day, 0.25)], [(1, day, 0.5)], [(1, day, 0.75)]]
    left = [p.rsplit("=", 1)[1] for p in files.children(spark, f"{out}-spend")]
    assert left == ["2", "3"]


def test_a_retried_batch_replaces_its_state(spark, tmp_path):
    """Batch 1 fails after it has written everything; run again it counts once."""
    calls = []

    def run_batch(batch, spent):
        calls.append(spent.agg(F.sum("spent_usd")).first()[0])
        return batch

    real = files.delete

    def dies(s, paths):
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(s, paths)

    J.files.delete = dies
    try:
        with pytest.raises(Exception, match="killed"):
            _auction_stream(spark, tmp_path, 3, run_batch)
    finally:
        J.files.delete = real
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    stream = J.event_stream(spark, src, "campaign_id bigint, day date, cost_usd double", max_files_per_trigger=1)
    J.run_available_now(lambda trig: J.stream_auctions(stream, run_batch, out, ck, trig))
    assert calls == [None, 0.25, 0.25, 0.5]


def test_retention_is_exact_to_the_row(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "ad_id long, ts timestamp_ntz").withColumn("event_date", F.to_date("ts"))
    SK.write_log(df, path)
    untouched = {p: os.path.getmtime(os.path.join(d, p)) for d, _, fs in os.walk(path) for p in fs if "event_date=2024-01-04" in d}
    for _ in range(2):  # it can be repeated
        SK.expire_rows(spark, path, "2024-01-13 09:00:00", days=10)  # cutoff 2024-01-03 09:00
        left = [r.ts for r in spark.read.parquet(path).orderBy("ts").collect()]
        assert left == [t for _, t in rows if t >= dt.datetime(2024, 1, 3, 9)]
    assert untouched == {p: os.path.getmtime(os.path.join(d, p)) for d, _, fs in os.walk(path) for p in fs if "event_date=2024-01-04" in d}
    SK.expire_rows(spark, path, "2024-01-13 23:00:00", days=10)  # no row of the border day is left
    assert spark.read.parquet(path).agg(F.min("ts")).first()[0] == dt.datetime(2024, 1, 4)


def test_messages_are_parsed_once_for_all_outputs(spark, tmp_path):
    from adflow.operators.materialize import checkpoint
    from adflow.plans.catalog import ingest as CI

    raw = checkpoint(CI.wire_impressions(spark, "/root/testdata/sf0.001"))
    tagged = G.tagged_impressions(raw, CI.INT_ID)._jdf.queryExecution().executedPlan().toString()
    assert tagged.count("from_json") == 1
    outputs = G.fan_out(raw, str(tmp_path / "tagged"), CI.INT_ID)
    alone = G.parse_impressions(raw, CI.INT_ID)
    for got, want in zip(outputs, alone, strict=True):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "from_json" not in plan and "PartitionFilters: [isnotnull(outcome" in plan
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
