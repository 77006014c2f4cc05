"""The auction by postings against the auction over all scored pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from adflow.operators import postings as PO
from adflow.operators import stats as S
from adflow.plans import auction as AU

T0 = dt.datetime(2024, 1, 1, 12)
INVENTORY = ("ad_id string, campaign_id string, advertiser_id string, target_cpm double, floor_price double, target_device string, "
             "target_keywords array<string>, daily_budget_usd double, created_at timestamp_ntz")
REQUESTS = ("request_id string, publisher_id string, placement_id string, device_type string, page_keywords array<string>, "
            "server_ts timestamp_ntz")
RESULT = ["request_id", "ad_id", "bid_value", "win_price", "is_exploration", "n_candidates", "predicted_ctr"]


def _tables(spark, ads, requests, pairs, ledger):
    stats = S.rollup_tables(S.ctr_rollup(spark.createDataFrame(pairs, "ad_id string, placement_id string, impressions long, clicks long")))
    return (spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(ads, INVENTORY), stats,
            spark.createDataFrame(ledger, "campaign_id string, day date, spent_usd double"))


def _random_case(seed, n_ads=60, n_requests=80, words=12, keywords=5):
    rng = random.Random(seed)
    vocabulary = [f"k{i}" for i in range(words)]
    ads = [(f"a{i:03d}", rng.choice(["c1", "c2", "c3", "c4", None]), "v", rng.choice([0.5, 2.0, 2.0, 5.0, 5.0, 9.0, -1.0]), 1.0,
            rng.choice(["all", "mobile", "desktop"]), rng.sample(vocabulary, rng.randrange(keywords + 1)), rng.choice([1.0, 5.0]), T0)
           for i in range(n_ads)]
    requests = [(f"r{i:03d}", "p", rng.choice(["x", "y", "z", None]), rng.choice(["mobile", "desktop", "tablet", "watch"]),
                 rng.choice([None, rng.sample(vocabulary, rng.randrange(7))]), T0 + dt.timedelta(days=rng.randrange(2))) for i in range(n_requests)]
    pairs = [(a, p, i, rng.randrange(i // 2 + 1)) for a, p in {(rng.choice(ads)[0], rng.choice(["x", "y", "w"])) for _ in range(50)}
             for i in [rng.choice([1, 50, 5000])]]
    ledger = [(c, T0.date() + dt.timedelta(days=k), rng.choice([0.0, 2.0, 9.0])) for c in ("c1", "c2", "c3") for k in range(2)]
    return ads, requests, pairs, ledger


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_the_scored_pairs(spark, seed):
    """Ties, budgets, unknown devices, missing placements and keywords, exceptions of both signs."""
    requests, inventory, stats, ledger = _tables(spark, *_random_case(seed))
    for spent, epsilon in ((ledger, 0.0), (ledger, 0.5), (None, 0.0)):
        fast, _ = AU.run_auctions(requests, inventory, stats, ledger=spent, epsilon=epsilon)
        slow, _ = AU.run_auctions(requests, inventory, stats, ledger=spent, epsilon=epsilon, scorer=AU.baseline_scorer)
        want = sorted(map(tuple, slow.select(RESULT).collect()))
        assert sorted(map(tuple, fast.select(RESULT).collect())) == want and want


def test_ads_with_a_hundred_keywords(spark):
    """Postings grow with the keywords, not with their subsets; the boost stops at four of them."""
    ads, requests, pairs, ledger = _random_case(9, n_ads=12, n_requests=40, words=120, keywords=100)
    ads = [(*a[:6], [f"k{i}" for i in range(j, j + 100)], *a[7:]) for j, a in enumerate(ads)]
    requests = [(*r[:4], [f"k{i}" for i in range(n % 9, n % 9 + 30)], r[5]) for n, r in enumerate(requests)]
    requests, inventory, stats, ledger = _tables(spark, ads, requests, pairs, ledger)
    by_device = PO.by_device(inventory)
    index = PO.build(by_device, stats)
    valid = by_device.filter("target_cpm >= 0")
    exceptions = valid.join(stats[S.LEVEL_PAIR], "ad_id").count()
    assert index.postings.count() == 101 * (valid.count() + exceptions)
    fast, _ = AU.run_auctions(requests, inventory, stats, ledger=ledger, epsilon=0.0)
    slow, _ = AU.run_auctions(requests, inventory, stats, ledger=ledger, epsilon=0.0, scorer=AU.baseline_scorer)
    assert sorted(map(tuple, fast.select(RESULT).collect())) == sorted(map(tuple, slow.select(RESULT).collect()))


def test_blocks_double_and_bounds_cover_what_follows(spark):
    ads = [(f"a{i:03d}", "c", "v", float(i % 17), 1.0, "mobile", ["k"], 1.0, T0) for i in range(100)]
    _, inventory, stats, _ = _tables(spark, ads, [("r", "p", "x", "mobile", ["k"], T0)], [("a000", "q", 1, 0)], [("c", T0.date(), 0.0)])
    index = PO.build(PO.by_device(inventory), stats)
    rows = index.postings.filter("every AND NOT exception").groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in rows] == [4, 8, 16, 32, 40]
    bounds = {(r.every, r.keyword, r.exception, r.block): r.tops for r in index.bounds.collect()}
    for r in index.postings.collect():
        for n in range(PO.MOST_SHARED + 1):
            for block in range(r.block + 1):
                top = bounds[r.every, r.keyword, r.exception, block][n]
                assert (top.low, top.ad_id) <= (r.low[n], r.ad_id)


def test_positions_of_listed_ads(spark):
    requests, inventory, stats, ledger = _tables(spark, *_random_case(4))
    ctx = AU.request_context(requests)
    got = {}
    for r in AU.listed_ads(ctx, inventory, ledger).collect():
        got.setdefault((r.device_type, r.day), {})[r._pos] = r.ad_id
    counts = {(r.device_type, r.day): r.n_candidates for r in AU.eligibility(ctx, inventory, ledger).collect()}
    assert got and {k: len(v) for k, v in got.items()} == counts
    for v in got.values():
        assert sorted(v) == list(range(len(v))) and [v[i] for i in sorted(v)] == sorted(v.values())


def test_no_window_over_a_device_and_no_product(spark):
    requests, inventory, stats, ledger = _tables(spark, *_random_case(5))
    listed = AU.listed_ads(AU.request_context(requests), inventory, ledger)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in listed.splitlines() if " Window " in line]
    assert windows and all("_piece" in line for line in windows)
    met = PO._scored(spark.createDataFrame([], "cid long, ad_id string"), spark.createDataFrame(
        [], "cid long, device_type string, day date, placement_id string, page_keywords array<string>, request_floor double"),
        inventory.select("ad_id", "campaign_id", "target_cpm", "target_keywords", "daily_budget_usd"), stats, ledger)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_keyword_of_half_the_ads_is_split(spark):
    """A list is ranked in range pieces, so a keyword that half the ads hold is no single task."""
    ads = [(f"a{i:04d}", "c", "v", 1.0 + i % 7, 1.0, "mobile", ["hot"], 1.0, T0) for i in range(2000)]
    _, inventory, stats, _ = _tables(spark, ads, [("r", "p", "x", "mobile", ["hot"], T0)], [("a0000", "q", 1, 0)], [("c", T0.date(), 0.0)])
    index = PO.build(PO.by_device(inventory), stats)
    ranks = index.postings.filter((F.col("keyword") == "hot") & ~F.col("exception")).groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    assert [r.n for r in ranks[:-1]] == [4 * 2**k for k in range(len(ranks) - 1)] and sum(r.n for r in ranks) == 2000


def test_rounds_broadcast_nothing_that_grows(spark, monkeypatch):
    """Tables whose files are small are shuffled too: contexts, ads, ledger, statistics and lists."""
    requests, inventory, stats, ledger = _tables(spark, *_random_case(6))
    plans = []
    written = PO.checkpoint
    monkeypatch.setattr(PO, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    stats = {k: v if k == S.LEVEL_GLOBAL else written(v) for k, v in stats.items()}
    contexts = written(AU.request_context(requests).select(*PO.CONTEXT).distinct().withColumn("cid", F.monotonically_increasing_id()))
    ads = written(inventory.select("ad_id", "campaign_id", "target_cpm", "target_keywords", "daily_budget_usd"))
    index = PO.build(PO.by_device(inventory), stats)
    del plans[:]
    assert PO.best_two(contexts, index, ads, stats, written(ledger)).count()
    assert len(plans) > 4 and not [p for p in plans if "BroadcastExchange" in p]


def test_lists_of_every_ad_are_read_in_parts(spark):
    """Each context reads every ad of its lists once, whichever part it belongs to."""
    lists = spark.createDataFrame([("mobile", False, "", True, "", 1), ("mobile", False, "", False, "k", 2)],
                                  "device_type string, exception boolean, list_placement string, every boolean, keyword string, ad long")
    contexts = spark.range(40).withColumnRenamed("id", "cid").crossJoin(lists.drop("ad"))
    read = PO._reading(contexts).join(PO._read(lists), [*PO.LIST, "salt"])
    assert sorted((r.cid, r.ad) for r in read.collect()) == [(i, a) for i in range(40) for a in (1, 2)]
    assert read.filter("every").select("salt").distinct().count() == PO.SALTS
