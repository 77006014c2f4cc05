"""Set-oriented second-price auction over a whole request table (R1 and
its parts J2, J3, J5, F9, M7, W1, W2, F13-F16, J11, R2).

Two plans give the same winners:

* Baseline scorer without a per-request floor. An inverted index of the ads, sorted by
  bid under the prior and by keyword, is read block by block until no unread ad can
  change the winner or the runner-up's bid (``operators.postings``). No request x ad
  pairs and no ad x placement pairs exist.
* Model scorer or a floor in the request. Every eligible ad is scored:
  requests -> join on device (J2) -> ledger (J3) -> priors (J5) -> score -> top two
  per request (WindowGroupLimit also cuts map-side).

Counts of candidates, requests without any, and exploration draws need no auction:
they follow from one row per (device, day).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from ..functions.features import with_features
from ..operators import postings as PO
from ..operators import spend as P
from ..operators import stats as S
from ..operators.materialize import checkpoint
from ..operators.ranking import running_before

# An inventory of at most this size is left to the optimizer's own broadcast
# decision; beyond it the device join is salted, so three device keys spread.
SALT_ABOVE_ROWS = 2_000_000
SALT_BUCKETS = 64

SCORING_COLUMNS = ("ad_id", "campaign_id", "advertiser_id", "target_cpm", "floor_price",
                   "target_device", "target_keywords", "daily_budget_usd", "created_at")


def request_context(requests: DataFrame, ts_col: str = "server_ts") -> DataFrame:
    """Normalised per-request context (device, sorted distinct keywords, day)."""
    cols = [
        "request_id", "publisher_id", "placement_id",
        X.normalize_device("device_type").alias("device_type"),
        X.normalize_keywords("page_keywords").alias("page_keywords"),
        F.col(ts_col).alias("request_ts"),
        X.utc_day(ts_col).alias("day"),
    ]
    if "floor_price" in requests.columns:
        cols.append(F.coalesce(F.col("floor_price"), F.lit(0.0)).alias("request_floor"))
    else:
        cols.append(F.lit(0.0).alias("request_floor"))
    return requests.select(*cols)


# J2 -- every request x every eligible ad.
def eligible_ads(ctx: DataFrame, inventory: DataFrame, inventory_rows: int | None = None) -> DataFrame:
    """Device targeting ('all' or equal) and inclusive floor, as an equi-join.

    The optimizer broadcasts the inventory if its size in bytes allows. A large
    one is salted: requests get one of ``SALT_BUCKETS`` salts and the inventory is
    replicated per salt, so no device key lands in one task. Keywords never
    filter (Q24).
    """
    inv = PO.by_device(inventory)
    n = inventory_rows if inventory_rows is not None else inv.count()
    if n <= SALT_ABOVE_ROWS:
        j = ctx.join(inv, "device_type", "inner")
    else:
        salted_req = ctx.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(SALT_BUCKETS)))
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALT_BUCKETS - 1).cast("bigint"))
        salted_inv = inv.withColumn("_salt", F.explode(salts))
        j = salted_req.join(salted_inv, ["device_type", "_salt"], "inner").drop("_salt")
    return j.filter(F.col("target_cpm") >= F.col("request_floor"))


def baseline_scorer(cands: DataFrame) -> DataFrame:
    """serving baseline when no model is loaded (needs no feature vector)."""
    return cands.withColumn("predicted_ctr", X.baseline_ctr("pair_ctr_prior", "keyword_overlap")) \
                .withColumn("model_version", F.lit("baseline"))


def score_candidates(cands: DataFrame, stats: dict[str, DataFrame],
                     scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """J5 pair prior -> CTR -> F13 bid value.

    Ad and placement priors are attached before the candidate join (to the
    small inventory and to the requests), so only the pair prior is joined
    at candidate granularity. The 17-float vector is assembled per candidate
    only for a model scorer (``scorer.needs_features``); the baseline needs
    just the keyword overlap, and the vector is then built for winners only.
    """
    c = S.attach_pair_prior(cands, stats)
    c = c.withColumn("keyword_overlap", X.keyword_overlap("target_keywords", "page_keywords"))
    if scorer is not None and getattr(scorer, "needs_features", False):
        c = with_features(c)
    scored = (scorer or baseline_scorer)(c)
    return scored.withColumn("bid_value", X.bid_value("predicted_ctr", "target_cpm"))


def md5_uniform(*cols) -> "F.Column":
    """Deterministic uniform in [0, 1) from an md5 of the key (retry-stable;
    DuckDB can compute the same value for the oracle)."""
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / float(1 << 52)


CANDIDATE_FIELDS = ("ad_id", "campaign_id", "advertiser_id", "predicted_ctr", "bid_value", "target_cpm",
                    "floor_price", "model_version", "publisher_id", "placement_id", "device_type", "request_ts")
# Inputs of the feature vector, carried with the winner so the vector is
# assembled after the auction (or the vector itself when a model scored it).
FEATURE_INPUTS = ("page_keywords", "target_keywords", "created_at", "daily_budget_usd", "spent_today_usd",
                  "ad_ctr_prior", "placement_ctr_prior", "pair_ctr_prior", "pair_impressions", "features")


def _explores(epsilon: float, seed: int) -> "F.Column":
    """Does a request explore? Decided from its id alone."""
    return (md5_uniform("request_id", F.lit(seed)) < F.lit(float(epsilon))) if epsilon > 0 else F.lit(False)


def _priced(chosen: DataFrame, fields: list[str], epsilon: float) -> DataFrame:
    """``chosen`` has the winner's fields, second_bid, _explore and n_candidates."""
    n = F.col("n_candidates")
    explored = F.col("_explore") & (n > 1)
    single = F.least("floor_price", "target_cpm")
    second = X.clearing_cpm("predicted_ctr", F.col("second_bid"), F.col("floor_price"), F.col("target_cpm"))
    price = F.greatest(F.when(F.col("second_bid").isNotNull() & ~F.col("_explore"), second).otherwise(single), F.lit(0.0))
    out = chosen.select("request_id", *fields, price.alias("win_price"), X.cost_usd(price).alias("cost_usd"),
                        explored.alias("is_exploration"),
                        X.serve_propensity(n, explored, epsilon).alias("serve_propensity"), "n_candidates")
    if "features" not in fields and all(c in fields for c in FEATURE_INPUTS[:-1]):
        out = with_features(out).drop("keyword_overlap")
    return out


# W1 + W2 + F14-F16 -- winner, runner-up, exploration, price, propensity.
def auction(scored: DataFrame, epsilon: float = K.EXPLORATION_EPSILON, seed: int = 7) -> DataFrame:
    """Auction over scored request x ad pairs, one shuffle on ``request_id``.

    Exploring requests take the ad at a drawn position of their candidates in
    ad order, the others rank by (bid desc, ad_id). Without exploration the
    window holds only ``row_number`` with a ``<= 2`` filter, so Catalyst plans a
    WindowGroupLimit that keeps two rows per request map-side.
    """
    fields = [c for c in CANDIDATE_FIELDS + FEATURE_INPUTS if c in scored.columns]
    cand = F.struct(*[F.col(c) for c in fields])
    sc = scored.select("request_id", *fields)
    counts = sc.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    by_bid = Window.partitionBy("request_id").orderBy(F.col("bid_value").desc(), F.col("ad_id").asc())
    top = sc.withColumn("_rn", F.row_number().over(by_bid)).filter(F.col("_rn") <= 2)
    top2 = top.groupBy("request_id").agg(F.max(F.when(F.col("_rn") == 1, cand)).alias("first"),
                                         F.max(F.when(F.col("_rn") == 2, F.col("bid_value"))).alias("second_bid"))
    j = top2.join(counts, "request_id").withColumn("_explore", _explores(epsilon, seed))
    if epsilon > 0:
        by_ad = Window.partitionBy("request_id").orderBy("ad_id")
        drawn = (sc.filter(_explores(epsilon, seed)).withColumn("_pos", F.row_number().over(by_ad) - 1)
                 .join(counts, "request_id").filter(F.col("_pos") == _drawn_position(seed))
                 .select("request_id", cand.alias("drawn")))
        j = j.join(drawn, "request_id", "left").withColumn("first", F.coalesce("drawn", "first"))
    chosen = j.select("request_id", *[F.col("first")[f].alias(f) for f in fields], "second_bid", "_explore", "n_candidates")
    return _priced(chosen, fields, epsilon)


def _drawn_position(seed: int) -> "F.Column":
    """Position of an exploring request's pick among its candidates in ad order."""
    return F.floor(md5_uniform("request_id", F.lit("pick"), F.lit(seed)) * F.col("n_candidates")).cast("int")


def _request_days(ctx: DataFrame) -> "F.Column":
    """The days of the request table, as one array (a scalar subquery)."""
    return ctx.select(F.sequence(F.min("day"), F.max("day"))).scalar()


def _in_budget(inventory: DataFrame, ctx: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Rows of ``inventory`` on each day on which their campaign may still spend."""
    rows = inventory.filter(P.has_campaign(inventory)).withColumn("day", F.explode(_request_days(ctx)))
    return P.filter_by_budget(rows, ledger) if ledger is not None else rows


def eligibility(ctx: DataFrame, inventory: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """(device_type, day) -> n_candidates, n_campaigns, max_cpm for requests without
    a floor. Ads are first summed by campaign, so days multiply campaigns only."""
    inv = PO.by_device(inventory).filter(F.col("target_cpm") >= 0.0)
    camp = inv.groupBy("campaign_id", "device_type", "daily_budget_usd").agg(
        F.count(F.lit(1)).alias("_ads"), F.max("target_cpm").alias("_cpm"))
    return _in_budget(camp, ctx, ledger).groupBy("device_type", "day").agg(
        F.sum("_ads").alias("n_candidates"), F.count_distinct("campaign_id").alias("n_campaigns"),
        F.max("_cpm").alias("max_cpm"))


def _baseline_auctions(ctx: DataFrame, inv: DataFrame, stats: dict[str, DataFrame], ledger: DataFrame | None,
                       epsilon: float, seed: int) -> DataFrame:
    """The auction by postings; see the module's first plan. Requests that agree in
    everything the score reads are one context. The inventory is written once, since the
    index and every round of reading use it. What grows with ads, contexts or statistics
    is shuffled, never broadcast."""
    ledger = PO.shuffled(ledger) if ledger is not None else None
    stats = {**stats, S.LEVEL_PAIR: PO.shuffled(stats[S.LEVEL_PAIR])}
    inv = checkpoint(inv)
    contexts = checkpoint(ctx.select(*PO.CONTEXT).distinct().withColumn("cid", F.monotonically_increasing_id()))
    index = PO.build(PO.by_device(inv), stats)
    own = inv.select("ad_id", "campaign_id", "target_cpm", "target_keywords", "daily_budget_usd")
    best = PO.best_two(contexts, index, own, stats, ledger)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PO.CONTEXT]
    named = contexts.join(PO.shuffled(best), "cid").select(
        *[F.col(c).alias(f"_{c}") for c in PO.CONTEXT], F.col("first.ad_id").alias("ad_id"), (-F.col("second.low")).alias("second_bid"))
    counted = ctx.join(eligibility(ctx, inv, ledger).select("device_type", "day", "n_candidates"), ["device_type", "day"])
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    j = counted.join(PO.shuffled(named), cond).drop(*[f"_{c}" for c in PO.CONTEXT]).withColumn("_explore", _explores(epsilon, seed))
    if epsilon > 0:
        j = j.withColumn("_pos", F.when(F.col("_explore"), _drawn_position(seed)))
        j = (j.join(PO.shuffled(listed_ads(ctx, inv, ledger).withColumnRenamed("ad_id", "drawn")), ["device_type", "day", "_pos"], "left")
             .withColumn("ad_id", F.coalesce("drawn", "ad_id")).drop("drawn", "_pos"))
    spent = F.lit(0.0)
    j = j.join(PO.shuffled(inv), "ad_id")
    if ledger is not None:
        j = j.join(ledger.select("campaign_id", "day", "spent_usd"), ["campaign_id", "day"], "left")
        spent = F.coalesce("spent_usd", F.lit(0.0))
    j = j.withColumn("spent_today_usd", spent)
    scored = score_candidates(j, stats)
    fields = [c for c in CANDIDATE_FIELDS + FEATURE_INPUTS if c in scored.columns]
    return _priced(scored.select("request_id", *fields, "second_bid", "_explore", "n_candidates"), fields, epsilon)


# W2 -- the ads that exploration draws from, by position.
def listed_ads(ctx: DataFrame, inventory: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """device_type, day, ad_id and its 0-based position among the in-budget ads of that
    device and day, in ad order. Positions come from range pieces with offsets, so a
    large inventory is never numbered in one task."""
    rows = _in_budget(PO.by_device(inventory).filter(F.col("target_cpm") >= 0.0).select(
        "ad_id", "campaign_id", "device_type", "daily_budget_usd"), ctx, ledger)
    rows = rows.select("device_type", "day", "ad_id", F.lit(1).alias("_one"))
    return running_before(rows, ["device_type", "day"], ["ad_id"], {"_pos": "_one"}).select(
        "device_type", "day", "ad_id", F.col("_pos").cast("int").alias("_pos"))


# R1 -- the whole batch auction.
def run_auctions(requests: DataFrame, inventory: DataFrame, stats: dict[str, DataFrame],
                 ledger: DataFrame | None = None, scorer=None,
                 epsilon: float = K.EXPLORATION_EPSILON, seed: int = 7,
                 inventory_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (results: one row per filled request, no_fill requests)."""
    ctx = S.attach_placement_prior(request_context(requests), stats)
    by_ad = {**stats, S.LEVEL_AD: PO.shuffled(stats[S.LEVEL_AD])}
    inv = S.attach_ad_prior(inventory.select(*SCORING_COLUMNS), by_ad) \
        .withColumn("target_keywords", X.ad_keyword_set("target_keywords"))  # once per ad, not per candidate
    if scorer is None and "floor_price" not in requests.columns:
        results = _baseline_auctions(ctx, inv, stats, ledger, epsilon, seed)
    else:
        cands = eligible_ads(ctx, inv, inventory_rows)
        cands = P.filter_by_budget(cands, ledger) if ledger is not None else cands.filter(P.has_campaign(cands))
        results = auction(score_candidates(cands, stats, scorer), epsilon, seed)
    return results, no_fill(ctx, inv, ledger)


# J11 -- requests without any candidate.
def with_fill(ctx: DataFrame, inventory: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """``ctx`` with filled: is there an in-budget ad for the device whose CPM reaches
    the request's floor? One row per (device, day) answers it, without an auction."""
    best = eligibility(ctx, inventory, ledger).select("device_type", "day", "max_cpm")
    return (ctx.join(best, ["device_type", "day"], "left")
            .withColumn("filled", F.coalesce(F.col("max_cpm") >= F.col("request_floor"), F.lit(False))).drop("max_cpm"))


def no_fill(ctx: DataFrame, inventory: DataFrame, ledger: DataFrame | None) -> DataFrame:
    return with_fill(ctx, inventory, ledger).filter(~F.col("filled")).select("request_id", "publisher_id")


# R2 / P11 -- the impression event row for each filled request.
def impression_events(results: DataFrame) -> DataFrame:
    return results.select(
        F.col("request_id").alias("impression_id"),
        F.col("request_ts").alias("ts"),
        "publisher_id", "placement_id", "ad_id",
        F.coalesce(F.col("campaign_id").cast("string"), F.lit("")).alias("campaign_id"),
        "advertiser_id", "device_type",
        F.lit(K.FEATURE_VERSION).alias("feature_version"),
        "features", "predicted_ctr", "bid_value", "win_price", "cost_usd",
        F.col("is_exploration").cast("int").alias("is_exploration"),
        "serve_propensity", "model_version",
    )


# A13 -- traffic summary per publisher.
def fill_report(fills: DataFrame, clicks: DataFrame | None = None, by: str = "publisher_id") -> DataFrame:
    """``fills`` has request_id, ``by`` and filled, as ``with_fill`` gives them."""
    j = fills.select("request_id", by, "filled")
    if clicks is not None:
        clicked = clicks.select(F.col("impression_id").alias("request_id")).distinct() \
            .withColumn("_clicked", F.lit(1))
        j = j.join(clicked, "request_id", "left")
    else:
        j = j.withColumn("_clicked", F.lit(None).cast("int"))
    rep = j.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("filled")).alias("filled"),
        F.count_if(~F.col("filled")).alias("no_fill"),
        F.count_if(F.col("filled") & F.col("_clicked").isNotNull()).alias("clicks"))
    return rep.withColumn("ctr", X.safe_ctr("clicks", "filled"))
