"""Auction queries: J2, J3, F1-F9, R1, W1, W2, J11, A13."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import stats as S
from ...operators.inventory import load_inventory
from ...session import ensure_checkpoint_dir
from .. import auction as AU
from ..registry import query
from .common import STATS_AS_OF, fx, register, round6, with_views
from .inventory import servable

KW_NORM = ("list_sort(list_distinct(list_filter(list_transform(coalesce(page_keywords, []), "
           "lambda x: lower(trim(x))), lambda x: x <> '')))")
AD_SET = "list_distinct(list_transform(coalesce(target_keywords, []), lambda x: lower(x)))"


def _smooth(i, c):
    s = f"CAST({K.PRIOR_STRENGTH} AS DOUBLE)"
    return (f"CASE WHEN {i} IS NULL THEN g.g ELSE "
            f"({c} + g.g * {s}) / ({i} + g.g * {s} + (1.0 - g.g) * {s}) END")


register("ctx_v", ("requests_v",), f"""
    SELECT request_id, publisher_id, placement_id, lower(trim(coalesce(device_type, ''))) AS device_type,
           {KW_NORM} AS page_keywords, server_ts AS request_ts, CAST(server_ts AS DATE) AS day, served_ad_id
    FROM requests_v""")
register("eligible_v", ("ctx_v", "servable_v"), """
    SELECT x.*, s.ad_id, s.campaign_id, s.advertiser_id, s.target_cpm, s.floor_price, s.target_device,
           s.target_keywords, s.daily_budget_usd, s.created_at
    FROM ctx_v x JOIN servable_v s
      ON (s.target_device = 'all' OR s.target_device = x.device_type) AND s.target_cpm >= 0.0""")
register("budgeted_v", ("eligible_v", "ledger_v"), """
    SELECT e.*, coalesce(l.spent_usd, 0.0) AS spent_today_usd
    FROM eligible_v e LEFT JOIN ledger_v l ON l.campaign_id = e.campaign_id AND l.day = e.day
    WHERE e.campaign_id IS NOT NULL AND coalesce(l.spent_usd, 0.0) < e.daily_budget_usd""")
register("scored_v", ("budgeted_v", "ad_counts_v", "placement_counts_v", "pairs_v", "global_v"), f"""
    SELECT b.*, {_smooth('p.impressions', 'p.clicks')} AS pair_ctr_prior,
           len(list_intersect({AD_SET}, b.page_keywords)) AS keyword_overlap,
           least(greatest({_smooth('p.impressions', 'p.clicks')}
                 * (1.0 + least(0.6, 0.15 * len(list_intersect({AD_SET}, b.page_keywords)))), 0.0001), 0.25)
               AS predicted_ctr
    FROM budgeted_v b CROSS JOIN global_v g
    LEFT JOIN pairs_v p ON p.ad_id = b.ad_id AND p.placement_id = b.placement_id""")
register("ranked_v", ("scored_v",), """
    SELECT *, round(predicted_ctr * target_cpm, 6) AS bid_value,
           row_number() OVER (PARTITION BY request_id
                              ORDER BY round(predicted_ctr * target_cpm, 6) DESC, ad_id) AS rn,
           count(*) OVER (PARTITION BY request_id) AS n_candidates
    FROM scored_v""")


def _price_sql(explore_cond: str) -> str:
    single = "least(w.floor_price, w.target_cpm)"
    second = ("least(round(greatest(r.bid_value / greatest(f.predicted_ctr, 1e-9) + 0.01, f.floor_price), 6), "
              "f.target_cpm)")
    return (f"greatest(CASE WHEN {explore_cond} THEN {single} WHEN r.request_id IS NOT NULL THEN {second} "
            f"ELSE {single} END, 0.0)")


AUCTION_SQL = with_views(("ranked_v",), f"""
    SELECT f.request_id, f.ad_id, f.campaign_id, round(f.predicted_ctr, 6) AS predicted_ctr, f.bid_value,
           round({_price_sql('FALSE').replace('w.', 'f.')}, 6) AS win_price,
           false AS is_exploration,
           round(CASE WHEN f.n_candidates > 1 THEN (1.0 - 0.0) + 0.0 / f.n_candidates ELSE 1.0 END, 6)
               AS serve_propensity,
           f.n_candidates
    FROM ranked_v f LEFT JOIN ranked_v r ON r.request_id = f.request_id AND r.rn = 2
    WHERE f.rn = 1""")

EPS = K.EXPLORATION_EPSILON
SEED = 7
_U = f"CAST(('0x' || substr(md5(CAST(f.request_id AS VARCHAR) || ':{SEED}'), 1, 13)) AS BIGINT) / {float(1 << 52)}"
_EXPLORE = f"(f.n_candidates > 1 AND {_U} < {EPS})"
# The ads of a device and day are listed once, by position, not once for each request.
register("listed_v", ("ctx_v", "servable_v", "ledger_v"), """
    SELECT t.device_type, t.day, s.ad_id, s.target_cpm, s.floor_price, s.target_keywords,
           row_number() OVER (PARTITION BY t.device_type, t.day ORDER BY s.ad_id) - 1 AS pos
    FROM (SELECT DISTINCT device_type, day FROM ctx_v) t
    JOIN servable_v s ON (s.target_device = 'all' OR s.target_device = t.device_type) AND s.target_cpm >= 0.0
    LEFT JOIN ledger_v l ON l.campaign_id = s.campaign_id AND l.day = t.day
    WHERE s.campaign_id IS NOT NULL AND coalesce(l.spent_usd, 0.0) < s.daily_budget_usd""")
_PICK = f"CAST(('0x' || substr(md5(CAST(f.request_id AS VARCHAR) || ':pick:{SEED}'), 1, 13)) AS BIGINT) / {float(1 << 52)}"
register("drawn_v", ("ranked_v", "listed_v", "pairs_v", "global_v"), f"""
    SELECT f.request_id, p.ad_id, p.floor_price, p.target_cpm,
           least(greatest({_smooth('q.impressions', 'q.clicks')}
                 * (1.0 + least(0.6, 0.15 * len(list_intersect({AD_SET.replace('target_keywords', 'p.target_keywords')}, f.page_keywords)))),
                 0.0001), 0.25) AS predicted_ctr
    FROM ranked_v f CROSS JOIN global_v g
    JOIN listed_v p ON p.device_type = f.device_type AND p.day = f.day AND p.pos = CAST(floor(f.n_candidates * ({_PICK})) AS BIGINT)
    LEFT JOIN pairs_v q ON q.ad_id = p.ad_id AND q.placement_id = f.placement_id
    WHERE f.rn = 1 AND {_EXPLORE}""")
EXPLORATION_SQL = with_views(("ranked_v", "drawn_v"), f"""
    SELECT f.request_id,
           CASE WHEN {_EXPLORE} THEN p.ad_id ELSE f.ad_id END AS ad_id,
           round(CASE WHEN {_EXPLORE} THEN p.predicted_ctr ELSE f.predicted_ctr END, 6) AS predicted_ctr,
           round(CASE WHEN {_EXPLORE} THEN least(p.floor_price, p.target_cpm)
                 ELSE greatest(CASE WHEN r.request_id IS NOT NULL
                      THEN least(round(greatest(r.bid_value / greatest(f.predicted_ctr, 1e-9) + 0.01,
                                                f.floor_price), 6), f.target_cpm)
                      ELSE least(f.floor_price, f.target_cpm) END, 0.0) END, 6) AS win_price,
           {_EXPLORE} AS is_exploration,
           round(CASE WHEN f.n_candidates <= 1 THEN 1.0
                      WHEN {_EXPLORE} THEN {EPS} / f.n_candidates
                      ELSE (1.0 - {EPS}) + {EPS} / f.n_candidates END, 6) AS serve_propensity,
           f.n_candidates
    FROM ranked_v f
    LEFT JOIN ranked_v r ON r.request_id = f.request_id AND r.rn = 2
    LEFT JOIN drawn_v p ON p.request_id = f.request_id
    WHERE f.rn = 1""")


def _stats(spark, d):
    return S.ctr_stats_from_logs(fx.impressions(spark, d), fx.clicks(spark, d), STATS_AS_OF, materialize=True)


def _snapshots(spark, d):
    """Inventory and ledger, written once each."""
    from ...operators.materialize import checkpoint

    return checkpoint(servable(spark, d).select(*AU.SCORING_COLUMNS)), checkpoint(fx.ledger(spark, d))


def _run(spark, d, epsilon):
    inventory, ledger = _snapshots(spark, d)
    return AU.run_auctions(fx.requests(spark, d), inventory, _stats(spark, d),
                           ledger=ledger, epsilon=epsilon, seed=SEED)


def _result_columns(res):
    return res.select("request_id", "ad_id", "campaign_id", round6("predicted_ctr").alias("predicted_ctr"),
                      "bid_value", round6("win_price").alias("win_price"), "is_exploration",
                      round6("serve_propensity").alias("serve_propensity"), "n_candidates")


@query("auction_results", ("R1", "J2", "J3", "J5", "F1", "F2", "F9", "F11", "F13", "F14", "F16", "W1", "M7"),
       AUCTION_SQL)
def auction_results(spark, d):
    res, _ = _run(spark, d, 0.0)
    return _result_columns(res)


@query("auction_exploration", ("R1", "W2", "F16", "Q10"), EXPLORATION_SQL)
def auction_exploration(spark, d):
    res, _ = _run(spark, d, EPS)
    return res.select("request_id", "ad_id", round6("predicted_ctr").alias("predicted_ctr"),
                      round6("win_price").alias("win_price"), "is_exploration",
                      round6("serve_propensity").alias("serve_propensity"), "n_candidates")


@query("refused_model_auction", ("M8", "R1"), AUCTION_SQL)
def refused_model_auction(spark, d):
    """A promoted model of another feature contract is refused when it is loaded, so the
    auction runs on the baseline."""
    from .. import training as T

    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    T.write_metadata(spark, f"{out}/v1", {"model_version": "v1", "feature_version": K.FEATURE_VERSION - 1, "n_features": K.N_FEATURES})
    T.promote(spark, out, f"{out}/v1")
    scorer, _ = T.load_model(spark, out)
    inventory, ledger = _snapshots(spark, d)
    res, _ = AU.run_auctions(fx.requests(spark, d), inventory, _stats(spark, d), ledger=ledger, scorer=scorer, epsilon=0.0, seed=SEED)
    return _result_columns(res)


# Requests with a floor: some above every CPM, some that only the best ads reach.
def _floored_context(spark, d):
    k = F.col("request_id") % 17
    floor = F.when(k == 3, 1000.0).when(k == 4, 13.0).when(k == 5, 13.9).otherwise(0.0)
    return AU.request_context(fx.requests(spark, d).withColumn("floor_price", floor))


register("floored_v", ("ctx_v", "budgeted_v"), """
    SELECT c.request_id, c.publisher_id, coalesce(max(b.target_cpm) >= CASE c.request_id % 17
             WHEN 3 THEN 1000.0 WHEN 4 THEN 13.0 WHEN 5 THEN 13.9 ELSE 0.0 END, false) AS filled
    FROM ctx_v c LEFT JOIN budgeted_v b ON b.request_id = c.request_id GROUP BY c.request_id, c.publisher_id""")


@query("no_fill", ("J11",), with_views(("floored_v",), """
    SELECT request_id, publisher_id FROM floored_v WHERE NOT filled"""))
def no_fill(spark, d):
    return AU.no_fill(_floored_context(spark, d), *_snapshots(spark, d))


@query("eligible_counts", ("J2", "P2"), with_views(("ctx_v", "eligible_v"), """
    SELECT c.request_id, count(e.ad_id) AS n_eligible
    FROM ctx_v c LEFT JOIN eligible_v e ON e.request_id = c.request_id GROUP BY c.request_id"""))
def eligible_counts(spark, d):
    ctx = AU.request_context(fx.requests(spark, d))
    counts = AU.eligibility(ctx, servable(spark, d).select(*AU.SCORING_COLUMNS), None)
    return (ctx.select("request_id", "device_type", "day").join(counts, ["device_type", "day"], "left")
            .select("request_id", F.coalesce("n_candidates", F.lit(0)).alias("n_eligible")))


@query("budget_filtered", ("J3", "P3"), with_views(("budgeted_v",), """
    SELECT request_id, count(*) AS n_in_budget, count(DISTINCT campaign_id) AS n_campaigns
    FROM budgeted_v GROUP BY request_id"""))
def budget_filtered(spark, d):
    ctx = AU.request_context(fx.requests(spark, d))
    counts = AU.eligibility(ctx, servable(spark, d).select(*AU.SCORING_COLUMNS), fx.ledger(spark, d))
    return (ctx.select("request_id", "device_type", "day").join(counts, ["device_type", "day"])
            .select("request_id", F.col("n_candidates").alias("n_in_budget"), "n_campaigns"))


@query("fill_report", ("A13",), with_views(("floored_v", "first_click_v"), """
    SELECT c.publisher_id, count(*) AS requests, count(*) FILTER (WHERE filled) AS filled,
           count(*) FILTER (WHERE NOT filled) AS no_fill,
           count(*) FILTER (WHERE filled AND k.impression_id IS NOT NULL) AS clicks,
           CASE WHEN count(*) FILTER (WHERE filled) > 0 THEN
                round(count(*) FILTER (WHERE filled AND k.impression_id IS NOT NULL)
                      / count(*) FILTER (WHERE filled), 6) ELSE 0.0 END AS ctr
    FROM floored_v c LEFT JOIN first_click_v k ON k.impression_id = c.request_id
    GROUP BY c.publisher_id"""))
def fill_report(spark, d):
    fills = AU.with_fill(_floored_context(spark, d), *_snapshots(spark, d))
    return AU.fill_report(fills, fx.clicks(spark, d))


# Features of the logged (request, served ad) pairs against the whole ad catalogue.
def ad_catalog(spark, d):
    ads = fx.ads(spark, d).select("ad_id", "campaign_id", "creative_html", "destination_url", "created_at")
    camps = fx.campaigns(spark, d).select("campaign_id", "advertiser_id", "target_cpm", "floor_price",
                                          "target_device", "target_keywords", "daily_budget_usd")
    good, _ = load_inventory(ads.join(camps, "campaign_id", "inner"))
    return good


def logged_features(spark, d, keep_columns=False):
    """F9 for every logged impression: its own request context x the served
    ad (catalogue) x priors x the ledger, from one events scan. With
    ``keep_columns`` every feature is also a column of its own; leave it off where
    the vector is enough, since the optimizer reasons about every alias."""
    from ...functions.features import with_features

    ctx = _logged_context(fx.impressions(spark, d, with_request=True))
    cat = ad_catalog(spark, d).select(*[c for c in AU.SCORING_COLUMNS if c != "campaign_id"], "campaign_id")
    j = ctx.join(cat.drop("advertiser_id"), ["ad_id", "campaign_id"], "inner")
    led = fx.ledger(spark, d).select("campaign_id", "day", F.col("spent_usd").alias("spent_today_usd"))
    j = j.join(led, ["campaign_id", "day"], "left").withColumn(
        "spent_today_usd", F.coalesce("spent_today_usd", F.lit(0.0)))
    return with_features(S.with_priors(j, _stats(spark, d)), keep_columns=keep_columns)


def _logged_context(imp):
    """Request context columns (as the auction normalises them) next to the
    impression's own columns, without a join."""
    from ...functions import expr as X

    return imp.select(
        F.col("impression_id").alias("request_id"), "impression_id", "ts", "publisher_id", "placement_id",
        X.normalize_device("device_type").alias("device_type"),
        X.normalize_keywords("page_keywords").alias("page_keywords"),
        F.col("ts").alias("request_ts"), X.utc_day("ts").alias("day"),
        "ad_id", "campaign_id", "advertiser_id", "win_price", "is_exploration", "serve_propensity",
        "model_version", "user_id")


register("logged_features_v", ("ctx_v", "ads_v", "campaigns_v", "ledger_v", "ad_counts_v",
                               "placement_counts_v", "pairs_v", "global_v"), f"""
    SELECT x.request_id, x.request_ts, x.placement_id, x.device_type, x.page_keywords,
           a.ad_id, a.created_at, c.target_cpm, c.target_keywords, c.daily_budget_usd,
           coalesce(l.spent_usd, 0.0) AS spent_today_usd,
           {_smooth('ac.impressions', 'ac.clicks')} AS ad_ctr_prior,
           {_smooth('pc.impressions', 'pc.clicks')} AS placement_ctr_prior,
           {_smooth('p.impressions', 'p.clicks')} AS pair_ctr_prior,
           coalesce(p.impressions, 0) AS pair_impressions,
           len(list_intersect({AD_SET.replace('target_keywords', 'c.target_keywords')}, x.page_keywords))
               AS keyword_overlap,
           len({AD_SET.replace('target_keywords', 'c.target_keywords')}) AS n_ad_keywords
    FROM ctx_v x
    JOIN ads_v a ON a.ad_id = x.served_ad_id
    JOIN campaigns_v c ON c.campaign_id = a.campaign_id
    CROSS JOIN global_v g
    LEFT JOIN ledger_v l ON l.campaign_id = c.campaign_id AND l.day = x.day
    LEFT JOIN ad_counts_v ac ON ac.ad_id = a.ad_id
    LEFT JOIN placement_counts_v pc ON pc.placement_id = x.placement_id
    LEFT JOIN pairs_v p ON p.ad_id = a.ad_id AND p.placement_id = x.placement_id""")

FEATURE_SQL = {
    "hour_of_day": "CAST(hour(request_ts) AS DOUBLE)",
    "day_of_week": "CAST(isodow(request_ts) - 1 AS DOUBLE)",
    "is_weekend": "CASE WHEN isodow(request_ts) - 1 >= 5 THEN 1.0 ELSE 0.0 END",
    "is_mobile": "CASE WHEN device_type = 'mobile' THEN 1.0 ELSE 0.0 END",
    "is_desktop": "CASE WHEN device_type = 'desktop' THEN 1.0 ELSE 0.0 END",
    "is_tablet": "CASE WHEN device_type = 'tablet' THEN 1.0 ELSE 0.0 END",
    "keyword_overlap": "CAST(keyword_overlap AS DOUBLE)",
    "keyword_overlap_ratio": "CASE WHEN n_ad_keywords > 0 THEN CAST(keyword_overlap AS DOUBLE) / n_ad_keywords "
                             "ELSE 0.0 END",
    "n_ad_keywords": "CAST(n_ad_keywords AS DOUBLE)",
    "n_page_keywords": "CAST(len(page_keywords) AS DOUBLE)",
    "target_cpm": "target_cpm",
    "ad_ctr_prior": "ad_ctr_prior",
    "placement_ctr_prior": "placement_ctr_prior",
    "pair_ctr_prior": "pair_ctr_prior",
    "pair_impressions_log": "ln(1 + pair_impressions)",
    "ad_age_days": "CASE WHEN created_at IS NULL THEN 0.0 ELSE greatest(0.0, "
                   "(epoch_us(request_ts) - epoch_us(created_at)) / 86400000000.0) END",
    "budget_pacing": "CASE WHEN daily_budget_usd > 0 THEN spent_today_usd / daily_budget_usd ELSE 0.0 END",
}
register("feature_rows_v", ("logged_features_v",), "SELECT request_id, ad_id, "
         + ", ".join(f"{v} AS {k}" for k, v in FEATURE_SQL.items()) + " FROM logged_features_v")


@query("feature_vectors", ("F1", "F2", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "J5"),
       with_views(("feature_rows_v",), "SELECT request_id, ad_id, "
                  + ", ".join(f"round({k}, 6) AS {k}" for k in K.FEATURE_NAMES) + " FROM feature_rows_v"))
def feature_vectors(spark, d):
    f = logged_features(spark, d, keep_columns=True)
    cols = [round6("keyword_overlap_f" if n == "keyword_overlap" else n).alias(n) for n in K.FEATURE_NAMES]
    return f.select("request_id", "ad_id", *cols)
