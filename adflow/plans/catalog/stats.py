"""CTR state and prior queries: A1-A4, F5/J5, W5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import expr as X
from ...operators import attribution as A
from ...operators import stats as S
from ...operators.materialize import checkpoint
from ..registry import query
from .common import STATS_AS_OF, fx, register, round6, with_views

register("pair_daily_v", ("impressions_v", "clicks_v"), """
    SELECT day, ad_id, placement_id, CAST(sum(i) AS BIGINT) AS impressions, CAST(sum(c) AS BIGINT) AS clicks
    FROM (SELECT CAST(ts AS DATE) AS day, ad_id, placement_id, 1 AS i, 0 AS c FROM impressions_v
          UNION ALL
          SELECT CAST(ts AS DATE) AS day, ad_id, placement_id, 0 AS i, 1 AS c FROM clicks_v) u
    GROUP BY day, ad_id, placement_id""")
register("pairs_v", ("pair_daily_v",), f"""
    SELECT ad_id, placement_id, CAST(sum(impressions) AS BIGINT) AS impressions,
           CAST(sum(clicks) AS BIGINT) AS clicks
    FROM pair_daily_v WHERE day >= DATE '{STATS_AS_OF}' - INTERVAL {K.STATS_LOOKBACK_DAYS} DAY
    GROUP BY ad_id, placement_id""")
register("global_v", ("pairs_v",), """
    SELECT CASE WHEN coalesce(sum(impressions), 0) > 1000
                THEN CAST(sum(clicks) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE)
                ELSE CAST(0.010 AS DOUBLE) END AS g
    FROM pairs_v""")
register("ad_counts_v", ("pairs_v",), """
    SELECT ad_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks
    FROM pairs_v GROUP BY ad_id""")
register("placement_counts_v", ("pairs_v",), """
    SELECT placement_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks
    FROM pairs_v GROUP BY placement_id""")


def smoothed_sql(i: str, c: str, g: str = "g.g") -> str:
    s = f"CAST({K.PRIOR_STRENGTH} AS DOUBLE)"
    return (f"CASE WHEN {i} IS NULL THEN {g} ELSE "
            f"({c} + {g} * {s}) / ({i} + {g} * {s} + (1.0 - {g}) * {s}) END")


register("priors_v", ("impressions_v", "ad_counts_v", "placement_counts_v", "pairs_v", "global_v"), f"""
    SELECT i.impression_id, i.ad_id, i.placement_id, g.g AS global_ctr,
           {smoothed_sql('a.impressions', 'a.clicks')} AS ad_ctr_prior,
           {smoothed_sql('l.impressions', 'l.clicks')} AS placement_ctr_prior,
           {smoothed_sql('p.impressions', 'p.clicks')} AS pair_ctr_prior,
           coalesce(p.impressions, 0) AS pair_impressions
    FROM impressions_v i
    CROSS JOIN global_v g
    LEFT JOIN ad_counts_v a ON a.ad_id = i.ad_id
    LEFT JOIN placement_counts_v l ON l.placement_id = i.placement_id
    LEFT JOIN pairs_v p ON p.ad_id = i.ad_id AND p.placement_id = i.placement_id""")


def _state(spark, d):
    return S.ctr_pair_daily(fx.impressions(spark, d), fx.clicks(spark, d))


def _stats(spark, d):
    return S.ctr_stats(S.ctr_pair(_state(spark, d), STATS_AS_OF), materialize=True)


@query("ctr_pair_daily", ("A1", "U1", "F21"), with_views(("pair_daily_v",), """
    SELECT CAST(day AS VARCHAR) AS day, ad_id, placement_id, impressions, clicks FROM pair_daily_v"""))
def ctr_pair_daily(spark, d):
    return _state(spark, d).withColumn("day", F.col("day").cast("string"))


@query("ctr_pair_lookback", ("A2",), with_views(("pair_daily_v",), """
    SELECT ad_id, placement_id, CAST(sum(impressions) AS BIGINT) AS impressions,
           CAST(sum(clicks) AS BIGINT) AS clicks
    FROM pair_daily_v WHERE day >= DATE '2024-01-20' - INTERVAL 7 DAY
    GROUP BY ad_id, placement_id"""))
def ctr_pair_lookback(spark, d):
    return S.ctr_pair(_state(spark, d), "2024-01-20", lookback_days=7)


@query("ctr_rollup", ("A3", "A4", "F5"), with_views(("pairs_v", "global_v"), f"""
    SELECT level, coalesce(ad_id, -1) AS ad_id, coalesce(placement_id, '*') AS placement_id,
           impressions, clicks,
           round({smoothed_sql('impressions', 'clicks')}, 6) AS prior
    FROM (SELECT CASE WHEN grouping(ad_id) = 0 AND grouping(placement_id) = 0 THEN 'pair'
                      WHEN grouping(ad_id) = 0 THEN 'ad'
                      WHEN grouping(placement_id) = 0 THEN 'placement' ELSE 'global' END AS level,
                 ad_id, placement_id, CAST(sum(impressions) AS BIGINT) AS impressions,
                 CAST(sum(clicks) AS BIGINT) AS clicks
          FROM pairs_v GROUP BY GROUPING SETS ((ad_id, placement_id), (ad_id), (placement_id), ())) r
    CROSS JOIN global_v g"""))
def ctr_rollup(spark, d):
    r = checkpoint(S.ctr_rollup(S.ctr_pair(_state(spark, d), STATS_AS_OF)))
    g = S.global_prior(S.rollup_tables(r))
    return r.select("level", F.coalesce("ad_id", F.lit(-1)).alias("ad_id"),
                    F.coalesce("placement_id", F.lit("*")).alias("placement_id"), "impressions", "clicks",
                    round6(X.smoothed_ctr("impressions", "clicks", g)).alias("prior"))


@query("smoothed_priors", ("F5", "F6", "J5", "A3", "A4"), with_views(("priors_v",), """
    SELECT impression_id, round(global_ctr, 6) AS global_ctr, round(ad_ctr_prior, 6) AS ad_ctr_prior,
           round(placement_ctr_prior, 6) AS placement_ctr_prior, round(pair_ctr_prior, 6) AS pair_ctr_prior,
           round(ln(1 + pair_impressions), 6) AS pair_impressions_log
    FROM priors_v"""))
def smoothed_priors(spark, d):
    cand = fx.impressions(spark, d).select("impression_id", "ad_id", "placement_id")
    p = S.with_priors(cand, _stats(spark, d))
    return p.select("impression_id", round6("global_ctr").alias("global_ctr"),
                    round6("ad_ctr_prior").alias("ad_ctr_prior"),
                    round6("placement_ctr_prior").alias("placement_ctr_prior"),
                    round6("pair_ctr_prior").alias("pair_ctr_prior"),
                    round6(X.log_impressions("pair_impressions")).alias("pair_impressions_log"))


_PIT_SQL = with_views(("labels_v",), """
    SELECT impression_id, ad_id,
           coalesce(count(*) OVER w, 0) AS seen_before,
           CAST(coalesce(sum(label) OVER w, 0) AS BIGINT) AS clicks_before,
           round((coalesce(sum(label) OVER w, 0) + 1.0) / (coalesce(count(*) OVER w, 0) + 100.0), 6) AS pit_ctr
    FROM labels_v
    WINDOW w AS (PARTITION BY ad_id ORDER BY ts, impression_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


@query("point_in_time_ctr", ("W5",), _PIT_SQL)
def point_in_time_ctr(spark, d):
    lab = A.attribute_clicks(fx.impressions(spark, d), fx.clicks(spark, d))
    return S.point_in_time_ctr(lab).select(
        "impression_id", "ad_id", "seen_before", "clicks_before", round6("pit_ctr").alias("pit_ctr"))


@query("point_in_time_ctr_bucketed", ("W5",), _PIT_SQL)
def point_in_time_ctr_bucketed(spark, d):
    lab = A.attribute_clicks(fx.impressions(spark, d), fx.clicks(spark, d))
    return S.point_in_time_ctr_bucketed(lab).select(
        "impression_id", "ad_id", "seen_before", "clicks_before", round6("pit_ctr").alias("pit_ctr"))
