"""Spend and budget queries: A5, W6, J12, J13, R3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import spend as P
from ..registry import query
from .common import RECONCILE_DAY, fx, register, round6, with_views

register("spend_v", ("impressions_v",), """
    SELECT campaign_id, CAST(ts AS DATE) AS day,
           CAST(sum(CAST(round(win_price * 1000) AS BIGINT)) AS DOUBLE) / 1000000.0 AS spent_usd,
           count(*) AS impressions
    FROM impressions_v WHERE campaign_id IS NOT NULL GROUP BY campaign_id, CAST(ts AS DATE)""")
register("ledger_v", ("impressions_v",), """
    SELECT campaign_id, CAST(ts AS DATE) AS day,
           CAST(sum(CAST(round(win_price * 1000) AS BIGINT)) AS DOUBLE) / 1000000.0 AS spent_usd
    FROM impressions_v WHERE campaign_id IS NOT NULL AND hour(ts) < 20 AND campaign_id % 7 <> 0
    GROUP BY campaign_id, CAST(ts AS DATE)""")


@query("campaign_spend", ("A5", "F15", "F21"), with_views(("spend_v",), """
    SELECT campaign_id, CAST(day AS VARCHAR) AS day, spent_usd, impressions FROM spend_v"""))
def campaign_spend(spark, d):
    return P.campaign_spend(fx.impressions(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("spend_drift", ("J13",), with_views(("spend_v", "ledger_v"), """
    SELECT coalesce(a.campaign_id, b.campaign_id) AS campaign_id,
           CAST(coalesce(a.day, b.day) AS VARCHAR) AS day,
           a.spent_usd AS actual_usd, b.spent_usd AS ledger_usd,
           round(coalesce(a.spent_usd, 0.0) - coalesce(b.spent_usd, 0.0), 6) AS drift_usd
    FROM spend_v a FULL OUTER JOIN ledger_v b ON a.campaign_id = b.campaign_id AND a.day = b.day
    WHERE abs(coalesce(a.spent_usd, 0.0) - coalesce(b.spent_usd, 0.0)) > 0.001"""))
def spend_drift(spark, d):
    actual = P.campaign_spend(fx.impressions(spark, d))
    out = P.spend_drift(actual, fx.ledger(spark, d))
    return out.select("campaign_id", F.col("day").cast("string").alias("day"), "actual_usd", "ledger_usd",
                      round6("drift_usd").alias("drift_usd"))


@query("reconciled_ledger", ("R3", "A5"), with_views(("spend_v", "ledger_v"), f"""
    SELECT campaign_id, CAST(day AS VARCHAR) AS day, spent_usd FROM ledger_v l
    WHERE NOT EXISTS (SELECT 1 FROM spend_v s WHERE s.campaign_id = l.campaign_id AND s.day = l.day
                      AND s.day = DATE '{RECONCILE_DAY}')
    UNION ALL
    SELECT campaign_id, CAST(day AS VARCHAR) AS day, spent_usd FROM spend_v WHERE day = DATE '{RECONCILE_DAY}'"""))
def reconciled_ledger(spark, d):
    new, _ = P.reconcile(fx.impressions(spark, d), fx.ledger(spark, d), RECONCILE_DAY)
    return new.select("campaign_id", F.col("day").cast("string").alias("day"), "spent_usd")


@query("reconcile_drift", ("R3", "J13"), with_views(("spend_v", "ledger_v"), f"""
    SELECT s.campaign_id, s.spent_usd AS actual_usd, l.spent_usd AS ledger_usd,
           round(s.spent_usd - coalesce(l.spent_usd, 0.0), 6) AS drift_usd
    FROM spend_v s LEFT JOIN ledger_v l ON l.campaign_id = s.campaign_id AND l.day = s.day
    WHERE s.day = DATE '{RECONCILE_DAY}' AND abs(s.spent_usd - coalesce(l.spent_usd, 0.0)) > 0.001"""))
def reconcile_drift(spark, d):
    _, drift = P.reconcile(fx.impressions(spark, d), fx.ledger(spark, d), RECONCILE_DAY)
    return drift.select("campaign_id", "actual_usd", "ledger_usd", round6("drift_usd").alias("drift_usd"))


register("legacy_ad_spend_v", ("impressions_v",), """
    SELECT (impression_id * 7 + user_id) % (SELECT count(*) + 11 FROM part) AS ad_id, CAST(ts AS DATE) AS day,
           CAST(sum(CAST(round(win_price * 1000) AS BIGINT)) AS DOUBLE) / 1000000.0 AS spent_usd
    FROM impressions_v GROUP BY 1, 2""")


@query("rekey_spend", ("J12",), with_views(("legacy_ad_spend_v", "ads_v", "ledger_v"), """
    SELECT t.campaign_id, CAST(t.day AS VARCHAR) AS day, t.ad_key_usd, l.spent_usd AS existing_usd,
           greatest(coalesce(l.spent_usd, 0.0), t.ad_key_usd) AS spent_usd
    FROM (SELECT a.campaign_id, s.day,
                 CAST(sum(CAST(round(s.spent_usd * 1000000) AS BIGINT)) AS DOUBLE) / 1000000.0 AS ad_key_usd
          FROM legacy_ad_spend_v s JOIN ads_v a ON a.ad_id = s.ad_id GROUP BY a.campaign_id, s.day) t
    LEFT JOIN ledger_v l ON l.campaign_id = t.campaign_id AND l.day = t.day"""))
def rekey_spend(spark, d):
    merged, _ = P.rekey_spend(fx.legacy_ad_spend(spark, d), fx.ads(spark, d), fx.ledger(spark, d))
    return merged.select("campaign_id", F.col("day").cast("string").alias("day"), "ad_key_usd",
                         "existing_usd", "spent_usd")


@query("rekey_unmapped", ("J12",), with_views(("legacy_ad_spend_v", "ads_v"), """
    SELECT s.ad_id, CAST(s.day AS VARCHAR) AS day, s.spent_usd FROM legacy_ad_spend_v s
    WHERE NOT EXISTS (SELECT 1 FROM ads_v a WHERE a.ad_id = s.ad_id)"""))
def rekey_unmapped(spark, d):
    _, unmapped = P.rekey_spend(fx.legacy_ad_spend(spark, d), fx.ads(spark, d), fx.ledger(spark, d))
    return unmapped.select("ad_id", F.col("day").cast("string").alias("day"), "spent_usd")


@query("overspend", ("W6",), with_views(("impressions_v", "campaigns_v"), """
    SELECT campaign_id, CAST(day AS VARCHAR) AS day, count(*) AS impressions,
           count(*) FILTER (WHERE budget_usd IS NOT NULL AND before_usd >= budget_usd) AS served_after_exhaustion,
           CAST(sum(micros) AS DOUBLE) / 1000000.0 AS spent_usd, first(budget_usd) AS budget_usd,
           round(greatest(0.0, CAST(sum(micros) AS DOUBLE) / 1000000.0 - coalesce(first(budget_usd), 0.0)), 6)
               AS overspend_usd
    FROM (SELECT i.campaign_id, CAST(i.ts AS DATE) AS day, m.micros, c.daily_budget_usd AS budget_usd,
                 CAST(coalesce(sum(m.micros) OVER (PARTITION BY i.campaign_id, CAST(i.ts AS DATE)
                      ORDER BY i.ts, i.impression_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                      AS DOUBLE) / 1000000.0 AS before_usd
          FROM impressions_v i
          CROSS JOIN LATERAL (SELECT CAST(round(i.win_price * 1000) AS BIGINT) AS micros) m
          LEFT JOIN campaigns_v c ON c.campaign_id = i.campaign_id
          WHERE i.campaign_id IS NOT NULL) x
    GROUP BY campaign_id, day"""))
def overspend(spark, d):
    out = P.overspend(fx.impressions(spark, d), fx.campaigns(spark, d))
    return out.select("campaign_id", F.col("day").cast("string").alias("day"), "impressions",
                      "served_after_exhaustion", "spent_usd", "budget_usd",
                      round6("overspend_usd").alias("overspend_usd"))
