"""Report queries: A6, A7 over the impression facts."""

from __future__ import annotations

from ...operators import attribution as A
from ...operators import reports as RP
from ..registry import query
from .common import REPORT_AS_OF, fx, register, with_views

register("facts_v", ("impressions_v", "first_click_v", "conversions_v"), """
    SELECT i.*, TRUE AS filled, fc.click_ts IS NOT NULL AS clicked,
           EXISTS (SELECT 1 FROM conversions_v c WHERE c.impression_id = i.impression_id) AS converted,
           CAST(round(i.win_price * 1000) AS BIGINT) AS cost_micros
    FROM impressions_v i LEFT JOIN first_click_v fc ON fc.impression_id = i.impression_id""")


def _report_sql(by: str, money: str) -> str:
    return with_views(("facts_v",), f"""
        SELECT {by}, count(*) FILTER (WHERE filled) AS impressions, count(*) FILTER (WHERE clicked) AS clicks,
               count(*) FILTER (WHERE converted) AS conversions,
               round(CAST(coalesce(sum(cost_micros), 0) AS DOUBLE) / 1000000.0, 6) AS {money},
               CASE WHEN count(*) FILTER (WHERE filled) > 0 THEN
                    round(count(*) FILTER (WHERE clicked) / count(*) FILTER (WHERE filled), 6) ELSE 0.0 END AS ctr
        FROM facts_v WHERE ts > TIMESTAMP '{REPORT_AS_OF}' - INTERVAL 30 DAY GROUP BY {by}""")


def _facts(spark, d):
    return A.impression_facts(fx.impressions(spark, d), fx.clicks(spark, d), fx.conversions(spark, d))


@query("publisher_stats", ("A6", "J9", "F29"), _report_sql("publisher_id", "revenue_usd"))
def publisher_stats(spark, d):
    return RP.publisher_stats(_facts(spark, d), REPORT_AS_OF)


@query("advertiser_stats", ("A7", "J9", "F29"), _report_sql("advertiser_id", "spend_usd"))
def advertiser_stats(spark, d):
    return RP.advertiser_stats(_facts(spark, d), REPORT_AS_OF)
