"""Attribution queries: J4 (both policies), A8, J6-J9, S12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import attribution as A
from ..registry import query
from .common import fx, register, with_views

register("first_click_v", ("clicks_v",), """
    SELECT impression_id, min(ts) AS click_ts, count(*) AS n_clicks FROM clicks_v GROUP BY impression_id""")
register("labels_v", ("impressions_v", "first_click_v"), """
    SELECT i.*, fc.click_ts,
           CASE WHEN fc.click_ts >= i.ts AND fc.click_ts <= i.ts + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS label
    FROM impressions_v i LEFT JOIN first_click_v fc ON fc.impression_id = i.impression_id""")


def _labels(spark, d, policy=A.POLICY_FIRST_CLICK):
    return A.attribute_clicks(fx.impressions(spark, d), fx.clicks(spark, d), policy=policy)


@query("attributed_labels", ("J4", "A8"), with_views(("labels_v",), """
    SELECT impression_id, ad_id, placement_id, click_ts, label FROM labels_v"""))
def attributed_labels(spark, d):
    return _labels(spark, d).select("impression_id", "ad_id", "placement_id", "click_ts", "label")


@query("attributed_ctr", ("J4", "A8", "F29"), with_views(("labels_v",), """
    SELECT ad_id, placement_id, count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicks,
           round(sum(label) / count(*), 6) AS ctr
    FROM labels_v GROUP BY ad_id, placement_id"""))
def attributed_ctr(spark, d):
    return A.labelled_ctr(_labels(spark, d))


@query("attributed_labels_in_window", ("J4",), with_views(("impressions_v", "clicks_v"), """
    SELECT i.impression_id, w.click_ts,
           CASE WHEN w.click_ts IS NOT NULL THEN 1 ELSE 0 END AS label
    FROM impressions_v i
    LEFT JOIN (SELECT c.impression_id, min(c.ts) AS click_ts
               FROM clicks_v c JOIN impressions_v i2 ON i2.impression_id = c.impression_id
               WHERE c.ts >= i2.ts AND c.ts <= i2.ts + INTERVAL 1 HOUR
               GROUP BY c.impression_id) w ON w.impression_id = i.impression_id"""))
def attributed_labels_in_window(spark, d):
    return _labels(spark, d, A.POLICY_FIRST_IN_WINDOW).select("impression_id", "click_ts", "label")


@query("first_clicks", ("A8",), with_views(("first_click_v",), """
    SELECT impression_id, click_ts, n_clicks FROM first_click_v"""))
def first_clicks(spark, d):
    return A.first_clicks(fx.clicks(spark, d))


@query("enriched_clicks", ("J6",), with_views(("clicks_v",), """
    SELECT click_event_id, impression_id, ad_id, placement_id, ts FROM clicks_v"""))
def enriched_clicks(spark, d):
    return fx.clicks(spark, d).select("click_event_id", "impression_id", "ad_id", "placement_id", "ts")


@query("orphan_clicks", ("J7",), with_views(("raw_clicks_v", "impressions_v"), """
    SELECT click_event_id, impression_id, ts FROM raw_clicks_v r
    WHERE NOT EXISTS (SELECT 1 FROM impressions_v i WHERE i.impression_id = r.impression_id)"""))
def orphan_clicks(spark, d):
    return A.orphan_events(fx.raw_clicks(spark, d), fx.impressions(spark, d)) \
        .select("click_event_id", "impression_id", "ts")


@query("orphan_conversions", ("J7",), with_views(("conversions_v", "impressions_v"), """
    SELECT conversion_event_id, impression_id FROM conversions_v c
    WHERE NOT EXISTS (SELECT 1 FROM impressions_v i WHERE i.impression_id = c.impression_id)"""))
def orphan_conversions(spark, d):
    return A.orphan_events(fx.conversions(spark, d), fx.impressions(spark, d)) \
        .select("conversion_event_id", "impression_id")


# Conversions are claimed by the publisher of the purchasing user's site
# ('pub_' || user_id % 3); a claim for another publisher's impression is rejected.
@query("conversion_attribution", ("J8",), with_views(("conversions_v", "impressions_v"), """
    SELECT c.conversion_event_id, c.impression_id, i.ad_id, i.advertiser_id,
           CASE WHEN 'pub_' || CAST(c.user_id % 3 AS VARCHAR) = i.publisher_id THEN 'accepted'
                ELSE 'cross_publisher' END AS verdict,
           c.conversion_value
    FROM conversions_v c JOIN impressions_v i ON i.impression_id = c.impression_id"""))
def conversion_attribution(spark, d):
    conv = fx.conversions(spark, d).withColumn(
        "claimed_publisher", F.concat(F.lit("pub_"), (F.col("user_id") % 3).cast("string")))
    ok, bad = A.attribute_conversions(conv, fx.impressions(spark, d), publisher_col="claimed_publisher")
    cols = ["conversion_event_id", "impression_id", "ad_id", "advertiser_id", "conversion_value"]
    return (ok.select(*cols, F.lit("accepted").alias("verdict"))
            .unionByName(bad.select(*cols, F.col("reason").alias("verdict"))))


@query("impression_facts", ("J9",), with_views(("impressions_v", "first_click_v", "conversions_v"), """
    SELECT i.impression_id, fc.click_ts AS clicked_at, fc.click_ts IS NOT NULL AS clicked,
           EXISTS (SELECT 1 FROM conversions_v c WHERE c.impression_id = i.impression_id) AS converted
    FROM impressions_v i LEFT JOIN first_click_v fc ON fc.impression_id = i.impression_id"""))
def impression_facts(spark, d):
    return A.impression_facts(fx.impressions(spark, d), fx.clicks(spark, d), fx.conversions(spark, d)) \
        .select("impression_id", "clicked_at", "clicked", "converted")


# The log re-delivered: every impression arrives twice (the copy 1 s later),
# as an at-least-once producer would; the earliest copy per id must survive.
@query("dedup_impressions", ("S12",), with_views(("impressions_v",), """
    SELECT impression_id, ts, ad_id FROM impressions_v"""))
def dedup_impressions(spark, d):
    imp = fx.impressions(spark, d).select("impression_id", "ts", "ad_id")
    dup = imp.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    return A.dedup_impressions(imp.unionByName(dup))
