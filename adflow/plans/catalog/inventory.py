"""Inventory and dimension-maintenance queries: J1/P1, S10, A14, S13-S15, J10, P12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import inventory as I
from ..registry import query
from .common import INVENTORY_AS_OF, fx, register, with_views

register("servable_v", ("ads_v", "campaigns_v", "advertisers_v"), f"""
    SELECT a.ad_id, c.advertiser_id, a.creative_html, a.destination_url, c.target_cpm, c.floor_price,
           c.target_device, c.target_keywords, c.daily_budget_usd, c.campaign_id, a.created_at
    FROM ads_v a
    JOIN campaigns_v c ON c.campaign_id = a.campaign_id
    JOIN advertisers_v d ON d.advertiser_id = c.advertiser_id
    WHERE a.status = 'active' AND c.status = 'active' AND d.active
      AND (c.start_date IS NULL OR c.start_date <= DATE '{INVENTORY_AS_OF}')
      AND (c.end_date IS NULL OR c.end_date >= DATE '{INVENTORY_AS_OF}')""")


def servable(spark, d, as_of=INVENTORY_AS_OF):
    """Servable and decoded inventory snapshot (J1 then S10)."""
    raw = I.servable_ads(fx.ads(spark, d), fx.campaigns(spark, d), fx.advertisers(spark, d), as_of)
    good, _ = I.load_inventory(raw)
    return good


@query("servable_ads", ("J1", "P1", "S10", "F18"), with_views(("servable_v",), """
    SELECT ad_id, advertiser_id, campaign_id, target_cpm, floor_price, target_device,
           array_to_string(target_keywords, ',') AS target_keywords, daily_budget_usd, created_at,
           destination_url, creative_html
    FROM servable_v"""))
def servable_ads(spark, d):
    return servable(spark, d).select(
        "ad_id", "advertiser_id", "campaign_id", "target_cpm", "floor_price", "target_device",
        F.concat_ws(",", "target_keywords").alias("target_keywords"), "daily_budget_usd", "created_at",
        "destination_url", "creative_html")


@query("inventory_summary", ("A14",), with_views(("ads_v", "campaigns_v", "advertisers_v", "servable_v"), """
    SELECT 'ads_' || status AS metric, count(*) AS n FROM ads_v GROUP BY 1
    UNION ALL SELECT 'campaigns_' || status, count(*) FROM campaigns_v GROUP BY 1
    UNION ALL SELECT CASE WHEN active THEN 'advertisers_active' ELSE 'advertisers_inactive' END, count(*)
              FROM advertisers_v GROUP BY 1
    UNION ALL SELECT 'servable_' || target_device, count(*) FROM servable_v GROUP BY 1"""))
def inventory_summary(spark, d):
    return I.inventory_summary(fx.ads(spark, d), fx.campaigns(spark, d), fx.advertisers(spark, d),
                               servable(spark, d))


# Status-change requests derived from the supplier table: owners pause
# (id % 3 = 0) and re-activate later (id % 6 = 0); a non-owner tries to
# archive (id % 3 = 1); an invalid status is requested (id % 5 = 4).
def _campaign_changes(spark, d):
    s = fx.read_table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")

    def part(cond, adv, status, ts):
        return s.filter(cond).select(k.alias("campaign_id"), adv.alias("advertiser_id"),
                                     F.lit(status).alias("status"),
                                     F.lit(ts).cast("timestamp_ntz").alias("ts"))
    return (part(k % 3 == 0, n, "paused", "2024-01-10 00:00:00")
            .unionByName(part(k % 3 == 1, (n + 1) % 25, "archived", "2024-01-11 00:00:00"))
            .unionByName(part(k % 6 == 0, n, "active", "2024-01-12 00:00:00"))
            .unionByName(part(k % 5 == 4, n, "deleted", "2024-01-13 00:00:00")))


register("campaign_changes_v", (), """
    SELECT s_suppkey AS campaign_id, s_nationkey AS advertiser_id, 'paused' AS status,
           TIMESTAMP '2024-01-10 00:00:00' AS ts FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25, 'archived', TIMESTAMP '2024-01-11 00:00:00'
              FROM supplier WHERE s_suppkey % 3 = 1
    UNION ALL SELECT s_suppkey, s_nationkey, 'active', TIMESTAMP '2024-01-12 00:00:00'
              FROM supplier WHERE s_suppkey % 6 = 0
    UNION ALL SELECT s_suppkey, s_nationkey, 'deleted', TIMESTAMP '2024-01-13 00:00:00'
              FROM supplier WHERE s_suppkey % 5 = 4""")


@query("status_changes", ("S14",), with_views(("campaigns_v", "campaign_changes_v"), """
    SELECT k.campaign_id, coalesce(l.new_status, k.status) AS status
    FROM campaigns_v k LEFT JOIN (
        SELECT c.campaign_id, arg_max(c.status, c.ts) AS new_status
        FROM campaign_changes_v c
        JOIN campaigns_v o ON o.campaign_id = c.campaign_id AND o.advertiser_id = c.advertiser_id
        WHERE c.status IN ('active', 'paused', 'archived') GROUP BY c.campaign_id) l
      ON l.campaign_id = k.campaign_id"""))
def status_changes(spark, d):
    camps = fx.campaigns(spark, d)
    updated, _ = I.apply_status_changes(camps, _campaign_changes(spark, d),
                                        camps.select("campaign_id", "advertiser_id"), "campaign_id")
    return updated.select("campaign_id", "status")


@query("rejected_status_changes", ("S14",), with_views(("campaigns_v", "campaign_changes_v"), """
    SELECT c.campaign_id, c.advertiser_id, c.status FROM campaign_changes_v c
    WHERE c.status NOT IN ('active', 'paused', 'archived')
       OR NOT EXISTS (SELECT 1 FROM campaigns_v o
                      WHERE o.campaign_id = c.campaign_id AND o.advertiser_id = c.advertiser_id)"""))
def rejected_status_changes(spark, d):
    camps = fx.campaigns(spark, d)
    _, rejected = I.apply_status_changes(camps, _campaign_changes(spark, d),
                                         camps.select("campaign_id", "advertiser_id"), "campaign_id")
    return rejected.select("campaign_id", "advertiser_id", "status")


# Ad pauses: the owning advertiser asks for ad_id % 4 = 0, another one for % 4 = 1.
@query("ad_status_changes", ("S14", "J10"), with_views(("ads_v", "campaigns_v"), """
    SELECT a.ad_id, CASE WHEN a.ad_id % 4 = 0 THEN 'paused' ELSE a.status END AS status
    FROM ads_v a"""))
def ad_status_changes(spark, d):
    ads, camps = fx.ads(spark, d), fx.campaigns(spark, d)
    owners = I.owned_ads(ads, camps)
    req = owners.filter(F.col("ad_id") % 4 <= 1).select(
        "ad_id",
        F.when(F.col("ad_id") % 4 == 0, F.col("advertiser_id"))
         .otherwise((F.col("advertiser_id") + 1) % 25).alias("advertiser_id"),
        F.lit("paused").alias("status"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz").alias("ts"))
    updated, _ = I.apply_status_changes(ads, req, owners, "ad_id")
    return updated.select("ad_id", "status")


# Advertiser sign-ups 20..44 arrive; 20..24 already exist and are kept as they are.
@query("insert_absent", ("S13",), with_views(("advertisers_v",), """
    SELECT advertiser_id, name FROM advertisers_v
    UNION ALL
    SELECT n_nationkey + 20, 'new ' || n_name FROM nation
    WHERE n_nationkey + 20 NOT IN (SELECT advertiser_id FROM advertisers_v)"""))
def insert_absent(spark, d):
    dim = fx.advertisers(spark, d)
    new = fx.read_table(spark, d, "nation").select(
        (F.col("n_nationkey") + 20).alias("advertiser_id"),
        F.concat(F.lit("new "), F.col("n_name")).alias("name"),
        F.lit(None).cast("string").alias("contact_email"), F.lit(True).alias("active"),
        F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").alias("created_at"))
    return I.insert_absent(dim, new, "advertiser_id").select("advertiser_id", "name")


@query("purge_prefix", ("S15",), with_views(("ads_v", "campaigns_v"), """
    SELECT a.ad_id, a.campaign_id FROM ads_v a
    WHERE a.campaign_id NOT IN (SELECT campaign_id FROM campaigns_v WHERE starts_with(name, 'campaign 1'))"""))
def purge_prefix(spark, d):
    _, kept_ads = I.purge_prefix(fx.campaigns(spark, d), fx.ads(spark, d), "campaign_id", "name", "campaign 1")
    return kept_ads.select("ad_id", "campaign_id")


@query("campaign_listing", ("P12",), with_views(("campaigns_v",), """
    SELECT campaign_id, name, created_at,
           row_number() OVER (ORDER BY created_at DESC, campaign_id) AS position
    FROM campaigns_v WHERE advertiser_id = 7"""))
def campaign_listing(spark, d):
    from pyspark.sql import Window

    listed = I.list_campaigns(fx.campaigns(spark, d), 7)
    w = Window.partitionBy("advertiser_id").orderBy(F.col("created_at").desc(), F.col("campaign_id"))
    return listed.select("campaign_id", "name", "created_at", F.row_number().over(w).alias("position"))
