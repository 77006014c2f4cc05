"""Advertiser-side dimensions: servable inventory and maintenance (J1, P1,
S10, S13-S15, J10, A14, P12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

INVENTORY_COLUMNS = ("ad_id", "advertiser_id", "creative_html", "destination_url", "target_cpm",
                     "floor_price", "target_device", "target_keywords", "daily_budget_usd",
                     "campaign_id", "created_at")


# J1 + P1 -- ads x campaigns x advertisers, active and in flight on ``as_of``.
def servable_ads(ads: DataFrame, campaigns: DataFrame, advertisers: DataFrame, as_of) -> DataFrame:
    """Three dimension tables, each keyed; the filters sit on each side so
    Catalyst pushes them below the joins (and into the scans)."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    a = ads.filter(F.col("status") == "active").select(
        "ad_id", "campaign_id", "creative_html", "destination_url", "created_at")
    c = campaigns.filter(
        (F.col("status") == "active")
        & (F.col("start_date").isNull() | (F.col("start_date") <= day))
        & (F.col("end_date").isNull() | (F.col("end_date") >= day))
    ).select("campaign_id", "advertiser_id", "target_cpm", "floor_price", "target_device",
             "target_keywords", "daily_budget_usd")
    d = advertisers.filter(F.col("active")).select("advertiser_id")
    return (a.join(c, "campaign_id", "inner")
            .join(d, "advertiser_id", "inner")
            .select(*INVENTORY_COLUMNS))


# S10 -- decode the snapshot; a bad row is quarantined, never the snapshot.
def load_inventory(servable: DataFrame) -> tuple[DataFrame, DataFrame]:
    kw_type = dict(servable.dtypes)["target_keywords"]
    kws = X.json_string_list("target_keywords") if kw_type == "string" else F.col("target_keywords")
    decoded = (servable
               .withColumn("_kw", kws)
               .withColumn("_cpm", F.col("target_cpm").try_cast("double"))
               .withColumn("_floor", F.col("floor_price").try_cast("double"))
               .withColumn("_budget", F.col("daily_budget_usd").try_cast("double")))
    reason = F.concat_ws(",", F.array_compact(F.array(
        F.when(F.col("ad_id").isNull(), F.lit("ad_id")),
        F.when(F.col("_cpm").isNull(), F.lit("target_cpm")),
        F.when(F.col("_floor").isNull(), F.lit("floor_price")),
        F.when(F.col("_budget").isNull(), F.lit("daily_budget_usd")),
        F.when(F.col("target_keywords").isNotNull() & F.col("_kw").isNull(), F.lit("target_keywords")),
    )))
    tagged = decoded.withColumn("_reason", reason)
    good = (tagged.filter(F.col("_reason") == "")
            .withColumn("target_keywords", F.coalesce(F.col("_kw"), F.array().cast("array<string>")))
            .withColumn("target_cpm", F.col("_cpm"))
            .withColumn("floor_price", F.col("_floor"))
            .withColumn("daily_budget_usd", F.col("_budget"))
            .drop("_kw", "_cpm", "_floor", "_budget", "_reason"))
    bad = (tagged.filter(F.col("_reason") != "")
           .withColumnRenamed("_reason", "reason")
           .drop("_kw", "_cpm", "_floor", "_budget"))
    return good, bad


# S13 -- insert rows whose key is absent (ON CONFLICT DO NOTHING).
def insert_absent(dim: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    # Of several new rows with one key, the choice depends on their content alone.
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(*new.columns), *[F.col(c).cast("string") for c in new.columns])
    fresh = (new.join(dim.select(*keys), keys, "left_anti")
             .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn"))
    return dim.unionByName(fresh.select(*dim.columns))


# S14 + J10 -- status changes applied only where the requester owns the row.
def owned_ads(ads: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(ad_id, advertiser_id) ownership through the campaign (J10 semi-join form)."""
    return ads.select("ad_id", "campaign_id").join(
        campaigns.select("campaign_id", "advertiser_id"), "campaign_id", "inner")


def apply_status_changes(dim: DataFrame, changes: DataFrame, owners: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``changes`` (key, advertiser_id, status, ts); ``owners`` (key, advertiser_id).

    Returns (updated dimension, rejected changes). Every change is tagged accepted
    or rejected by itself. The latest accepted change per key wins (``max_by`` on
    ts), applied with a left join + coalesce.
    """
    from .. import constants as K

    owned = owners.select(key, "advertiser_id").distinct().withColumn("_owned", F.lit(True))
    tagged = changes.join(owned, [key, "advertiser_id"], "left").withColumn(
        "_ok", F.coalesce(F.col("_owned") & F.col("status").isin(*K.STATUSES), F.lit(False)))
    accepted = tagged.filter("_ok")
    rejected = tagged.filter("NOT _ok").select(*changes.columns)
    latest = accepted.groupBy(key).agg(F.max_by("status", F.struct("ts", "status")).alias("_new_status"))
    updated = (dim.join(latest, key, "left")
               .withColumn("status", F.coalesce(F.col("_new_status"), F.col("status")))
               .drop("_new_status"))
    return updated.select(*dim.columns), rejected


# S15 -- purge rows by id prefix, children first (FK order).
def purge_prefix(parent: DataFrame, children: DataFrame, key: str, column: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    doomed = parent.filter(F.col(column).startswith(prefix)).select(key)
    kept_children = children.join(doomed, key, "left_anti")
    kept_parent = parent.join(doomed, key, "left_anti")
    return kept_parent, kept_children


# A14 -- inventory counts.
def inventory_summary(ads: DataFrame, campaigns: DataFrame, advertisers: DataFrame, servable: DataFrame) -> DataFrame:
    parts = [
        ads.groupBy(F.concat(F.lit("ads_"), F.col("status")).alias("metric")).count(),
        campaigns.groupBy(F.concat(F.lit("campaigns_"), F.col("status")).alias("metric")).count(),
        advertisers.groupBy(F.when(F.col("active"), "advertisers_active")
                            .otherwise("advertisers_inactive").alias("metric")).count(),
        servable.groupBy(F.concat(F.lit("servable_"), F.col("target_device")).alias("metric")).count(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("count", "n")


# P12 -- campaigns of one advertiser, newest first.
def list_campaigns(campaigns: DataFrame, advertiser_id) -> DataFrame:
    return (campaigns.filter(F.col("advertiser_id") == F.lit(advertiser_id))
            .orderBy(F.col("created_at").desc(), F.col("campaign_id")))
