"""Domain views derived from the driver tables (FIXTURES.md section 3).

Every view is a lazy DataFrame over the parquet scans, so Catalyst prunes the
columns and pushes the filters (e.g. ``event_type``) into the scan. The
derivation expressions are mirrored one-for-one by the DuckDB oracle CTEs in
``adflow.plans.oracle`` -- ids stay integers so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

INVENTORY_AS_OF = "2024-01-15"
# Fixed value: the key of development set-ups. Production code is given its own.
SIGNING_KEY = "dev-only-insecure-pepper"


def _n_campaigns(spark: SparkSession, sf_dir: str) -> Column:
    """Number of suppliers as a scalar subquery (evaluated once, no join)."""
    return read_table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()


def _n_ads(spark: SparkSession, sf_dir: str) -> Column:
    """Number of parts (every part is an ad) as a scalar subquery."""
    return read_table(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()


def _device_of(col: Column) -> Column:
    # event_id % 6: 0-2 mobile, 3-4 desktop, 5 tablet (simulator weights)
    m = col % 6
    return F.when(m < 3, "mobile").when(m < 5, "desktop").otherwise("tablet")


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read_table(spark, sf_dir, "part")
            .select("p_partkey", "p_name", F.split("p_name", " ").alias("words")))


def advertisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("advertiser_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("ads@"), F.lower("n_name"), F.lit(".example")).alias("contact_email"),
        (F.col("n_nationkey") != 24).alias("active"),
        F.lit("2023-11-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign rows; ``target_keywords`` is a JSON string as stored upstream."""
    s = read_table(spark, sf_dir, "supplier")
    ct = F.lit(200) + F.round(F.abs(F.col("s_acctbal")) * 100).cast("bigint") % 1200
    key = F.col("s_suppkey")
    base = s.select(
        key.alias("campaign_id"),
        F.col("s_nationkey").alias("advertiser_id"),
        F.concat(F.lit("campaign "), key.cast("string")).alias("name"),
        (F.lit(0.01) * (F.lit(1) + key % 5)).alias("daily_budget_usd"),
        (ct / 100.0).cast("double").alias("target_cpm"),
        (F.floor(ct * 3 / 10) / 100.0).cast("double").alias("floor_price"),
        F.when(key % 6 == 3, "mobile").when(key % 6 == 4, "desktop")
         .when(key % 6 == 5, "tablet").otherwise("all").alias("target_device"),
        F.when(key % 4 == 1, F.lit("2024-01-08").cast("date")).alias("start_date"),
        F.when(key % 5 == 2, F.lit("2024-01-22").cast("date")).alias("end_date"),
        F.when(key % 10 == 9, "paused").otherwise("active").alias("status"),
        (F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), (key % 1440).cast("int"))).alias("created_at"),
        (key % _n_ads(spark, sf_dir)).alias("_kw_part"),
    )
    words = _part_words(spark, sf_dir).select(
        F.col("p_partkey").alias("_kw_part"), F.to_json("words").alias("target_keywords"))
    return (base.join(words, "_kw_part", "left")
            .select("campaign_id", "advertiser_id", "name", "daily_budget_usd", "target_cpm",
                    "floor_price", "target_device", "target_keywords", "start_date",
                    "end_date", "status", "created_at"))


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("ad_id"),
        (key % _n_campaigns(spark, sf_dir)).alias("campaign_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit('<div class="ad"><a href="{{CLICK_URL}}">'), F.col("p_name"),
                 F.lit("</a></div>")).alias("creative_html"),
        F.concat(F.lit("https://shop"), (key % 7).cast("string"), F.lit(".example/p/"),
                 key.cast("string")).alias("destination_url"),
        F.when(key % 13 == 12, "paused").otherwise("active").alias("status"),
        F.date_sub(F.lit("2024-01-01").cast("date"), (key % 90).cast("int"))
         .cast("timestamp_ntz").alias("created_at"),
    )


def publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three publishers impressions refer to (pub_0..pub_2)."""
    e = read_table(spark, sf_dir, "events")
    ids = e.select((F.col("user_id") % 3).alias("k")).distinct()
    return ids.select(
        F.concat(F.lit("pub_"), F.col("k").cast("string")).alias("publisher_id"),
        F.concat(F.lit("https://site"), F.col("k").cast("string"), F.lit(".example")).alias("domain"),
        F.lit(True).alias("active"),
        F.lit("2023-11-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def _events(spark: SparkSession, sf_dir: str, events: DataFrame | None) -> DataFrame:
    """The events table, or a given (possibly streaming) events DataFrame."""
    return events if events is not None else read_table(spark, sf_dir, "events")


def _served_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return _events(spark, sf_dir, events).filter(F.col("event_type") != "click")


def impressions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None,
                with_request: bool = False) -> DataFrame:
    """Impression log rows (no feature vector). ``with_request`` adds the
    request context of the same event (page keywords) from the same scan,
    so logging features needs no id join between impressions and requests."""
    e = _served_events(spark, sf_dir, events)
    eid, uid = F.col("event_id"), F.col("user_id")
    ad_id = (eid * 7 + uid) % _n_ads(spark, sf_dir)
    n_cand = F.lit(2) + eid % 5
    explore = (eid % 13 == 0)
    imp = e.select(
        eid.alias("impression_id"),
        F.col("ts"),
        F.concat(F.lit("pub_"), (uid % 3).cast("string")).alias("publisher_id"),
        F.concat(F.lit("plc_"), (uid % 6 + 1).cast("string")).alias("placement_id"),
        ad_id.alias("ad_id"),
        (ad_id % _n_campaigns(spark, sf_dir)).alias("campaign_id"),
        uid.alias("user_id"),
        _device_of(eid).alias("device_type"),
        (F.lit(1) + F.col("value") % 9).alias("win_price"),
        explore.alias("is_exploration"),
        F.when(explore, F.lit(0.08) / n_cand)
         .otherwise(F.lit(0.92) + F.lit(0.08) / n_cand).alias("serve_propensity"),
        F.when(uid % 4 == 0, "baseline").otherwise("v20240101_000000").alias("model_version"),
        *([F.get_json_object("props", "$.k").cast("bigint").alias("_kw_part")] if with_request else []),
    )
    camp = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("campaign_id"), F.col("s_nationkey").alias("advertiser_id"))
    out = imp.join(camp, "campaign_id", "left")
    if with_request:
        words = _part_words(spark, sf_dir).select(
            F.col("p_partkey").alias("_kw_part"), F.col("words").alias("page_keywords"))
        out = (out.join(words, "_kw_part", "left").drop("_kw_part")
               .withColumn("request_id", F.col("impression_id")).withColumn("server_ts", F.col("ts")))
    return out


def requests(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Bid requests: the same events as impressions, with page keywords."""
    e = _served_events(spark, sf_dir, events)
    eid, uid = F.col("event_id"), F.col("user_id")
    req = e.select(
        eid.alias("request_id"),
        F.concat(F.lit("pub_"), (uid % 3).cast("string")).alias("publisher_id"),
        F.concat(F.lit("plc_"), (uid % 6 + 1).cast("string")).alias("placement_id"),
        F.concat(F.lit("https://site"), (uid % 3).cast("string"), F.lit(".example/a/"),
                 eid.cast("string")).alias("page_url"),
        uid.cast("string").alias("user_id"),
        _device_of(eid).alias("device_type"),
        (F.lit(320) + (eid % 8) * 240).cast("int").alias("viewport_width"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.col("ts").alias("server_ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("_kw_part"),
        ((eid * 7 + uid) % _n_ads(spark, sf_dir)).alias("served_ad_id"),
    )
    words = _part_words(spark, sf_dir).select(
        F.col("p_partkey").alias("_kw_part"), F.col("words").alias("page_keywords"))
    return req.join(words, "_kw_part", "left").drop("_kw_part")


def raw_clicks(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Click events as received: (impression_id, ts); may be orphans or repeats."""
    e = _events(spark, sf_dir, events).filter(F.col("event_type") == "click")
    eid = F.col("event_id")
    return e.select(
        (eid - 1 - (eid * 7919) % 20).alias("impression_id"),
        F.col("ts"),
        eid.alias("click_event_id"),
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    eid = F.col("event_id")
    return e.select(
        (eid - 1 - eid % 7).alias("impression_id"),
        F.col("user_id"),
        F.lit("purchase").alias("conversion_type"),
        F.col("value").alias("conversion_value"),
        F.col("ts"),
        eid.alias("conversion_event_id"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log: raw clicks enriched with ad/placement from their impression."""
    from ..operators.attribution import enrich_clicks

    return enrich_clicks(raw_clicks(spark, sf_dir), impressions(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spend counter as the serving side holds it: increments recorded
    only up to 20:00 UTC (the rest were lost), and campaigns with
    ``campaign_id % 7 = 0`` never recorded at all."""
    from ..operators.spend import campaign_spend

    imp = impressions(spark, sf_dir).filter(F.hour("ts") < 20)
    return (campaign_spend(imp).filter(F.col("campaign_id") % 7 != 0)
            .select("campaign_id", "day", "spent_usd"))


def legacy_ad_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old ad-keyed spend counters; the last eleven keys name no existing ad."""
    imp = impressions(spark, sf_dir)
    key = (F.col("impression_id") * 7 + F.col("user_id")) % (_n_ads(spark, sf_dir) + 11)
    return (imp.groupBy(key.alias("ad_id"), F.to_date("ts").alias("day"))
            .agg((F.sum(F.round(F.col("win_price") * 1000).cast("bigint")) / 1e6).alias("spent_usd")))
