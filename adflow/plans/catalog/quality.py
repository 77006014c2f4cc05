"""Validation queries (P5-P10). Submissions are the fixture rows with
deterministic defects injected by id residue, so every rule fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import quality as Q
from ..registry import query
from .common import fx, with_views


def _cycle(k, every: int, *values):
    """The values in turn on every ``every``-th row; the oracle spells out the same CASE."""
    turn = F.floor(k / every) % len(values)
    pick = F.when(turn == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        pick = pick.when(turn == i, v)
    return pick


def _requests_received(spark, d):
    """Requests with defects and with values on both sides of each limit."""
    r = fx.requests(spark, d)
    k = F.col("request_id")
    shift = _cycle(k, 23, 60000, 60001, -60000, -60001)
    return (r.withColumn("device_type", F.when(k % 17 == 0, "phone").otherwise(F.col("device_type")))
            .withColumn("viewport_width", F.when(k % 19 == 0, _cycle(k, 19, 10000, 10001, -1, 0))
                        .otherwise(F.col("viewport_width")))
            .withColumn("timestamp_ms", F.when(k % 23 == 0, F.col("timestamp_ms") + shift)
                        .otherwise(F.col("timestamp_ms")))
            .withColumn("authenticated_publisher", F.when(k % 29 == 0, "pub_x").otherwise(F.col("publisher_id")))
            .withColumn("page_url", F.when(k % 31 == 0, F.repeat(F.lit("x"), (F.floor(k / 31) % 2 + 2048).cast("int")))
                        .otherwise(F.col("page_url"))))


@query("rejected_requests", ("P5", "P10"), with_views(("requests_v",), """
    SELECT request_id, reasons FROM (
      SELECT request_id, concat_ws(',',
        CASE WHEN length(page_url) > 2048 THEN 'page_url' END,
        CASE WHEN device_type NOT IN ('mobile', 'desktop', 'tablet') THEN 'device_type' END,
        CASE WHEN viewport_width < 0 OR viewport_width > 10000 THEN 'viewport_width' END,
        CASE WHEN abs(epoch_us(server_ts) // 1000 - timestamp_ms) > 60000 THEN 'timestamp_ms' END,
        CASE WHEN publisher_id <> authenticated THEN 'publisher_mismatch' END) AS reasons
      FROM (SELECT request_id, server_ts, publisher_id,
              CASE WHEN request_id % 31 = 0 THEN repeat('x', CAST(request_id // 31 % 2 + 2048 AS INTEGER)) ELSE page_url END AS page_url,
              CASE WHEN request_id % 17 = 0 THEN 'phone' ELSE device_type END AS device_type,
              CASE WHEN request_id % 19 = 0 THEN CASE request_id // 19 % 4 WHEN 0 THEN 10000 WHEN 1 THEN 10001
                   WHEN 2 THEN -1 ELSE 0 END ELSE viewport_width END AS viewport_width,
              timestamp_ms + CASE WHEN request_id % 23 = 0 THEN CASE request_id // 23 % 4 WHEN 0 THEN 60000
                   WHEN 1 THEN 60001 WHEN 2 THEN -60000 ELSE -60001 END ELSE 0 END AS timestamp_ms,
              CASE WHEN request_id % 29 = 0 THEN 'pub_x' ELSE publisher_id END AS authenticated
            FROM requests_v) r) x
    WHERE reasons <> ''"""))
def rejected_requests(spark, d):
    _, bad = Q.validate_requests(_requests_received(spark, d), "authenticated_publisher")
    return bad.select("request_id", "reasons")


@query("rejected_campaigns", ("P6",), with_views(("campaigns_v",), """
    SELECT campaign_id, reasons FROM (
      SELECT campaign_id, concat_ws(',',
        CASE WHEN length(name) < 1 OR length(name) > 200 THEN 'name' END,
        CASE WHEN budget <= 0 OR budget > 1000000 THEN 'daily_budget_usd' END,
        CASE WHEN cpm <= 0 OR cpm > 1000 THEN 'target_cpm' END,
        CASE WHEN floor < 0 OR floor > 1000 THEN 'floor_price' END,
        CASE WHEN floor > cpm THEN 'floor_above_cpm' END,
        CASE WHEN device NOT IN ('all', 'mobile', 'desktop', 'tablet') THEN 'target_device' END,
        CASE WHEN end_date < start_date THEN 'dates' END) AS reasons
      FROM (SELECT *, CASE WHEN campaign_id % 11 = 0 THEN cpm + campaign_id // 11 % 2 ELSE floor_price END AS floor
        FROM (SELECT campaign_id, floor_price, start_date,
              CASE WHEN campaign_id % 23 = 0 THEN repeat('n', CAST(CASE campaign_id // 23 % 3 WHEN 0 THEN 0 WHEN 1 THEN 200
                   ELSE 201 END AS INTEGER)) ELSE name END AS name,
              CASE WHEN campaign_id % 17 = 0 THEN CAST(CASE campaign_id // 17 % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1000000.0
                   WHEN 2 THEN 1000000.5 ELSE -1.0 END AS DOUBLE) ELSE daily_budget_usd END AS budget,
              CASE WHEN campaign_id % 7 = 0 THEN CAST(CASE campaign_id // 7 % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1000.01
                   ELSE 0.0 END AS DOUBLE) ELSE target_cpm END AS cpm,
              CASE WHEN campaign_id % 13 = 0 THEN 'phone' ELSE target_device END AS device,
              CASE WHEN campaign_id % 19 = 0 THEN CASE campaign_id // 19 % 2 WHEN 0 THEN DATE '2024-01-08'
                   ELSE DATE '2024-01-07' END ELSE end_date END AS end_date
            FROM campaigns_v) c) f) x
    WHERE reasons <> ''"""))
def rejected_campaigns(spark, d):
    c = fx.campaigns(spark, d).withColumn("target_keywords", F.from_json("target_keywords", "array<string>"))
    k = F.col("campaign_id")
    dates = [F.lit(x).cast("date") for x in ("2024-01-08", "2024-01-07")]  # the first is a start date itself
    sub = (c.withColumn("target_cpm", F.when(k % 7 == 0, _cycle(k, 7, 1000.0, 1000.01, 0.0)).otherwise(F.col("target_cpm")))
           .withColumn("floor_price", F.when(k % 11 == 0, F.col("target_cpm") + F.floor(k / 11) % 2)
                       .otherwise(F.col("floor_price")))
           .withColumn("target_device", F.when(k % 13 == 0, "phone").otherwise(F.col("target_device")))
           .withColumn("daily_budget_usd", F.when(k % 17 == 0, _cycle(k, 17, 0.0, 1000000.0, 1000000.5, -1.0))
                       .otherwise(F.col("daily_budget_usd")))
           .withColumn("end_date", F.when(k % 19 == 0, _cycle(k, 19, *dates)).otherwise(F.col("end_date")))
           .withColumn("name", F.when(k % 23 == 0, F.repeat(F.lit("n"), _cycle(k, 23, 0, 200, 201).cast("int")))
                       .otherwise(F.col("name"))))
    _, bad = Q.validate_campaigns(sub)
    return bad.select("campaign_id", "reasons")


@query("rejected_ads", ("P7",), with_views(("ads_v",), """
    SELECT ad_id, reasons FROM (
      SELECT ad_id, concat_ws(',',
        CASE WHEN ad_id % 11 = 0 THEN 'click_macro' END,
        CASE WHEN ad_id % 17 = 0 THEN 'destination_scheme' END) AS reasons
      FROM ads_v) x
    WHERE reasons <> ''"""))
def rejected_ads(spark, d):
    a = fx.ads(spark, d)
    k = F.col("ad_id")
    sub = (a.withColumn("creative_html", F.when(k % 11 == 0, F.replace(F.col("creative_html"),
                                                                      F.lit("{{CLICK_URL}}"), F.lit("#")))
                        .otherwise(F.col("creative_html")))
           .withColumn("destination_url", F.when(k % 17 == 0, F.regexp_replace("destination_url", "^https", "ftp"))
                       .otherwise(F.col("destination_url"))))
    _, bad = Q.validate_ads(sub)
    return bad.select("ad_id", "reasons")


@query("publisher_validation", ("P8",), """
    SELECT publisher_id, CASE WHEN reasons = '' THEN rtrim(domain, '/') ELSE domain END AS domain, reasons FROM (
      SELECT publisher_id, domain, concat_ws(',',
        CASE WHEN length(publisher_id) < 3 OR length(publisher_id) > 64
                  OR NOT regexp_matches(publisher_id, '^[a-z0-9_]+$') THEN 'publisher_id' END,
        CASE WHEN NOT (starts_with(domain, 'http://') OR starts_with(domain, 'https://')) THEN 'domain_scheme' END
      ) AS reasons
      FROM (SELECT CASE WHEN page_id % 10 = 0 THEN 'P-' || CAST(page_id AS VARCHAR)
                        ELSE 'p' || CAST(page_id AS VARCHAR) END AS publisher_id,
                   CASE WHEN page_id % 7 = 0 THEN regexp_replace(regexp_extract(url, '^(https?://[^/?#]+)', 1),
                                                                 '^https?://', '')
                        ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) END || '/' AS domain
            FROM pages) s) x""")
def publisher_validation(spark, d):
    p = fx.read_table(spark, d, "pages")
    k = F.col("page_id")
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    sub = p.select(
        F.when(k % 10 == 0, F.concat(F.lit("P-"), k.cast("string")))
         .otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("publisher_id"),
        F.concat(F.when(k % 7 == 0, F.regexp_replace(origin, "^https?://", "")).otherwise(origin),
                 F.lit("/")).alias("domain"))
    ok, bad = Q.validate_publishers(sub)
    return ok.withColumn("reasons", F.lit("")).unionByName(bad)


@query("rejected_conversions", ("P9",), with_views(("conversions_v",), """
    SELECT conversion_event_id, reasons FROM (
      SELECT conversion_event_id, concat_ws(',',
        CASE WHEN length(kind) > 64 THEN 'conversion_type' END,
        CASE WHEN worth < 0 THEN 'conversion_value' END) AS reasons
      FROM (SELECT conversion_event_id,
              CASE WHEN conversion_event_id % 13 = 0 THEN repeat('x', CAST(CASE conversion_event_id // 13 % 3 WHEN 0 THEN 64
                   WHEN 1 THEN 65 ELSE 0 END AS INTEGER)) ELSE conversion_type END AS kind,
              CASE WHEN conversion_event_id % 11 = 0 THEN CASE conversion_event_id // 11 % 2 WHEN 0 THEN 0.0
                   ELSE -conversion_value END ELSE conversion_value END AS worth
            FROM conversions_v) c) x
    WHERE reasons <> ''"""))
def rejected_conversions(spark, d):
    c = fx.conversions(spark, d)
    k = F.col("conversion_event_id")
    sub = (c.withColumn("conversion_value", F.when(k % 11 == 0, _cycle(k, 11, F.lit(0.0), -F.col("conversion_value")))
                        .otherwise(F.col("conversion_value")))
           .withColumn("conversion_type", F.when(k % 13 == 0, F.repeat(F.lit("x"), _cycle(k, 13, 64, 65, 0).cast("int")))
                       .otherwise(F.col("conversion_type"))))
    _, bad = Q.validate_conversions(sub)
    return bad.select("conversion_event_id", "reasons")


# Ids as strings: hyphenated digests, and the same cut, stretched, without hyphens or with a wrong digit.
@query("uuid_checks", ("F20",), """
    SELECT event_id, id, coalesce(regexp_matches(id, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$'), false) AS valid
    FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN left(u, 35) WHEN 1 THEN u || '0' WHEN 2 THEN replace(u, '-', '')
                 WHEN 3 THEN replace(u, '1', 'g') WHEN 4 THEN upper(u) WHEN 5 THEN NULL ELSE u END AS id
          FROM (SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
                       || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u
                FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR) || event_type) AS h FROM events) a) b) c""")
def uuid_checks(spark, d):
    from ...functions import expr as X

    h = F.md5(F.concat(F.col("event_id").cast("string"), "event_type").cast("binary"))
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    k = F.col("event_id") % 7
    ids = (F.when(k == 0, F.substring("u", 1, 35)).when(k == 1, F.concat("u", F.lit("0")))
           .when(k == 2, F.replace("u", F.lit("-"), F.lit(""))).when(k == 3, F.replace("u", F.lit("1"), F.lit("g")))
           .when(k == 4, F.upper("u")).when(k != 5, F.col("u")))
    events = fx.read_table(spark, d, "events").select("event_id", u.alias("u"))
    return events.select("event_id", ids.alias("id"), X.is_uuid(ids).alias("valid"))
