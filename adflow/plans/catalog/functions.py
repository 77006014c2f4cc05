"""Scalar-function queries: signing (F22-F25, R4), URL and markup helpers
(F24, F26), user-agent and page-keyword extraction (F27, F28)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import expr as X
from ...functions import signing as G
from ...operators.audit import audit_clicks, audit_summary
from ..registry import query
from .common import fx, register, with_views

_IPAD, _OPAD = G._padded_keys(fx.SIGNING_KEY)


def hmac_hex_sql(msg_sql: str) -> str:
    inner = f"sha256(unhex('{_IPAD}') || encode({msg_sql}))"
    return f"sha256(unhex('{_OPAD}') || unhex({inner}))"


def sig_sql(id_sql: str, exp_sql: str) -> str:
    msg = f"CAST({id_sql} AS VARCHAR) || ':' || CAST({exp_sql} AS VARCHAR)"
    raw = f"to_base64(unhex(substr({hmac_hex_sql(msg)}, 1, 32)))"
    return f"rtrim(translate({raw}, '+/', '-_'), '=')"


def _exp(ts_col="ts"):
    return (F.unix_seconds(F.col(ts_col).cast("timestamp")) + K.CLICK_URL_TTL_SECONDS).alias("exp")


@query("click_signatures", ("F22",), with_views(("impressions_v",), f"""
    SELECT impression_id, (epoch_us(ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS} AS exp,
           {sig_sql('impression_id', f'(epoch_us(ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS}')} AS sig
    FROM impressions_v"""))
def click_signatures(spark, d):
    imp = fx.impressions(spark, d).select("impression_id", _exp())
    return imp.withColumn("sig", G.click_signature("impression_id", "exp", fx.SIGNING_KEY))


register("signed_v", ("impressions_v", "ads_v"), f"""
    SELECT i.impression_id, i.ts, i.publisher_id, a.creative_html,
           (epoch_us(i.ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS} AS exp,
           '{K.DEFAULT_PUBLIC_BASE_URL}/v1/click?id=' || CAST(i.impression_id AS VARCHAR) || '&exp=' ||
           CAST((epoch_us(i.ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS} AS VARCHAR) || '&sig=' ||
           {sig_sql('i.impression_id', f'(epoch_us(i.ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS}')} AS click_url
    FROM impressions_v i JOIN ads_v a ON a.ad_id = i.ad_id""")


def _signed(spark, d):
    imp = fx.impressions(spark, d).select("impression_id", "ts", "publisher_id", "ad_id", _exp())
    ads = fx.ads(spark, d).select("ad_id", "creative_html")
    return (imp.join(ads, "ad_id", "inner")
            .withColumn("click_url", G.click_url("impression_id", "exp", fx.SIGNING_KEY)))


@query("signed_urls", ("F23",), with_views(("signed_v",), """
    SELECT impression_id, click_url, replace(creative_html, '{{CLICK_URL}}', click_url) AS ad_markup
    FROM signed_v"""))
def signed_urls(spark, d):
    s = _signed(spark, d)
    return s.select("impression_id", "click_url", G.render_creative("creative_html", "click_url").alias("ad_markup"))


@query("extracted_click_urls", ("F24",), with_views(("signed_v",), """
    SELECT impression_id, regexp_extract(replace(creative_html, '{{CLICK_URL}}', click_url), 'href="([^"]+)"', 1)
               AS url
    FROM signed_v"""))
def extracted_click_urls(spark, d):
    s = _signed(spark, d)
    return s.select("impression_id",
                    X.extract_click_url(G.render_creative("creative_html", "click_url")).alias("url"))


# Click requests as they reach the tracker: each enriched click presents the
# URL minted for its impression, with tampering by click id residue.
def _click_requests(spark, d):
    c = fx.clicks(spark, d)
    imp = fx.impressions(spark, d).select("impression_id", F.col("ts").alias("imp_ts"))
    k = F.col("click_event_id")
    base = c.join(imp, "impression_id").withColumn("exp", _exp("imp_ts"))
    good_sig = G.click_signature("impression_id", "exp", fx.SIGNING_KEY)
    other_sig = G.click_signature(F.col("impression_id") + 1, F.col("exp"), fx.SIGNING_KEY)
    return base.select(
        "click_event_id", "impression_id", "publisher_id",
        F.when(k % 7 == 0, F.col("exp") + 86400).otherwise(F.col("exp")).alias("exp"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 13 == 0, F.lit("AAAAAAAAAAAAAAAAAAAAAA"))
         .when(k % 5 == 0, other_sig).otherwise(good_sig).alias("sig"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("now_unix"))


register("click_requests_v", ("clicks_v", "impressions_v"), f"""
    SELECT c.click_event_id, c.impression_id, c.publisher_id,
           CASE WHEN c.click_event_id % 7 = 0 THEN (epoch_us(i.ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS} + 86400
                ELSE (epoch_us(i.ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS} END AS exp,
           CASE WHEN c.click_event_id % 11 = 0 THEN NULL
                WHEN c.click_event_id % 13 = 0 THEN 'AAAAAAAAAAAAAAAAAAAAAA'
                WHEN c.click_event_id % 5 = 0 THEN {sig_sql('c.impression_id + 1', f'(epoch_us(i.ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS}')}
                ELSE {sig_sql('c.impression_id', f'(epoch_us(i.ts) // 1000000) + {K.CLICK_URL_TTL_SECONDS}')} END AS sig,
           (epoch_us(c.ts) // 1000000) AS now_unix
    FROM clicks_v c JOIN impressions_v i ON i.impression_id = c.impression_id""")
register("click_verdicts_v", ("click_requests_v",), f"""
    SELECT *, CASE WHEN exp IS NULL OR sig IS NULL THEN 'unsigned'
                   WHEN now_unix > exp THEN 'expired'
                   WHEN exp > now_unix + {K.CLICK_URL_TTL_SECONDS + K.CLICK_MAX_FUTURE_SLACK_SECONDS} THEN 'too_far_in_future'
                   WHEN sig <> {sig_sql('impression_id', 'exp')} THEN 'signature_mismatch'
                   ELSE 'ok' END AS verdict
    FROM click_requests_v""")


@query("click_verdicts", ("R4", "F22"), with_views(("click_verdicts_v",), """
    SELECT click_event_id, impression_id, verdict FROM click_verdicts_v"""))
def click_verdicts(spark, d):
    return audit_clicks(_click_requests(spark, d), fx.SIGNING_KEY).select("click_event_id", "impression_id", "verdict")


@query("click_audit", ("R4",), with_views(("click_verdicts_v",), """
    SELECT publisher_id, verdict, count(*) AS n FROM click_verdicts_v GROUP BY 1, 2"""))
def click_audit(spark, d):
    return audit_summary(audit_clicks(_click_requests(spark, d), fx.SIGNING_KEY), "publisher_id")


@query("key_hashes", ("F25",), f"""
    SELECT page_id, substr(k, 1, 16) AS key_prefix, {hmac_hex_sql('k')} AS key_hash
    FROM (SELECT page_id, 'pk_test_' || substr(sha256(url), 1, 43) AS k FROM pages) x""")
def key_hashes(spark, d):
    p = fx.read_table(spark, d, "pages")
    k = F.concat(F.lit("pk_test_"), F.substring(F.sha2(F.col("url"), 256), 1, 43))
    return p.select("page_id", G.key_prefix(k).alias("key_prefix"), G.key_hash(k, fx.SIGNING_KEY).alias("key_hash"))


# Connection URLs with credentials (page_id % 3 <> 0) built from page URLs.
@query("redacted_urls", ("F26",), """
    SELECT page_id,
           CASE WHEN NOT contains(u, '@') THEN u
                ELSE CASE WHEN contains(u, '://') THEN split_part(u, '://', 1) ELSE u END || '://***@' ||
                     CASE WHEN contains(u, '://') AND contains(substr(u, strpos(u, '://') + 3), '@')
                          THEN substr(substr(u, strpos(u, '://') + 3), strpos(substr(u, strpos(u, '://') + 3), '@') + 1)
                          ELSE '' END END AS redacted
    FROM (SELECT page_id,
                 CASE WHEN page_id % 3 = 0 THEN url
                      ELSE regexp_replace(url, '^(https?)://', '\\1://user' || CAST(page_id AS VARCHAR) || ':s3cr@t@')
                 END AS u FROM pages) x""")
def redacted_urls(spark, d):
    p = fx.read_table(spark, d, "pages")
    k = F.col("page_id")
    u = F.when(k % 3 == 0, F.col("url")).otherwise(
        F.regexp_replace("url", r"^(https?)://", F.concat(F.lit("$1://user"), k.cast("string"), F.lit(":s3cr@t@"))))
    return p.select("page_id", X.redact_url(u).alias("redacted"))


# Every event's user agent, put together from its columns: a platform of its device, the
# value as the version, the id as the build and the event type.
_PLATFORMS = {"mobile": ("iPhone; CPU iPhone OS 17_0 like Mac OS X", "Linux; Android 14; Pixel 8) Gecko (Mobile"),
              "tablet": ("iPad; CPU OS 16_0 like Mac OS X", "Linux; Android 13; SM-X710", "Linux; U; KFAPWI) Silk (Tablet"),
              "desktop": ("Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 14_0", "X11; Linux x86_64")}
_PLATFORM_SQL = " ".join(
    f"WHEN {test} THEN CASE user_id % {len(_PLATFORMS[device])} "
    + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PLATFORMS[device])) + " END"
    for test, device in (("event_id % 6 < 3", "mobile"), ("event_id % 6 < 5", "desktop"), ("true", "tablet")))


def _user_agents(spark, d):
    e = fx.read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    pick = {device: F.element_at(F.array(*[F.lit(p) for p in ps]), (F.col("user_id") % len(ps) + 1).cast("int"))
            for device, ps in _PLATFORMS.items()}
    k = F.col("event_id") % 6
    platform = F.when(k < 3, pick["mobile"]).when(k < 5, pick["desktop"]).otherwise(pick["tablet"])
    return e.select("event_id", F.concat(F.lit("Mozilla/5.0 ("), platform, F.lit(") Version/"), F.floor("value").cast("bigint").cast("string"),
                                         F.lit(" Build/"), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("ua"))


@query("device_class", ("F27",), f"""
    SELECT event_id, length(ua) AS ua_chars,
           CASE WHEN regexp_matches(ua, '(?i)iPad|Tablet')
                     OR (regexp_matches(ua, '(?i)Android') AND NOT regexp_matches(ua, '(?i)Android.*Mobile'))
                THEN 'tablet'
                WHEN regexp_matches(ua, '(?i)Mobi|Android|iPhone') THEN 'mobile'
                ELSE 'desktop' END AS device
    FROM (SELECT event_id, 'Mozilla/5.0 (' || CASE {_PLATFORM_SQL} END || ') Version/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
                 || ' Build/' || CAST(event_id AS VARCHAR) || ' ' || event_type AS ua FROM events) x""")
def device_class(spark, d):
    return _user_agents(spark, d).select("event_id", F.length("ua").cast("bigint").alias("ua_chars"), X.device_class("ua").alias("device"))


# Pages with a keywords meta tag injected (page_id % 4 <> 0); the content
# mixes case, blanks and padding, and page_id % 5 = 0 pages list 12 terms.
def _tagged_pages(spark, d):
    p = fx.read_table(spark, d, "pages").select("page_id", "html")
    words = fx.read_table(spark, d, "part").select(F.col("p_partkey").alias("_k"), "p_name")
    j = p.withColumn("_k", F.col("page_id") % fx._n_ads(spark, d)).join(words, "_k", "left")
    w = F.split("p_name", " ")
    extra = F.when(F.col("page_id") % 5 == 0, F.lit(",a,b,c,d,e,f,g,h,i,j")).otherwise(F.lit(""))
    content = F.concat(F.upper(F.element_at(w, 1)), F.lit(" , "), F.element_at(w, 2), F.lit(",, Extra"), extra)
    tag = F.concat(F.lit('<meta name="keywords" content="'), content, F.lit('">'))
    html = F.when(F.col("page_id") % 4 != 0, F.concat(tag, F.col("html"))).otherwise(F.col("html"))
    return j.select("page_id", html.alias("html"))


@query("page_keywords", ("F28",), """
    SELECT page_id, array_to_string(CASE WHEN content = '' THEN [] ELSE
           list_slice(list_filter(list_transform(string_split(content, ','), lambda k: lower(trim(k))),
                                  lambda k: k <> ''), 1, 10) END, ',') AS keywords
    FROM (SELECT p.page_id,
                 CASE WHEN p.page_id % 4 <> 0 THEN
                      upper(split_part(t.p_name, ' ', 1)) || ' , ' || split_part(t.p_name, ' ', 2) || ',, Extra' ||
                      CASE WHEN p.page_id % 5 = 0 THEN ',a,b,c,d,e,f,g,h,i,j' ELSE '' END
                 ELSE '' END AS content
          FROM pages p LEFT JOIN part t ON t.p_partkey = p.page_id % (SELECT count(*) FROM part)) x""")
def page_keywords(spark, d):
    return _tagged_pages(spark, d).select("page_id", F.concat_ws(",", X.page_keywords("html")).alias("keywords"))


del hashlib
