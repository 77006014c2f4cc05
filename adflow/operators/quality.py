"""Data-quality rule tables.

A rule is (name, Column that is TRUE when the row violates it). ``apply_rules``
splits a DataFrame into (ok, rejected) with a ``reasons`` string listing every
violated rule in declaration order -- one pass, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

Rule = tuple[str, Column]


def _bad(cond: Column) -> Column:
    # A rule whose inputs are NULL counts as violated only if the rule says so.
    return F.coalesce(cond, F.lit(False))


def apply_rules(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    reasons = F.array_compact(F.array(*[F.when(_bad(c), F.lit(n)) for n, c in rules]))
    tagged = df.withColumn("reasons", F.concat_ws(",", reasons))
    return (tagged.filter(F.col("reasons") == "").drop("reasons"),
            tagged.filter(F.col("reasons") != ""))


def _len_between(col: str, lo: int, hi: int) -> Column:
    n = F.length(F.col(col))
    return F.col(col).isNull() | (n < lo) | (n > hi)


# P5 + P10 -- bid requests.
def request_rules(authenticated_publisher_col: str | None = None) -> list[Rule]:
    rules: list[Rule] = [
        ("publisher_id", _len_between("publisher_id", 1, K.REQUEST_ID_MAX)),
        ("placement_id", _len_between("placement_id", 1, K.REQUEST_ID_MAX)),
        ("page_url", F.col("page_url").isNull() | (F.length("page_url") > K.URL_MAX)),
        ("page_referrer", F.length(F.col("page_referrer")) > K.URL_MAX),
        ("user_id", _len_between("user_id", 1, K.USER_ID_MAX)),
        ("device_type", ~F.coalesce(F.col("device_type").isin(*K.DEVICES), F.lit(False))),
        ("viewport_width", (F.col("viewport_width") < 0) | (F.col("viewport_width") > K.VIEWPORT_MAX)),
        ("timestamp_ms", F.col("timestamp_ms").isNull()
         | (F.abs(F.unix_millis(F.col("server_ts").cast("timestamp")) - F.col("timestamp_ms"))
            > K.CLIENT_CLOCK_SKEW_MS)),
    ]
    if authenticated_publisher_col:
        rules.append(("publisher_mismatch",
                      F.col("publisher_id") != F.col(authenticated_publisher_col)))
    return rules


def validate_requests(df: DataFrame, authenticated_publisher_col: str | None = None):
    if "page_referrer" not in df.columns:
        df = df.withColumn("page_referrer", F.lit(None).cast("string"))
    return apply_rules(df, request_rules(authenticated_publisher_col))


# P6 -- campaigns.
def campaign_rules() -> list[Rule]:
    cpm, floor, budget = F.col("target_cpm"), F.col("floor_price"), F.col("daily_budget_usd")
    return [
        ("name", _len_between("name", 1, K.CAMPAIGN_NAME_MAX)),
        ("daily_budget_usd", budget.isNull() | (budget <= 0) | (budget > K.BUDGET_MAX)),
        ("target_cpm", cpm.isNull() | (cpm <= 0) | (cpm > K.CPM_MAX)),
        ("floor_price", (floor < 0) | (floor > K.CPM_MAX)),
        ("floor_above_cpm", floor > cpm),
        ("target_device", ~F.coalesce(F.col("target_device").rlike(K.DEVICE_TARGET_PATTERN), F.lit(False))),
        ("target_keywords", F.size(F.col("target_keywords")) > K.MAX_KEYWORDS),
        ("dates", F.col("end_date") < F.col("start_date")),
    ]


def validate_campaigns(df: DataFrame):
    return apply_rules(df, campaign_rules())


# P7 -- ads.
def ad_rules() -> list[Rule]:
    html, dest = F.col("creative_html"), F.col("destination_url")
    return [
        ("creative_length", _len_between("creative_html", 1, K.CREATIVE_MAX)),
        ("click_macro", ~F.coalesce(html.contains(K.CLICK_MACRO), F.lit(False))),
        ("destination_scheme", ~F.coalesce(dest.startswith("http://") | dest.startswith("https://"),
                                           F.lit(False))),
    ]


def validate_ads(df: DataFrame):
    return apply_rules(df, ad_rules())


# P8 -- publishers / advertisers: id pattern, origin with scheme, trailing '/'.
def publisher_rules() -> list[Rule]:
    pid, dom = F.col("publisher_id"), F.col("domain")
    return [
        ("publisher_id", _len_between("publisher_id", 3, K.REQUEST_ID_MAX)
         | ~F.coalesce(pid.rlike(K.PUBLISHER_ID_PATTERN), F.lit(False))),
        ("domain_scheme", ~F.coalesce(dom.startswith("http://") | dom.startswith("https://"), F.lit(False))),
    ]


def validate_publishers(df: DataFrame):
    ok, bad = apply_rules(df, publisher_rules())
    return ok.withColumn("domain", F.rtrim(F.col("domain"), F.lit("/"))), bad


# P9 -- conversions.
def conversion_rules() -> list[Rule]:
    return [
        ("impression_id", F.col("impression_id").isNull()),
        ("conversion_type", F.length(F.col("conversion_type")) > K.CONVERSION_TYPE_MAX),
        ("conversion_value", F.col("conversion_value") < 0),
    ]


def validate_conversions(df: DataFrame):
    return apply_rules(df, conversion_rules())
