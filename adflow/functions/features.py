"""Feature assembly for (request, ad) rows: F1-F9 composed.

Input columns expected on the candidate DataFrame:
  request_ts, device_type (normalised), page_keywords (normalised),
  target_keywords, target_cpm, created_at, daily_budget_usd, spent_today_usd,
  ad_ctr_prior, placement_ctr_prior, pair_ctr_prior, pair_impressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import expr as X


def feature_columns() -> dict:
    ad_set = X.ad_keyword_set("target_keywords")
    overlap = X.keyword_overlap(ad_set, "page_keywords")
    dow = X.day_of_week("request_ts")
    return {
        "hour_of_day": X.hour_of_day("request_ts"),
        "day_of_week": dow,
        "is_weekend": X.is_weekend(dow),
        "is_mobile": X.one_hot("device_type", "mobile"),
        "is_desktop": X.one_hot("device_type", "desktop"),
        "is_tablet": X.one_hot("device_type", "tablet"),
        "keyword_overlap": overlap.cast("double"),
        "keyword_overlap_ratio": X.keyword_overlap_ratio(overlap, ad_set),
        "n_ad_keywords": F.size(ad_set).cast("double"),
        "n_page_keywords": F.size(F.coalesce(F.col("page_keywords"), F.array().cast("array<string>"))).cast("double"),
        "target_cpm": F.col("target_cpm").cast("double"),
        "ad_ctr_prior": F.col("ad_ctr_prior"),
        "placement_ctr_prior": F.col("placement_ctr_prior"),
        "pair_ctr_prior": F.col("pair_ctr_prior"),
        "pair_impressions_log": X.log_impressions("pair_impressions"),
        "ad_age_days": X.ad_age_days("request_ts", "created_at"),
        "budget_pacing": X.budget_pacing("spent_today_usd", "daily_budget_usd"),
    }


def with_features(cands: DataFrame, keep_columns: bool = False) -> DataFrame:
    """Adds ``keyword_overlap`` (int, for the baseline scorer), ``features``
    (ARRAY<FLOAT>, the logged vector) and ``feature_version``; with
    ``keep_columns`` also every feature as a named DOUBLE column."""
    cols = feature_columns()
    df = cands
    if "spent_today_usd" not in df.columns:
        df = df.withColumn("spent_today_usd", F.lit(0.0))
    # Materialise the named features once, then reference them, so the
    # keyword set intersection is evaluated a single time per row.
    tmp = {n: f"_f_{i}" for i, n in enumerate(K.FEATURE_NAMES)}
    df = df.select("*", *[cols[n].alias(tmp[n]) for n in K.FEATURE_NAMES])
    df = (df.withColumn("keyword_overlap", F.col(tmp["keyword_overlap"]).cast("int"))
            .withColumn("features", X.assemble_features({n: F.col(tmp[n]) for n in K.FEATURE_NAMES}))
            .withColumn("feature_version", F.lit(K.FEATURE_VERSION).cast("smallint")))
    if keep_columns:
        for n in K.FEATURE_NAMES:
            if n != "keyword_overlap":
                df = df.withColumn(n, F.col(tmp[n]))
        df = df.withColumn("keyword_overlap_f", F.col(tmp["keyword_overlap"]))
    return df.drop(*tmp.values())
