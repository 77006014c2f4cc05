"""Delivery reports (A6, A7): all publishers / advertisers in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .money import sum_usd


def _report(facts: DataFrame, by: str, as_of: str, days: int, money_col: str) -> DataFrame:
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = facts.filter(F.col("ts") > end - F.make_dt_interval(F.lit(days)))
    out = recent.groupBy(by).agg(
        F.count_if(F.col("filled")).alias("impressions"),
        F.count_if(F.col("clicked")).alias("clicks"),
        F.count_if(F.col("converted")).alias("conversions"),
        F.round(sum_usd("cost_usd"), 6).alias(money_col))
    return out.withColumn("ctr", X.safe_ctr("clicks", "impressions"))


# A6 -- publisher report over the last ``days`` days.
def publisher_stats(facts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return _report(facts, "publisher_id", as_of, days, "revenue_usd")


# A7 -- advertiser report (spend instead of revenue).
def advertiser_stats(facts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return _report(facts, "advertiser_id", as_of, days, "spend_usd")
