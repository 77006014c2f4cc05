"""Campaign spend, budgets and the spend ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K
from ..functions import expr as X
from .money import sum_cpm_as_usd, to_micros


def has_campaign(df: DataFrame, col: str = "campaign_id"):
    """Legacy rows carry an empty campaign id and are never charged (Q22)."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, StringType):
        return c.isNotNull() & (c != "")
    return c.isNotNull()


# A5 -- spend per campaign and UTC day: sum(win_price) / 1000.
def campaign_spend(impressions: DataFrame, day: str | None = None) -> DataFrame:
    df = impressions.filter(has_campaign(impressions))
    df = df.withColumn("day", X.utc_day("ts"))
    if day is not None:
        df = df.filter(F.col("day") == F.lit(day).cast("date"))
    return (df.groupBy("campaign_id", "day")
            .agg(sum_cpm_as_usd("win_price").alias("spent_usd"),
                 F.count(F.lit(1)).alias("impressions")))


# J3 -- drop candidates whose campaign already spent its daily budget.
def filter_by_budget(candidates: DataFrame, ledger: DataFrame, day_col: str = "day") -> DataFrame:
    """Strict ``spend < budget``; unknown spend counts as 0 (fail-open);
    candidates without a campaign are excluded (Q23).

    The ledger has one row per (campaign, day) -- bounded by the number of
    campaigns times the retained days (48 h), not by traffic -- so Spark's
    size-checked auto-broadcast keeps this a map-side hash join.
    """
    led = ledger.select("campaign_id", F.col("day").alias(day_col), F.col("spent_usd").alias("_spent"))
    return (candidates.filter(has_campaign(candidates))
            .join(led, ["campaign_id", day_col], "left")
            .withColumn("spent_today_usd", F.coalesce(F.col("_spent"), F.lit(0.0)))
            .filter(F.col("spent_today_usd") < F.col("daily_budget_usd"))
            .drop("_spent"))


# J13 -- drift between recomputed spend and the ledger.
def spend_drift(actual: DataFrame, ledger: DataFrame, tol: float = K.SPEND_DRIFT_TOLERANCE,
                only_recomputed: bool = False) -> DataFrame:
    a = actual.select("campaign_id", "day", F.col("spent_usd").alias("actual_usd"))
    b = ledger.select("campaign_id", "day", F.col("spent_usd").alias("ledger_usd"))
    how = "left" if only_recomputed else "full_outer"
    j = a.join(b, ["campaign_id", "day"], how)
    drift = F.coalesce(F.col("actual_usd"), F.lit(0.0)) - F.coalesce(F.col("ledger_usd"), F.lit(0.0))
    return (j.withColumn("drift_usd", drift)
            .filter(F.abs(F.col("drift_usd")) > tol))


# R3 -- recompute one day's spend and overwrite those ledger keys.
def reconcile(impressions: DataFrame, ledger: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Returns (new_ledger, drift). Keys without impressions that day keep
    their old value, as in the reference (it only writes recomputed keys)."""
    fresh = campaign_spend(impressions, day).select("campaign_id", "day", "spent_usd")
    kept = ledger.join(fresh.select("campaign_id", "day"), ["campaign_id", "day"], "left_anti")
    drift = spend_drift(fresh, ledger, only_recomputed=True)
    return kept.unionByName(fresh), drift


# J12 -- ad-keyed spend moved to campaign keys; merged as max with existing.
def rekey_spend(ad_spend: DataFrame, ads: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (merged campaign rows, unmapped ad rows)."""
    mapping = ads.select("ad_id", "campaign_id")
    mapped = ad_spend.join(mapping, "ad_id", "inner")
    unmapped = ad_spend.join(mapping, "ad_id", "left_anti")
    totals = (mapped.groupBy("campaign_id", "day")
              .agg((F.sum(to_micros("spent_usd")) / 1e6).alias("ad_key_usd")))
    led = ledger.select("campaign_id", "day", F.col("spent_usd").alias("existing_usd"))
    merged = (totals.join(led, ["campaign_id", "day"], "left")
              .withColumn("spent_usd", F.greatest(F.coalesce(F.col("existing_usd"), F.lit(0.0)),
                                                  F.col("ad_key_usd"))))
    return merged, unmapped


# W6 -- cumulative spend in event order; rows served after the budget ran out.
def overspend(impressions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per (campaign, day): impressions served while spend-so-far >= budget.

    The running sum splits a hot campaign-day over as many tasks as it fills.
    """
    from .ranking import running_before

    df = (impressions.filter(has_campaign(impressions))
          .select("campaign_id", "impression_id", "ts", X.utc_day("ts").alias("day"),
                  F.round(F.col("win_price") * 1000).cast("bigint").alias("_micros")))
    run = running_before(df, ["campaign_id", "day"], ["ts", "impression_id"], {"_before": "_micros"})
    budgets = campaigns.select("campaign_id", F.col("daily_budget_usd").alias("budget_usd"))
    rows = run.withColumn("_before_usd", F.col("_before") / 1e6).join(budgets, "campaign_id", "left")
    after = F.col("budget_usd").isNotNull() & (F.col("_before_usd") >= F.col("budget_usd"))
    return (rows.groupBy("campaign_id", "day")
            .agg(F.count(F.lit(1)).alias("impressions"),
                 F.count_if(after).alias("served_after_exhaustion"),
                 (F.sum("_micros") / 1e6).alias("spent_usd"),
                 F.first("budget_usd").alias("budget_usd"))
            .withColumn("overspend_usd",
                        F.greatest(F.lit(0.0), F.col("spent_usd") - F.coalesce(F.col("budget_usd"), F.lit(0.0)))))
