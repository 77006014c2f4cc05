"""Click and conversion attribution.

All joins here are equi-joins on ``impression_id``. Pre-aggregating clicks to
one row per impression *before* the join (A8) keeps the join 1:1 on the
impression side, so the click side can never multiply the fact table, and the
aggregate's hash partitioning on ``impression_id`` is reused by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

POLICY_FIRST_CLICK = "first_click"
POLICY_FIRST_IN_WINDOW = "first_in_window"


# A8 -- earliest click per impression (partial + final hash aggregate).
def first_clicks(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("impression_id").agg(
        F.min("ts").alias("click_ts"),
        F.count(F.lit(1)).alias("n_clicks"),
    )


# J4 -- label impressions with a click inside [ts, ts + window].
def attribute_clicks(impressions: DataFrame, clicks: DataFrame,
                     window_hours: int = K.ATTRIBUTION_WINDOW_HOURS,
                     policy: str = POLICY_FIRST_CLICK) -> DataFrame:
    """Left join impressions to their (first) click and derive ``label``.

    ``first_click`` (reference semantics): the earliest click is picked
    before the window test, so an early click outside the window masks a
    later valid one. ``first_in_window``: the earliest click inside it.
    """
    win = F.make_dt_interval(F.lit(0), F.lit(window_hours))
    if policy == POLICY_FIRST_CLICK:
        first = first_clicks(clicks.select("impression_id", "ts")).select("impression_id", "click_ts")
    elif policy == POLICY_FIRST_IN_WINDOW:
        imp_ts = impressions.select("impression_id", F.col("ts").alias("_imp_ts"))
        c = clicks.select("impression_id", F.col("ts").alias("click_ts"))
        first = (c.join(imp_ts, "impression_id")
                 .filter((F.col("click_ts") >= F.col("_imp_ts"))
                         & (F.col("click_ts") <= F.col("_imp_ts") + win))
                 .groupBy("impression_id").agg(F.min("click_ts").alias("click_ts")))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    joined = impressions.join(first, "impression_id", "left")
    in_window = (F.col("click_ts") >= F.col("ts")) & (F.col("click_ts") <= F.col("ts") + win)
    return joined.withColumn("label", F.coalesce(in_window.cast("int"), F.lit(0)))


def labelled_ctr(labelled: DataFrame, by=("ad_id", "placement_id")) -> DataFrame:
    return labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.sum("label").cast("bigint").alias("clicks"),
    ).withColumn("ctr", F.round(F.col("clicks") / F.col("impressions"), 6))


# J6 -- clicks take ad and placement from their impression (unknown ids drop).
def enrich_clicks(raw_clicks: DataFrame, impressions: DataFrame, destination: str | None = None) -> DataFrame:
    """With ``destination`` (a column of the clicks), clicks that do not lead to an
    http(s) address are refused."""
    if destination:
        raw_clicks = raw_clicks.filter(F.coalesce(F.lower(destination).rlike("^https?://"), F.lit(False)))
    imp = impressions.select("impression_id", "ad_id", "placement_id", "publisher_id")
    return raw_clicks.join(imp, "impression_id", "inner")


# J7 -- events whose impression is unknown.
def orphan_events(events: DataFrame, impressions: DataFrame) -> DataFrame:
    return events.join(impressions.select("impression_id"), "impression_id", "left_anti")


# J8 -- conversions attributed to an impression, with the publisher ownership check.
def attribute_conversions(conversions: DataFrame, impressions: DataFrame,
                          publisher_col: str = "publisher_id") -> tuple[DataFrame, DataFrame]:
    """Returns (accepted, rejected). ``conversions`` carries the claiming publisher."""
    imp = impressions.select(
        "impression_id", "ad_id", "advertiser_id",
        F.col("publisher_id").alias("_imp_publisher"),
        F.col("user_id").alias("_imp_user"))
    j = conversions.join(imp, "impression_id", "inner")
    same = F.col(publisher_col) == F.col("_imp_publisher")
    accepted = (j.filter(same)
                .withColumn("user_id", F.col("_imp_user"))
                .drop("_imp_publisher", "_imp_user"))
    rejected = (j.filter(~same).withColumn("reason", F.lit("cross_publisher"))
                .drop("_imp_user"))
    return accepted, rejected


# J9 -- reporting flags: clicked / clicked_at (first click) / converted.
def impression_facts(impressions: DataFrame, clicks: DataFrame, conversions: DataFrame) -> DataFrame:
    first = clicks.groupBy("impression_id").agg(F.min("ts").alias("clicked_at"))
    converted = conversions.select("impression_id").distinct().withColumn("_conv", F.lit(True))
    return (impressions
            .join(first, "impression_id", "left")
            .join(converted, "impression_id", "left")
            .withColumn("clicked", F.col("clicked_at").isNotNull())
            .withColumn("converted", F.coalesce(F.col("_conv"), F.lit(False)))
            .withColumn("filled", F.lit(True))
            .withColumn("cost_usd", F.col("win_price") / 1000.0)
            .drop("_conv"))


# S12 -- idempotent insert: first row per impression id wins (deterministic).
def dedup_impressions(df: DataFrame, key: str = "impression_id",
                      order_cols=("ts",)) -> DataFrame:
    ties = [F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])]
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order_cols], *ties)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def merge_new_impressions(log: DataFrame, new: DataFrame, key: str = "impression_id") -> DataFrame:
    """Rows of ``new`` not yet in ``log`` (ON CONFLICT DO NOTHING)."""
    return dedup_impressions(new, key).join(log.select(key), key, "left_anti")
