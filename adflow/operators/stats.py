"""CTR state and priors.

The pair state is an *additive* table (day, ad, placement, impressions,
clicks): partial aggregates merge by plain sums, which is what lets the same
table be appended by batch and streaming writers and rolled up at read time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from .materialize import checkpoint

LEVEL_PAIR = "pair"
LEVEL_AD = "ad"
LEVEL_PLACEMENT = "placement"
LEVEL_GLOBAL = "global"


# A1 -- daily (ad, placement) counts from impressions and clicks separately.
def ctr_pair_daily(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks are dated by *click* day and not window-attributed (Q6)."""
    imp = impressions.select(X.utc_day("ts").alias("day"), "ad_id", "placement_id",
                             F.lit(1).alias("i"), F.lit(0).alias("c"))
    clk = clicks.select(X.utc_day("ts").alias("day"), "ad_id", "placement_id",
                        F.lit(0).alias("i"), F.lit(1).alias("c"))
    return (imp.unionByName(clk)
            .groupBy("day", "ad_id", "placement_id")
            .agg(F.sum("i").cast("bigint").alias("impressions"),
                 F.sum("c").cast("bigint").alias("clicks")))


# A2 -- merge the state over an inclusive lookback (N + 1 calendar days, Q7).
def ctr_pair(state: DataFrame, as_of: str, lookback_days: int = K.STATS_LOOKBACK_DAYS) -> DataFrame:
    start = F.date_sub(F.lit(as_of).cast("date"), lookback_days)
    return (state.filter(F.col("day") >= start)
            .groupBy("ad_id", "placement_id")
            .agg(F.sum("impressions").cast("bigint").alias("impressions"),
                 F.sum("clicks").cast("bigint").alias("clicks")))


# A3/A4 -- one pass over the pairs: pair, ad, placement and global levels.
def ctr_rollup(pairs: DataFrame) -> DataFrame:
    g = pairs.groupingSets(
        [["ad_id", "placement_id"], ["ad_id"], ["placement_id"], []], "ad_id", "placement_id")
    gid = F.grouping_id()
    rolled = g.agg(F.sum("impressions").cast("bigint").alias("impressions"),
                   F.sum("clicks").cast("bigint").alias("clicks"),
                   gid.alias("_gid"))
    level = (F.when(F.col("_gid") == 0, LEVEL_PAIR).when(F.col("_gid") == 1, LEVEL_AD)
             .when(F.col("_gid") == 2, LEVEL_PLACEMENT).otherwise(LEVEL_GLOBAL))
    return rolled.withColumn("level", level).drop("_gid")


def global_ctr(total_impressions, total_clicks) -> "F.Column":
    imps, clicks = X._c(total_impressions), X._c(total_clicks)
    return (F.when(imps > K.MIN_GLOBAL_IMPRESSIONS, clicks / imps)
            .otherwise(F.lit(K.DEFAULT_GLOBAL_CTR)))


def ctr_stats(pairs: DataFrame, materialize: bool = False) -> dict[str, DataFrame]:
    """Split the rollup into the three lookup tables plus a 1-row global table.

    With ``materialize`` the rollup is checkpointed once (it is small: one
    row per pair, ad and placement) and the four tables are cheap filters.
    """
    r = ctr_rollup(pairs)
    return rollup_tables(checkpoint(r) if materialize else r)


def rollup_tables(r: DataFrame) -> dict[str, DataFrame]:
    """The lookup tables of a roll-up. Joins broadcast one if its written size in bytes allows."""
    glob = (r.filter(F.col("level") == LEVEL_GLOBAL)
            .select(global_ctr(F.coalesce("impressions", F.lit(0)), F.coalesce("clicks", F.lit(0)))
                    .alias("global_ctr")))
    return {
        LEVEL_PAIR: r.filter(F.col("level") == LEVEL_PAIR).select("ad_id", "placement_id", "impressions", "clicks"),
        LEVEL_AD: r.filter(F.col("level") == LEVEL_AD).select("ad_id", "impressions", "clicks"),
        LEVEL_PLACEMENT: r.filter(F.col("level") == LEVEL_PLACEMENT).select("placement_id", "impressions", "clicks"),
        LEVEL_GLOBAL: glob,
    }


def ctr_stats_from_logs(impressions: DataFrame, clicks: DataFrame, as_of: str,
                        lookback_days: int = K.STATS_LOOKBACK_DAYS, materialize: bool = False) -> dict[str, DataFrame]:
    return ctr_stats(ctr_pair(ctr_pair_daily(impressions, clicks), as_of, lookback_days), materialize)


# J5 -- attach smoothed priors to (ad, placement) rows; unseen keys get global CTR.
def global_prior(stats: dict[str, DataFrame]):
    g = stats[LEVEL_GLOBAL].select(F.first("global_ctr").alias("g")).scalar()
    return F.coalesce(g, F.lit(K.DEFAULT_GLOBAL_CTR))


def attach_ad_prior(df: DataFrame, stats: dict[str, DataFrame], strength: float = K.PRIOR_STRENGTH) -> DataFrame:
    ad = stats[LEVEL_AD].select("ad_id", F.col("impressions").alias("_ai"), F.col("clicks").alias("_ac"))
    return (df.join(ad, "ad_id", "left")
            .withColumn("ad_ctr_prior", X.smoothed_ctr("_ai", "_ac", global_prior(stats), strength))
            .drop("_ai", "_ac"))


def attach_placement_prior(df: DataFrame, stats: dict[str, DataFrame],
                           strength: float = K.PRIOR_STRENGTH) -> DataFrame:
    pl = stats[LEVEL_PLACEMENT].select("placement_id", F.col("impressions").alias("_li"),
                                       F.col("clicks").alias("_lc"))
    return (df.join(pl, "placement_id", "left")
            .withColumn("placement_ctr_prior", X.smoothed_ctr("_li", "_lc", global_prior(stats), strength))
            .drop("_li", "_lc"))


def attach_pair_prior(df: DataFrame, stats: dict[str, DataFrame], strength: float = K.PRIOR_STRENGTH) -> DataFrame:
    pr = stats[LEVEL_PAIR].select("ad_id", "placement_id", F.col("impressions").alias("_pi"),
                                  F.col("clicks").alias("_pc"))
    return (df.join(pr, ["ad_id", "placement_id"], "left")
            .withColumn("pair_ctr_prior", X.smoothed_ctr("_pi", "_pc", global_prior(stats), strength))
            .withColumn("pair_impressions", F.coalesce(F.col("_pi"), F.lit(0)).cast("bigint"))
            .drop("_pi", "_pc"))


def with_priors(candidates: DataFrame, stats: dict[str, DataFrame],
                strength: float = K.PRIOR_STRENGTH) -> DataFrame:
    """Left joins against the three lookup tables of a stats snapshot.

    The lookup tables are bounded by inventory x placements, not traffic;
    once the snapshot is materialised Spark knows
    their size and its size-checked auto-broadcast picks a broadcast hash
    join, falling back to a shuffle join beyond the threshold.
    The 1-row global table enters as a scalar subquery.
    """
    out = attach_ad_prior(candidates, stats, strength)
    out = attach_placement_prior(out, stats, strength)
    out = attach_pair_prior(out, stats, strength)
    return out.withColumn("global_ctr", global_prior(stats))


# W5 -- running per-key counters strictly before each row (point-in-time prior).
def _pit_ctr(prior_clicks: float, prior_imps: float):
    return (F.col("clicks_before") + prior_clicks) / (F.col("seen_before") + prior_imps)


def point_in_time_ctr(labelled: DataFrame, key: str = "ad_id", order=("ts", "impression_id"),
                      prior_clicks: float = 1.0, prior_imps: float = 100.0) -> DataFrame:
    """(clicks_before + 1) / (seen_before + 100) per row, ordered by (ts, id). A hot
    key is split over as many tasks as its rows fill."""
    from .ranking import running_before

    rows = labelled.withColumn("_one", F.lit(1))
    out = running_before(rows, [key], list(order), {"seen_before": "_one", "clicks_before": "label"}).drop("_one")
    return (out.withColumn("seen_before", F.col("seen_before").cast("bigint"))
            .withColumn("clicks_before", F.col("clicks_before").cast("bigint"))
            .withColumn("pit_ctr", _pit_ctr(prior_clicks, prior_imps)))


def point_in_time_ctr_bucketed(labelled: DataFrame, key: str = "ad_id",
                               prior_clicks: float = 1.0, prior_imps: float = 100.0) -> DataFrame:
    """The same numbers with pieces of one (key, day): needs no range partitioning,
    and suits keys whose single days fit a task."""
    base = labelled.withColumn("_day", F.to_date("ts"))
    daily = base.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_c"))
    wd = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = daily.select(key, "_day",
                         F.coalesce(F.sum("_n").over(wd), F.lit(0)).alias("_n0"),
                         F.coalesce(F.sum("_c").over(wd), F.lit(0)).alias("_c0"))
    w = (Window.partitionBy(key, "_day").orderBy("ts", "impression_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    out = (base.join(carry, [key, "_day"], "left")
           .withColumn("seen_before", (F.col("_n0") + F.coalesce(F.count(F.lit(1)).over(w), F.lit(0))).cast("bigint"))
           .withColumn("clicks_before", (F.col("_c0") + F.coalesce(F.sum("label").over(w), F.lit(0))).cast("bigint")))
    return out.withColumn("pit_ctr", _pit_ctr(prior_clicks, prior_imps)).drop("_day", "_n0", "_c0")
