"""Evaluation metrics on scored rows.

Scores collapse to a histogram (variant, score) -> rows by label before anything is
ordered. Sums over it give the losses and ratios, prefix sums over the distinct scores
the AUC with ties and the borders of equal-count bins. Several score columns share one
histogram. Only metric rows ever reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from .materialize import checkpoint
from .ranking import equal_count_bin, global_rank, running_before

METRIC_COLUMNS = ("log_loss", "auc", "calibration_ratio", "mean_predicted", "mean_actual",
                  "n_rows", "n_positives")


def _clipped(p: str):
    return X.clip(F.col(p).cast("double"), K.METRIC_CLIP, 1 - K.METRIC_CLIP)


def score_histogram(df: DataFrame, variants: dict[str, str], y: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, variant, s) -> n, pos, neg: how many rows of either label have a score. Every
    variant is a score column; they are stacked and collapsed in one aggregation, so
    only distinct scores are shuffled."""
    by = by or []
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("variant"), _clipped(c).alias("s")) for name, c in variants.items()]))
    rows = df.select(*by, F.col(y).alias("_y"), each.alias("_v")).select(*by, "_y", "_v.*")
    return rows.groupBy(*by, "variant", "s").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))


def histogram_metrics(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Every metric of each key from its score histogram. AUC counts, for each positive,
    the negatives with a lower score and half of those with the same; the negatives
    before a score are a distributed prefix sum over distinct scores. It is NaN for a
    single-class input (Q15)."""
    ordered = running_before(hist, keys, ["s"], {"neg_before": "neg"})
    s, n, pos, neg = (F.col(c) for c in ("s", "n", "pos", "neg"))
    sums = ordered.groupBy(*keys).agg(
        F.sum(-pos * F.log(s) - neg * F.log(F.lit(1.0) - s)).alias("_loss"), F.sum(n * s).alias("_said"),
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(pos), F.lit(0)).alias("n_positives"),
        F.sum(neg).alias("_neg"), F.sum(pos * (F.col("neg_before") + neg / 2.0)).alias("_won"))
    p, q = F.col("n_positives").cast("double"), F.col("_neg").cast("double")
    return sums.select(
        *keys, (F.col("_loss") / (p + q)).alias("log_loss"), (F.col("_said") / F.greatest(p, F.lit(1e-9))).alias("calibration_ratio"),
        (F.col("_said") / F.col("n_rows")).alias("mean_predicted"), (p / (p + q)).alias("mean_actual"),
        F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_positives").cast("bigint").alias("n_positives"),
        F.when((p > 0) & (q > 0), F.col("_won") / (p * q)).otherwise(F.lit(float("nan"))).alias("auc"))


def evaluate_variants(df: DataFrame, variants: dict[str, str], y: str = "label") -> DataFrame:
    """One row of metrics per score column, all from one histogram."""
    return histogram_metrics(score_histogram(df, variants, y), ["variant"])


def evaluate(df: DataFrame, p: str = "p", y: str = "label", by: list[str] | None = None) -> DataFrame:
    """The metrics of one score column, by group or (without ``by``) in one row."""
    by = by or []
    return histogram_metrics(score_histogram(df, {p: p}, y, by).drop("variant"), by)


def auc(df: DataFrame, p: str = "p", y: str = "label", by: list[str] | None = None) -> DataFrame:
    """AUC with tied scores averaged."""
    return evaluate(df, p, y, by).select(*(by or []), "auc")


def metrics_rows(df: DataFrame, variants: dict[str, str], y: str = "label") -> dict[str, dict]:
    """Driver-side dicts of the metrics of each variant (for gates)."""
    found = {r["variant"]: r.asDict() for r in evaluate_variants(df, variants, y).collect()}
    return {name: {c: found[name][c] for c in METRIC_COLUMNS} for name in variants}


def metrics_row(df: DataFrame, p: str = "p", y: str = "label") -> dict:
    row = evaluate(df, p, y).collect()[0].asDict()
    return {k: row[k] for k in METRIC_COLUMNS}


# A10 -- predicted vs actual by equal-count bins of the prediction.
def decile_table(df: DataFrame, p: str = "p", y: str = "label", id_col: str = "impression_id",
                 n_bins: int = 10) -> DataFrame:
    """Bins follow from prefix sums over distinct scores. Only a score whose rows lie on
    both sides of a border needs the rows themselves, in the order of their ids; there
    are fewer such scores than bins."""
    rows = df.select(F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y"), F.col(id_col).alias("_id"))
    hist = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_pos"))
    hist = checkpoint(running_before(hist, [], ["_p"], {"_before": "_n"}))
    n = hist.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    ranked = hist.withColumn("_low", F.col("_before") + 1).withColumn("_high", F.col("_before") + F.col("_n"))
    ranked = ranked.withColumn("bin", equal_count_bin("_low", n, n_bins)).withColumn("_last", equal_count_bin("_high", n, n_bins))
    whole = ranked.filter(F.col("bin") == F.col("_last")).select("bin", "_n", (F.col("_n") * F.col("_p")).alias("_said"), "_pos")
    torn = ranked.filter(F.col("bin") < F.col("_last")).select("_p", "_n", "_before")
    shift = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # fewer than n_bins rows
    torn = torn.withColumn("_skip", F.col("_before") - F.coalesce(F.sum("_n").over(shift), F.lit(0)))
    tied = global_rank(rows.join(F.broadcast(torn.select("_p", "_skip")), "_p"), ["_p", "_id"], rank_col="_r")
    tied = tied.withColumn("_r", F.col("_r") + F.col("_skip")).select(
        equal_count_bin("_r", n, n_bins).alias("bin"), F.lit(1).alias("_n"), F.col("_p").alias("_said"), F.col("_y").alias("_pos"))
    total = F.sum("_n")
    return whole.unionByName(tied).groupBy("bin").agg(
        F.round(F.sum("_said") / total, 6).alias("predicted"), F.round(F.sum("_pos") / total, 6).alias("actual"),
        total.cast("bigint").alias("n"))


# M6 -- promotion gates on a driver-sized metrics dict (Q15: NaN AUC fails).
def promotion_gates(model: dict, baseline: dict) -> list[str]:
    failures = []
    if not (model["log_loss"] < baseline["log_loss"]):
        failures.append(f"log_loss: {model['log_loss']:.6f} is not under the baseline's {baseline['log_loss']:.6f}")
    ratio = model["calibration_ratio"]
    if not (K.GATE_CALIBRATION_LOW <= ratio <= K.GATE_CALIBRATION_HIGH):
        failures.append(f"calibration_ratio: {ratio:.3f} leaves {K.GATE_CALIBRATION_LOW}..{K.GATE_CALIBRATION_HIGH}")
    a = model["auc"]
    if a is None or math.isnan(a) or not (a > K.GATE_MIN_AUC):
        failures.append(f"AUC: {a} does not exceed {K.GATE_MIN_AUC}")
    return failures


# R5 -- propensity-weighted CTR, weights normalised to mean 1 per group.
def ips_ctr(labelled: DataFrame, by: list[str], p: str = "serve_propensity", y: str = "label") -> DataFrame:
    w = X.ips_weight(p)
    return (labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.avg(F.col(y).cast("double")).alias("raw_ctr"),
        (F.sum(w * F.col(y)) / F.sum(w)).alias("ips_ctr"),
        F.avg(w).alias("mean_weight")))


# R6 -- exploration vs exploitation by model version.
def policy_report(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("model_version", "is_exploration").agg(
        F.count(F.lit(1)).alias("impressions"),
        F.sum("label").cast("bigint").alias("clicks"),
        F.avg("serve_propensity").alias("mean_propensity"))
