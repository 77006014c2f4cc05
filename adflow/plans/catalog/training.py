"""Training-side queries: M1, W3, W4, M2, A9, A10, F10, F12, F17, R5, R6, M3-M9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import expr as X
from ...operators import metrics as M
from ...operators import ranking as R
from .. import training as T
from ..registry import query
from .auction import logged_features
from .common import TRAIN_AS_OF, fx, register, round6, with_views

TRAIN_START = "2024-01-01 00:00:00"   # as_of - 30 days
TRAIN_CUTOFF = "2024-01-30 22:00:00"  # as_of - 2 hours


def logged_impressions(spark, d):
    """The impression log with the feature vector that was scored at serve time."""
    return logged_features(spark, d).select(
        "impression_id", "ts", "features", "feature_version", "serve_propensity", "model_version", "is_exploration")


def labelled(spark, d):
    return T.training_set(logged_impressions(spark, d), fx.clicks(spark, d), TRAIN_AS_OF)


def _split(spark, d):
    return R.time_split(labelled(spark, d))


register("train_rows_v", ("labels_v", "feature_rows_v"), f"""
    SELECT l.impression_id, l.ts, l.label, l.model_version, l.is_exploration, l.serve_propensity,
           least(greatest(CAST(CAST(f.pair_ctr_prior AS FLOAT) AS DOUBLE), 1e-6), 0.5) AS baseline
    FROM labels_v l JOIN feature_rows_v f ON f.request_id = l.impression_id
    WHERE l.ts >= TIMESTAMP '{TRAIN_START}' AND l.ts < TIMESTAMP '{TRAIN_CUTOFF}'""")
register("split_v", ("train_rows_v",), """
    SELECT *, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_valid THEN 'valid' ELSE 'calib' END
                  AS split,
              CASE WHEN rk > n_train + n_valid + n_calib // 2 THEN 'test'
                   WHEN rk > n_train + n_valid THEN 'fit' END AS calib_half
    FROM (SELECT *, n - n_valid - n_calib AS n_train FROM (
            SELECT *, row_number() OVER (ORDER BY ts, impression_id) AS rk,
                   CAST(floor(count(*) OVER () * CAST(0.15 AS DOUBLE)) AS BIGINT) AS n_valid,
                   CAST(floor(count(*) OVER () * CAST(0.15 AS DOUBLE)) AS BIGINT) AS n_calib,
                   count(*) OVER () AS n
            FROM train_rows_v) a) b""")
register("cal_test_v", ("split_v",), "SELECT * FROM split_v WHERE calib_half = 'test'")


@query("gate_baseline", ("M1", "P4", "F12", "W7"), with_views(("train_rows_v",), """
    SELECT impression_id, label, round(baseline, 6) AS baseline FROM train_rows_v"""))
def gate_baseline(spark, d):
    return labelled(spark, d).select("impression_id", "label", round6(X.gate_baseline("features")).alias("baseline"))


@query("time_split_sizes", ("W3", "W4"), with_views(("split_v",), """
    SELECT split, coalesce(calib_half, '-') AS calib_half, count(*) AS n_rows,
           CAST(sum(label) AS BIGINT) AS n_positives, min(rk) AS first_rank, max(rk) AS last_rank
    FROM split_v GROUP BY 1, 2"""))
def time_split_sizes(spark, d):
    s = _split(spark, d)
    return s.groupBy("split", F.coalesce("calib_half", F.lit("-")).alias("calib_half")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("n_positives"),
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


@query("downsample_counts", ("M2", "A11"), with_views(("split_v",), """
    SELECT split, n_pos, n_neg, wanted,
           round(CASE WHEN n_neg = 0 THEN 1.0 WHEN CAST(wanted AS DOUBLE) / n_neg >= 1.0 THEN 1.0
                      ELSE CAST(wanted AS DOUBLE) / n_neg END, 6) AS keep_rate,
           n_pos + wanted AS kept_rows
    FROM (SELECT split, n_pos, n_neg, least(n_neg, CAST(floor(n_pos * CAST(20.0 AS DOUBLE)) AS BIGINT)) AS wanted
          FROM (SELECT split, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
                FROM split_v WHERE split IN ('train', 'valid') GROUP BY split) a) b"""))
def downsample_counts(spark, d):
    s = _split(spark, d)
    rows = []
    for name, seed in ((R.SPLIT_TRAIN, 7), (R.SPLIT_VALID, 8)):
        part = s.filter(F.col("split") == name)
        c = part.groupBy().agg(F.count_if(F.col("label") == 1).alias("p"),
                               F.count_if(F.col("label") == 0).alias("q")).collect()[0]
        n_pos, n_neg = int(c["p"]), int(c["q"])
        wanted, keep = R.downsample_plan(n_pos, n_neg)
        if n_pos > 0:
            sample, keep = R.downsample_negatives(part, seed=seed)
        else:  # the reference stops here; the report still states the counts
            sample = part.filter(F.lit(False))
        rows.append(sample.groupBy().agg(F.count(F.lit(1)).alias("kept_rows")).select(
            F.lit(name).alias("split"), F.lit(n_pos).cast("bigint").alias("n_pos"),
            F.lit(n_neg).cast("bigint").alias("n_neg"), F.lit(wanted).cast("bigint").alias("wanted"),
            F.round(F.lit(float(min(keep, 1.0))), 6).alias("keep_rate"),
            (F.col("kept_rows") + (F.lit(n_pos + wanted) if n_pos == 0 else F.lit(0))).alias("kept_rows")))
    return rows[0].unionByName(rows[1])


register("t", ("cal_test_v",), "SELECT least(greatest(baseline, 1e-7), 1 - 1e-7) AS p, label FROM cal_test_v")
register("auc_v", ("t",), """
    SELECT CASE WHEN max(n_pos) > 0 AND max(n) > max(n_pos) THEN
                (sum(CASE WHEN label = 1 THEN rk + (c - 1) / 2.0 END) - max(n_pos) * (max(n_pos) + 1) / 2.0)
                / (max(n_pos) * (max(n) - max(n_pos))) END AS auc
    FROM (SELECT label, p, rank() OVER (ORDER BY p) AS rk, count(*) OVER (PARTITION BY p) AS c,
                 sum(label) OVER () AS n_pos, count(*) OVER () AS n FROM t) r""")


@query("eval_metrics", ("A9", "F12"), with_views(("t", "auc_v"), """
    SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss,
           round(max(a.auc), 6) AS auc,
           round(sum(p) / greatest(CAST(sum(label) AS DOUBLE), 1e-9), 6) AS calibration_ratio,
           round(avg(p), 6) AS mean_predicted, round(avg(label), 6) AS mean_actual,
           count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positives
    FROM t CROSS JOIN auc_v a"""))
def eval_metrics(spark, d):
    test = _split(spark, d).filter(F.col("calib_half") == "test") \
        .withColumn("baseline", X.gate_baseline("features"))
    m = M.evaluate(test, "baseline")
    return m.select(*[round6(c).alias(c) if c not in ("n_rows", "n_positives") else F.col(c)
                      for c in M.METRIC_COLUMNS])


@query("calibration_deciles", ("A10",), with_views(("cal_test_v",), """
    SELECT bin, round(avg(baseline), 6) AS predicted, round(avg(label), 6) AS actual, count(*) AS n
    FROM (SELECT baseline, label, ntile(10) OVER (ORDER BY baseline, impression_id) - 1 AS bin FROM cal_test_v) x
    GROUP BY bin"""))
def calibration_deciles(spark, d):
    test = _split(spark, d).filter(F.col("calib_half") == "test") \
        .withColumn("baseline", X.gate_baseline("features"))
    return M.decile_table(test, "baseline")


@query("ips_ctr", ("R5", "F17"), with_views(("train_rows_v",), """
    SELECT model_version, count(*) AS impressions, round(avg(label), 6) AS raw_ctr,
           round(sum(w * label) / sum(w), 6) AS ips_ctr, round(avg(w), 6) AS mean_weight
    FROM (SELECT *, 1.0 / least(greatest(serve_propensity, 0.01), 1.0) AS w FROM train_rows_v) x
    GROUP BY model_version"""))
def ips_ctr(spark, d):
    out = M.ips_ctr(labelled(spark, d), ["model_version"])
    return out.select("model_version", "impressions", round6("raw_ctr").alias("raw_ctr"),
                      round6("ips_ctr").alias("ips_ctr"), round6("mean_weight").alias("mean_weight"))


@query("policy_report", ("R6",), with_views(("train_rows_v",), """
    SELECT model_version, is_exploration, count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicks,
           round(avg(serve_propensity), 6) AS mean_propensity
    FROM train_rows_v GROUP BY 1, 2"""))
def policy_report(spark, d):
    return M.policy_report(labelled(spark, d)).withColumn("mean_propensity", round6("mean_propensity"))


@query("downsampling_correction", ("F10", "F30"), with_views(("cal_test_v",), """
    SELECT impression_id,
           round(least(greatest(CASE WHEN 0.25 >= 1.0 THEN baseline ELSE
                 (0.25 * least(greatest(baseline, 1e-9), 1 - 1e-9))
                 / (0.25 * least(greatest(baseline, 1e-9), 1 - 1e-9) + 1.0 - least(greatest(baseline, 1e-9), 1 - 1e-9))
                 END, 0.0001), 0.25), 6) AS corrected
    FROM cal_test_v"""))
def downsampling_correction(spark, d):
    test = _split(spark, d).filter(F.col("calib_half") == "test") \
        .withColumn("baseline", X.gate_baseline("features"))
    return test.select("impression_id",
                       round6(X.clip_prediction(X.undo_downsampling("baseline", 0.25))).alias("corrected"))


def _train(spark, d):
    return T.run_training(labelled(spark, d), T.TrainConfig())


@query("model_report", ("M3", "M4", "M5", "M6", "M8", "M9", "A12"))
def model_report(spark, d):
    res = _train(spark, d)
    rows = []
    for variant, m in res.metadata["metrics"].items():
        rows.append((variant, *[float(m[c]) for c in M.METRIC_COLUMNS[:5]], int(m["n_rows"]),
                     int(m["n_positives"]), int(res.best_iteration), ";".join(res.gate_failures),
                     res.metadata["feature_importance"]))
    schema = ("variant string, log_loss double, auc double, calibration_ratio double, mean_predicted double, "
              "mean_actual double, n_rows long, n_positives long, best_iteration int, gate_failures string, feature_importance map<string, double>")
    return spark.createDataFrame(rows, schema)


@query("scored_rows", ("M7", "M3", "F10", "F30"))
def scored_rows(spark, d):
    res = _train(spark, d)
    return res.scored_test.select("impression_id", "label", "raw", "corrected", "p_final")
