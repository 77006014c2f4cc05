"""Metrics from one histogram, pooled isotonic fits, and boosting that continues."""

import math
import random

import pytest
from pyspark.sql import functions as F

from adflow.operators import metrics as M
from adflow.plans import training as T


def _rows(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0.1, 0.1, 0.2, 0.5, round(rng.random(), 2)]), round(rng.random(), 1), int(rng.random() < 0.2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "impression_id long, a double, b double, label int").repartition(5)


def brute_auc(scored):
    pos = [s for s, y in scored if y == 1]
    neg = [s for s, y in scored if y == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def test_variants_share_one_histogram(spark):
    rows, df = _rows(spark)
    got = M.metrics_rows(df, {"x": "a", "y": "b"})
    for name, k in (("x", 1), ("y", 2)):
        scored = [(min(max(r[k], 1e-7), 1 - 1e-7), r[3]) for r in rows]
        m = got[name]
        assert m["n_rows"] == len(rows) and m["n_positives"] == sum(y for _, y in scored)
        assert m["auc"] == pytest.approx(brute_auc(scored), abs=1e-12)
        assert m["log_loss"] == pytest.approx(-sum(math.log(s) if y else math.log(1 - s) for s, y in scored) / len(scored), abs=1e-9)
        assert m["calibration_ratio"] == pytest.approx(sum(s for s, _ in scored) / sum(y for _, y in scored), abs=1e-9)
    alone = M.evaluate(df, "a").first().asDict()
    assert {c: alone[c] for c in M.METRIC_COLUMNS} == got["x"]


def test_metrics_shuffle_distinct_scores_once(spark):
    _, df = _rows(spark)
    plan = M.score_histogram(df, {"x": "a", "y": "b"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate") == 2


def test_groups_and_empty_input(spark):
    rows, df = _rows(spark, 400)
    by = {r.g: r for r in M.evaluate(df.withColumn("g", F.col("impression_id") % 3), "a", by=["g"]).collect()}
    for g, r in by.items():
        scored = [(x[1], x[3]) for x in rows if x[0] % 3 == g]
        assert r.auc == pytest.approx(brute_auc(scored)) and r.n_rows == len(scored)
    none = M.evaluate(df.limit(0), "a").first()
    assert none.n_rows == 0 and math.isnan(none.auc)


@pytest.mark.parametrize("n", [3, 10, 17, 3000])
def test_deciles_with_ties_across_borders(spark, n):
    rows, df = _rows(spark, n)
    ordered = sorted((r[1], r[0], r[3]) for r in rows)
    q, rem = divmod(n, 10)
    want, at = {}, 0
    for b in range(min(10, n)):
        size = q + (b < rem)
        part = ordered[at:at + size]
        at += size
        want[b] = (round(sum(p for p, *_ in part) / size, 6), round(sum(y for *_, y in part) / size, 6), size)
    got = {r.bin: (r.predicted, r.actual, r.n) for r in M.decile_table(df, "a").collect()}
    assert got.keys() == want.keys()
    for b, w in want.items():
        assert got[b] == pytest.approx(w, abs=2e-6)


def brute_isotonic(points):
    """Pool adjacent violators over the sorted rows, written as repeated merging."""
    groups = {}
    for p, y in points:
        groups.setdefault(p, []).append(y)
    blocks = [[p, p, len(ys), sum(ys)] for p, ys in sorted(groups.items())]
    merged = True
    while merged:
        merged = False
        for i in range(len(blocks) - 1):
            if blocks[i][3] / blocks[i][2] >= blocks[i + 1][3] / blocks[i + 1][2]:
                blocks[i:i + 2] = [[blocks[i][0], blocks[i + 1][1], blocks[i][2] + blocks[i + 1][2], blocks[i][3] + blocks[i + 1][3]]]
                merged = True
                break
    return [tuple(map(float, b)) for b in blocks]


def test_isotonic_blocks_equal_brute_force(spark):
    rng = random.Random(8)
    points = [(round(rng.random(), 3), 0) for _ in range(3000)]
    points = [(p, int(rng.random() < p * p + 0.1 * math.sin(20 * p))) for p, _ in points]
    df = spark.createDataFrame(points, "corrected double, label int").repartition(6)
    assert sorted(map(tuple, T.isotonic_blocks(df, "corrected").collect())) == brute_isotonic(points)


def test_calibrator_equals_the_fit_on_rows(spark):
    from pyspark.ml.regression import IsotonicRegression

    rng = random.Random(9)
    points = [(i / 500, float(rng.random() < i / 700)) for i in range(500) for _ in range(2)]
    df = spark.createDataFrame(points, "corrected double, label double")
    model, _ = T.fit_calibrator(df)
    whole = IsotonicRegression(featuresCol="corrected", labelCol="label", predictionCol="w").fit(df)
    both = whole.transform(model.transform(df)).select("calibrated", "w").collect()
    assert all(r.calibrated == pytest.approx(r.w, abs=1e-9) for r in both)
    with pytest.raises(ValueError):
        T.fit_calibrator(df.withColumn("label", F.lit(0.0)))


def _clicks(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random() for _ in range(4)]
        rows.append((i, x, int(rng.random() < (0.8 if x[0] > 0.6 else 0.1) * (0.5 + x[1] / 2))))
    return spark.createDataFrame(rows, "impression_id long, features array<float>, label int").repartition(4)


def test_continued_boosting_is_gradient_boosting(spark):
    """Without sampling, tree by tree equals one Spark ML run of as many rounds."""
    from pyspark.ml.classification import GBTClassifier

    train, valid = _clicks(spark, 1500, 1), _clicks(spark, 600, 2)
    cfg = T.TrainConfig(num_rounds=7, patience=10, max_depth=3, step_size=0.3, subsampling_rate=1.0, feature_subset="all", cut_every=2)
    model, best = T.train_ctr(train, valid, cfg)
    whole = GBTClassifier(featuresCol="fv", labelCol="label", maxIter=best + 1, stepSize=0.3, maxDepth=3, subsamplingRate=1.0,
                          minInstancesPerNode=cfg.min_instances_per_node, seed=7).fit(T._vectors(train))
    assert model.getNumTrees == best + 1
    a = {r.impression_id: r.raw for r in T.raw_scores(model, valid).collect()}
    b = {r.impression_id: r.raw for r in T.raw_scores(whole, valid).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_patience_ends_training_at_the_round_of_a_full_run(spark, monkeypatch):
    train, valid = _clicks(spark, 400, 3), _clicks(spark, 300, 4)
    base = dict(max_depth=4, step_size=0.9, min_instances_per_node=2, subsampling_rate=0.8, feature_subset="0.8", cut_every=5)
    fits = []
    tree = T._tree
    monkeypatch.setattr(T, "_tree", lambda cfg, i: fits.append(i) or tree(cfg, i))
    _, stopped = T.train_ctr(train, valid, T.TrainConfig(num_rounds=40, first_rounds=1, patience=4, **base))
    early = len(fits)
    fits.clear()
    _, full = T.train_ctr(train, valid, T.TrainConfig(num_rounds=16, first_rounds=16, patience=4, **base))
    assert early == stopped + 5 < 40 and fits == list(range(16))  # no round is trained twice
    assert stopped == full


def test_boosting_leaves_no_files_behind(spark):
    from adflow.operators import materialize as MT

    before = list(MT._WRITTEN)
    T.train_ctr(_clicks(spark, 300, 5), _clicks(spark, 200, 6), T.TrainConfig(num_rounds=3, max_depth=2, cut_every=1))
    assert MT._WRITTEN == before


def test_a_round_starts_the_jobs_of_its_tree_only(spark):
    """Rows with their margins stay in memory, and validation is not a job of every round."""
    train, valid = _clicks(spark, 300, 7), _clicks(spark, 200, 8)

    def jobs(rounds):
        group = f"boosting-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            T.train_ctr(train, valid, T.TrainConfig(num_rounds=rounds, first_rounds=30, patience=20, max_depth=2, cut_every=100))
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(14) - jobs(4) <= 10 * 5  # row width, row count, splits and two levels


def test_losses_judged_late_choose_the_round_of_a_full_run(spark):
    train, valid = _clicks(spark, 400, 9), _clicks(spark, 300, 10)
    base = dict(max_depth=3, step_size=0.9, min_instances_per_node=2, subsampling_rate=1.0, feature_subset="all", cut_every=3)
    for patience in (1, 3, 6):
        model, best = T.train_ctr(train, valid, T.TrainConfig(num_rounds=14, first_rounds=2, patience=patience, **base))
        whole, _ = T.train_ctr(train, valid, T.TrainConfig(num_rounds=14, first_rounds=14, patience=99, **base))
        assert best <= 13 and model.getNumTrees == best + 1
        judged = T._vectors(valid).select(F.col("fv").alias("features"), F.col("label").cast("double").alias("label"))
        assert best == T.best_round(list(whole.evaluateEachIteration(judged)), patience) or best >= whole.getNumTrees - 1
    assert not [x for x in spark.sparkContext._jsc.getPersistentRDDs().values() if x.getStorageLevel().useMemory()]
