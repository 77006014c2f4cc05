"""Trees grown on sums over binned rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adflow.operators import boosting as B
from adflow.plans import training as T


def _clicks(spark, n, seed, parts):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random(), rng.random(), float(i % 3), 1.0]
        rows.append((i, x, int(rng.random() < (0.8 if x[0] > 0.6 else 0.1))))
    return spark.createDataFrame(rows, "impression_id long, features array<float>, label int").repartition(parts)


def test_a_level_of_a_tree_is_one_job(spark):
    train, valid = _clicks(spark, 300, 7, 3), _clicks(spark, 200, 8, 3)

    def jobs(rounds):
        group = f"levels-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            T.train_ctr(train, valid, T.TrainConfig(num_rounds=rounds, first_rounds=30, patience=20, max_depth=2, cut_every=100))
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(9) - jobs(4) <= 5 * 2  # nothing but the two levels


def test_written_blocks_are_deleted(spark, monkeypatch):
    from adflow.sources import files

    written = []
    delete = files.delete
    monkeypatch.setattr(T.files, "delete", lambda s, paths: written.extend(paths) or delete(s, paths))
    T.train_ctr(_clicks(spark, 300, 5, 2), _clicks(spark, 200, 6, 2), T.TrainConfig(num_rounds=5, max_depth=2, cut_every=1))
    cuts = [p for p in written if "/rdd-" in p]
    assert len(cuts) == 4 and not [p for p in cuts if files.exists(spark, p)]


def test_losses_are_those_of_the_spark_ml_model(spark):
    rows = _clicks(spark, 500, 9, 3)
    df = T._boost_rows(rows, T.TrainConfig())
    borders = B.find_thresholds(df, 500, 32, 7)
    assert [len(b) for b in borders] == [len(borders[0]), len(borders[1]), 2, 0] and max(map(len, borders)) <= 31
    kept, trees, rates = B.to_blocks(df, borders), [], [1.0, 0.5, 0.5]
    for i, rate in enumerate(rates):
        trees.append(B.TreeFit(3, 32, 0.8, "0.8", 5, i == 0, 7 + i).fit(kept))
        kept = B.add_tree(kept, trees[-1], rate)
    model = T._ensemble(spark, [B.ml_tree(spark, t, borders) for t in trees], rates)
    judged = T._vectors(rows).select(F.col("fv").alias("features"), F.col("label").cast("double").alias("label"))
    assert B.losses(B.to_blocks(df, borders), trees, rates) == pytest.approx(list(model.evaluateEachIteration(judged)), abs=1e-9)
    for tree in trees:
        inner = np.flatnonzero(tree.feature >= 0)
        assert len(inner) and (tree.stats[np.r_[2 * inner, 2 * inner + 1], 0] >= 5).all()


def test_null_and_nan_features_are_errors(spark):
    for bad in (None, float("nan")):
        rows = spark.createDataFrame([([1.0, bad], 1), ([1.0, 2.0], 0)], "features array<float>, label int")
        with pytest.raises(ValueError):
            B.find_thresholds(T._boost_rows(rows, T.TrainConfig()), 2, 32, 7)


def test_the_model_is_loaded_not_built_node_by_node(spark, monkeypatch):
    built, ml_tree = [], B.ml_tree
    monkeypatch.setattr(T.B, "ml_tree", lambda s, tree, borders: built.append(tree) or ml_tree(s, tree, borders))
    rows = _clicks(spark, 500, 9, 3)
    df = T._boost_rows(rows, T.TrainConfig())
    borders = B.find_thresholds(df, 500, 32, 7)
    kept, trees, rates = B.to_blocks(df, borders), [], [1.0, 0.5, 0.5, 0.5]
    for i, rate in enumerate(rates):
        trees.append(B.TreeFit(3, 32, 0.8, "0.8", 5, i == 0, 7 + i).fit(kept))
        kept = B.add_tree(kept, trees[-1], rate)
    model, _ = T.train_ctr(rows, rows, T.TrainConfig(num_rounds=6, max_depth=3, min_instances_per_node=5))
    assert len(built) == 1 and len(model.trees) >= 1
    loaded = T._model(spark, trees, rates, borders)
    whole = T._ensemble(spark, [ml_tree(spark, t, borders) for t in trees], rates)
    assert loaded.toDebugString.split("\n", 1)[1] == whole.toDebugString.split("\n", 1)[1]
    assert loaded.treeWeights == whole.treeWeights and loaded.featureImportances == whole.featureImportances
    assert T.raw_scores(loaded, rows).collect() == T.raw_scores(whole, rows).collect()


def test_level_sums_hold_only_bins_in_use(spark):
    rows = T._boost_rows(_clicks(spark, 500, 9, 1), T.TrainConfig())
    borders = B.find_thresholds(rows, 500, 32, 7)
    blocks, widths = B.to_blocks(rows, borders).collect(), tuple(len(b) + 1 for b in borders)
    few = B.TreeFit(3, 32, 0.8, "all", 5, True, 7, widths, False)
    many = B.TreeFit(3, 32, 0.8, "all", 5, True, 7)
    a, b = few._level_sums(0, blocks, B.Tree(3), 0)[0], many._level_sums(0, blocks, B.Tree(3), 0)[0]
    assert a.shape == (3, 1, sum(widths)) and sum(widths) < 4 * 32
    assert np.array_equal(few._spread(a), many._spread(b))
