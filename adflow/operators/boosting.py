"""Regression trees on binned rows, for boosting.

A block is up to ``BLOCK_ROWS`` rows as numpy arrays: one bin number a feature, the label as
+-1, the weight and the margin. Blocks stay in the memory of the executors as an RDD. A level
of a tree is one job: every task adds up its blocks by (node, feature, bin), the sums are
reduced, and the driver, which sees nothing but sums, picks the splits.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame

BLOCK_ROWS = 65_536
#: Rows that thresholds are placed by, as many as Spark ML takes for them.
THRESHOLD_ROWS = 10_000
#: Partial sums of a level that the driver reduces; above, tasks reduce them first.
DIRECT_SUMS = 32
#: Gains this close are equal but for rounding, and the first feature and border is taken.
TIE = 1e-12


@dataclass
class Block:
    bins: np.ndarray  # rows x features, uint8 or uint16
    sign: np.ndarray
    weight: np.ndarray
    margin: np.ndarray


class Tree:
    """Nodes in heap order from 1; ``feature`` is -1 where a node is a leaf."""

    def __init__(self, depth: int):
        n = 2 << depth
        self.depth = depth
        self.feature, self.split = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.value, self.gain = np.zeros(n), np.zeros(n)
        self.stats = np.zeros((n, 4))  # rows, weight, sum and sum of squares of the target

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row, ``levels`` below the root or at a leaf before."""
        at, rows = np.ones(len(bins), np.int32), np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            feature = self.feature[at]
            right = bins[rows, feature] > self.split[at]
            at = np.where(feature >= 0, 2 * at + right, at)
        return at


def thresholds(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Up to ``max_bins - 1`` borders between the values of a feature, so placed that every bin
    holds about as many rows; all borders where there are no more."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) < max_bins:
        return middles
    upto, stride, out = np.cumsum(counts), len(values) / max_bins, []
    target = stride
    for i in range(len(middles)):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(middles[i])
            target += stride
    return np.array(out)


def find_thresholds(rows: DataFrame, n_rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Borders of every feature, placed on all rows or a sample of ``THRESHOLD_ROWS``."""
    if n_rows > THRESHOLD_ROWS:
        rows = rows.sample(False, THRESHOLD_ROWS / n_rows, seed)
    found = np.array([r[0] for r in rows.select("features").collect()], np.float64)
    if not np.isfinite(found).all():
        raise ValueError("features must be numbers, neither null, NaN nor infinite")
    return [thresholds(column, max_bins) for column in found.T]


def to_blocks(rows: DataFrame, borders: list[np.ndarray]) -> RDD:
    """Rows (features array<double>, sign, weight) as an RDD of blocks with margin 0."""
    width = np.uint8 if max(map(len, borders)) < 256 else np.uint16

    def block(x, sign, weight):
        if not np.isfinite(x).all():
            raise ValueError("features must be numbers, neither null, NaN nor infinite")
        bins = np.empty(x.shape, width)
        for f, border in enumerate(borders):
            bins[:, f] = np.searchsorted(border, x[:, f], side="left")
        return Block(bins, sign, weight, np.zeros(len(x)))

    def pack(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(borders))
            held.append((x, batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(block(*map(np.concatenate, zip(*held, strict=True))))]})
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(block(*map(np.concatenate, zip(*held, strict=True))))]})

    packed = rows.select("features", "sign", "weight").mapInArrow(pack, "block binary")
    return packed.rdd.map(lambda r: pickle.loads(r[0]))


@dataclass
class TreeFit:
    """One regression tree on the gradient of the logistic loss (on the label itself in the
    first round): variance gain, rows drawn by ``subsampling_rate``, features drawn for each node."""

    max_depth: int
    n_bins: int
    subsampling_rate: float
    feature_subset: str
    min_instances: int
    first: bool
    seed: int
    #: Bins in use of each feature; ``n_bins`` of every feature where it is not given.
    widths: tuple[int, ...] | None = None
    #: False where every weight is 1, so that the rows are the weight.
    weighted: bool = True

    def _level_sums(self, index: int, blocks, tree: Tree, level: int):
        """(node, feature, bin) -> rows (where rows have weights), weight, sum and sum of squares
        of the target. Only bins in use are counted and sent."""
        total, size = None, 1 << level
        for number, b in enumerate(blocks):
            drawn = slice(None)
            if self.subsampling_rate < 1.0:
                rng = np.random.default_rng((self.seed, index, number))
                drawn = np.flatnonzero(rng.random(len(b.sign)) < self.subsampling_rate)
            bins, sign, weight = b.bins[drawn], b.sign[drawn], b.weight[drawn]
            target = sign if self.first else sign * 4.0 / (1.0 + np.exp(sign * b.margin[drawn] * 2.0))
            at = tree.nodes(bins, level).astype(np.intp) - size
            live = at >= 0
            if not live.all():
                bins, weight, target, at = bins[live], weight[live], target[live], at[live]
            widths = self.widths or (self.n_bins,) * bins.shape[1]
            parts = (None, weight, weight * target, weight * target * target) if self.weighted else (None, target, target * target)
            if total is None:
                total = np.zeros((len(parts), size, sum(widths)))
            end = 0
            for f, width in enumerate(widths):
                cell, end = at * width + bins[:, f], end + width
                for k, part in enumerate(parts):
                    total[k, :, end - width:end] += np.bincount(cell, part, size * width).reshape(size, width)
        return [] if total is None else [total]

    def _spread(self, sums: np.ndarray) -> np.ndarray:
        """The sums of a level as (rows, weight, ... of the target) x feature x node x bin."""
        widths = self.widths or (self.n_bins,) * (sums.shape[2] // self.n_bins)
        out, end = np.zeros((4, len(widths), sums.shape[1], self.n_bins)), 0
        for f, width in enumerate(widths):
            end += width
            out[4 - len(sums):, f, :, :width] = sums[:, :, end - width:end]
        if not self.weighted:
            out[0] = out[1]
        return out

    def _features(self, n: int, node: int) -> np.ndarray:
        if self.feature_subset == "all":
            return np.arange(n)
        k = max(1, int(np.ceil(float(self.feature_subset) * n)))
        return np.sort(np.random.default_rng((self.seed, node)).choice(n, min(k, n), replace=False))

    def _split(self, tree: Tree, node: int, sums: np.ndarray) -> None:
        """``sums`` (4, features, bins) of a node; the best split, if any has a gain."""
        tree.stats[node] = sums[:, 0].sum(axis=1)
        weight, target = tree.stats[node, 1], tree.stats[node, 2]
        tree.value[node] = target / weight if weight > 0 else 0.0
        features = self._features(sums.shape[1], node)
        left = np.cumsum(sums[:, features], axis=2)[:, :, :-1]
        right = tree.stats[node][:, None, None] - left
        allowed = (left[0] >= self.min_instances) & (right[0] >= self.min_instances) & (left[1] > 0) & (right[1] > 0)
        if not allowed.any():
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            between = left[1] * right[1] / weight**2 * (left[2] / left[1] - right[2] / right[1]) ** 2
        gain = np.where(allowed, between, -1.0)
        if gain.max() <= 0.0:
            return
        f, at = np.unravel_index(np.argmax(gain >= gain.max() * (1.0 - TIE)), gain.shape)
        tree.feature[node], tree.split[node], tree.gain[node] = features[f], at, gain[f, at]
        for child, side in ((2 * node, left), (2 * node + 1, right)):
            tree.stats[child] = side[:, f, at]
            tree.value[child] = tree.stats[child, 2] / tree.stats[child, 1]

    def fit(self, blocks: RDD) -> Tree:
        tree = Tree(self.max_depth)
        depth = 1 if blocks.getNumPartitions() <= DIRECT_SUMS else 2
        for level in range(self.max_depth):
            parts = blocks.mapPartitionsWithIndex(lambda i, b, level=level: self._level_sums(i, b, tree, level))
            sums = self._spread(parts.treeReduce(np.add, depth))
            grown = [n for n in range(1 << level, 2 << level) if n == 1 or tree.feature[n // 2] >= 0]
            for node in grown:
                self._split(tree, node, sums[:, :, node - (1 << level)])
            if not any(tree.feature[n] >= 0 for n in grown):
                break
        return tree


def add_tree(blocks: RDD, tree: Tree, rate: float) -> RDD:
    def moved(b):
        return Block(b.bins, b.sign, b.weight, b.margin + rate * tree.value[tree.nodes(b.bins)])

    return blocks.map(moved)


def losses(blocks: RDD, trees: list[Tree], rates: list[float]) -> list[float]:
    """Mean logistic loss of ``blocks`` after each tree, in one pass over them."""
    def sums(held):
        total, n = np.zeros(len(trees)), 0
        for b in held:
            margin, n = b.margin, n + len(b.sign)
            for i, (tree, rate) in enumerate(zip(trees, rates, strict=True)):
                margin = margin + rate * tree.value[tree.nodes(b.bins)]
                total[i] += 2.0 * np.logaddexp(0.0, -2.0 * b.sign * margin).sum()
        yield total, n

    total, n = blocks.mapPartitions(sums).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return list(total / n) if n else [float("nan")] * len(trees)


def ml_tree(spark, tree: Tree, borders: list[np.ndarray]):
    """The Spark ML regression tree with these nodes."""
    jvm = spark._jvm
    ml, part = jvm.org.apache.spark.ml, jvm.java.util.Arrays.copyOfRange
    leaf, inner, border = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit  # each look-up is a call
    variance = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    all_stats = jvm.org.apache.spark.mllib.linalg.Vectors.parse(str(tree.stats[:, 1:].ravel().tolist())).toArray()  # one call for all nodes

    def build(node):
        count, weight, total, squares = tree.stats[node].tolist()
        calculator = variance(part(all_stats, 3 * node, 3 * node + 3), int(count))
        impurity = max((squares - total * total / weight) / weight, 0.0)
        value, feature = float(tree.value[node]), int(tree.feature[node])
        if feature < 0:
            return leaf(value, impurity, calculator)
        split = border(feature, float(borders[feature][tree.split[node]]))
        return inner(value, impurity, float(tree.gain[node]), build(2 * node), build(2 * node + 1), split, calculator)

    return ml.regression.DecisionTreeRegressionModel(build(1), len(borders))


#: A node as Spark ML's saved models hold it.
NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
        "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, "
        "numCategories int>>")


def saved_nodes(number: int, tree: Tree, borders: list[np.ndarray]) -> list[tuple]:
    """The nodes of tree ``number`` as rows of ``NODE``, numbered in prefix order."""
    rows = []

    def add(node) -> int:
        at = len(rows)
        rows.append(None)
        count, weight, total, squares = tree.stats[node].tolist()
        feature, gain, left, right, split = int(tree.feature[node]), -1.0, -1, -1, (-1, [], -1)
        if feature >= 0:
            gain, split = float(tree.gain[node]), (feature, [float(borders[feature][tree.split[node]])], -1)
            left, right = add(2 * node), add(2 * node + 1)
        impurity = max((squares - total * total / weight) / weight, 0.0)
        rows[at] = (number, (at, float(tree.value[node]), impurity, [weight, total, squares], int(count), gain, left, right, split))
        return at

    add(1)
    return rows
