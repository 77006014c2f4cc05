"""Toxicity: cumulative-link ordinal regression on sparse text features.

A text has one score, ``weights . x``; the same weights serve every threshold:
P(grade > k) = sigmoid(score - theta_k) with theta_0 <= theta_1 <= ... The
expected severity is the sum of the grades weighted by their probabilities, and
the grade is the highest one that is reached with even odds.

Features are the distinct words of the whole text (runs of letters, lower-cased),
hashed to ``BUCKETS``. The weights are fitted in numpy by FTRL-proximal steps with
an L1 term, on the words whose presence differs between the rows above and below
some threshold by ``least_z`` standard errors and that ``least_rows`` rows hold; all
others have weight zero. Training uses a bounded sample of labelled rows
(``sample_per_grade`` expected rows a grade, chosen by a hash of the id, weighted
back to the grades' shares), reduced to bucket lists on the executors.
Prediction needs only the weight vector, which every task gets.

Defined results: a null text counts as empty and is scored by the thresholds
alone. Labels without an id, a grade or a document do not train; several labels
of one id train as one row with the highest grade. With fewer than two grades
among the labels every row has the one grade (0 without labels). Repeated documents
are scored alike; in the sample each of them trains. Rows that tie in the order of
training are equal. Very long texts are read in pieces; what is kept of one are its
distinct words. An empty table gives an empty result. Columns are taken by name into
fresh ones, so that other columns cannot clash.

Driver: the sample is bounded in rows; a row is one number for each bucket its text
holds, so the worst case is ``sample_per_grade`` x grades x ``BUCKETS`` x 4 bytes, and a
few kilobytes a row on ordinary texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, slices

BUCKETS = 1 << 18
#: A training sample of up to so many rows is sent to the documents, a larger one joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words whose weight a worker remembers.
REMEMBERED = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class OrdinalModel:
    """Grades in order, bucket weights, and one threshold between neighbours."""

    grades: tuple[int, ...]
    weights: object
    thresholds: tuple[float, ...]


def distinct_words(text: str | None) -> set[str]:
    words: set[str] = set()
    for piece in pieces(text):
        words.update(_WORD.findall(piece.lower()))
    return words


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _telling(rows, y, grades: int, least_rows: int, least_z: float):
    """Buckets whose log odds differ above and below some threshold."""
    import numpy as np

    held = np.stack([np.bincount(np.concatenate([rows[i][2] for i in np.flatnonzero(y == g)] or [[]]).astype(int),
                                 minlength=BUCKETS) for g in range(grades)])
    size = np.bincount(y, minlength=grades)
    keep = np.zeros(BUCKETS, dtype=bool)
    for k in range(1, grades):
        low, high = held[:k].sum(axis=0) + 0.5, held[k:].sum(axis=0) + 0.5
        odds = np.log(high / (size[k:].sum() + 1)) - np.log(low / (size[:k].sum() + 1))
        keep |= np.abs(odds) >= least_z * np.sqrt(1 / low + 1 / high)
    return keep & (held.sum(axis=0) >= least_rows)


def fit(rows: list[tuple], shares: dict[int, float] | None = None, epochs: int = 10, alpha: float = 1.0,
        l1: float = 1.0, least_rows: int = 3, least_z: float = 2.0, seed: int = 11) -> OrdinalModel:
    """Fit on ``rows`` of (key, grade, buckets). ``shares`` are the grades' shares
    among all labelled rows, if the sample has others."""
    import numpy as np

    rows = sorted(rows, key=lambda r: (str(r[0]), r[1], len(r[2])))
    grades = tuple(sorted({int(r[1]) for r in rows}))
    if len(grades) < 2:
        return OrdinalModel(grades or (0,), np.zeros(BUCKETS), ())
    index = {g: i for i, g in enumerate(grades)}
    y = np.array([index[int(r[1])] for r in rows])
    keep = _telling(rows, y, len(grades), least_rows, least_z)
    held = [np.asarray(r[2])[keep[np.asarray(r[2], dtype=int)]].astype(int) for r in rows]
    sampled = np.bincount(y, minlength=len(grades)) / len(y)
    real = np.array([shares[g] for g in grades]) if shares else sampled
    real = real / real.sum()
    weight = (real / sampled)[y]
    above = np.clip(1 - np.cumsum(real)[:-1], 1e-6, 1 - 1e-6)  # share above each threshold
    theta = np.log((1 - above) / above)
    z, n, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    squares = np.full(len(theta), 1.0)
    rng = np.random.default_rng(seed)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = held[i]
            score = w[at].sum()
            upper = sigmoid(theta[y[i]] - score) if y[i] < len(theta) else 1.0
            lower = sigmoid(theta[y[i] - 1] - score) if y[i] else 0.0
            slope = weight[i] * (1 - upper - lower)  # of the log loss, by the score
            p = max(upper - lower, 1e-9)
            for k, s in ((y[i], -upper * (1 - upper) / p), (y[i] - 1, lower * (1 - lower) / p)):
                if 0 <= k < len(theta):
                    squares[k] += (weight[i] * s) ** 2
                    theta[k] -= 0.1 * weight[i] * s / np.sqrt(squares[k])
            theta = np.maximum.accumulate(theta)
            if len(at):
                step = (np.sqrt(n[at] + slope ** 2) - np.sqrt(n[at])) / alpha
                z[at] += slope - step * w[at]
                n[at] += slope ** 2
                w[at] = np.where(np.abs(z[at]) <= l1, 0.0,
                                 -(z[at] - np.sign(z[at]) * l1) * alpha / (1.0 + np.sqrt(n[at])))
    return OrdinalModel(grades, w, tuple(float(t) for t in theta))


def train(docs: DataFrame, labels: DataFrame, grade: Column, text: str = "text", doc_id: str = "doc_id",
          sample_per_grade: int = 6000, **options) -> OrdinalModel:
    """Fit on the documents that ``labels`` covers; ``grade`` is an integer column
    expression over ``labels``."""
    graded = (labels.select(F.col(doc_id).alias("id"), grade.cast("int").alias("grade"))
              .filter("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").alias("grade")))
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}  # one row a grade
    if not counts:
        return fit([], **options)
    total = sum(counts.values())
    share = F.create_map(*[F.lit(x) for g, n in sorted(counts.items()) for x in (g, min(1.0, sample_per_grade / n))])
    unit = F.pmod(F.xxhash64(F.col("id"), F.lit("toxicity sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = graded.filter(unit < share[F.col("grade")])
    if sum(min(n, sample_per_grade) for n in counts.values()) <= BROADCAST_ROWS:
        sample = F.broadcast(sample)  # (id, grade) pairs, bounded by the sample

    def run(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole)):
            found = [sorted({bucket(w) for w in distinct_words(t)}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))],
                                             names=["key", "grade", "buckets"])

    labelled = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(sample, "id")
    table = (labelled.select(F.col("id").cast("string"), "grade", "text")
             .mapInArrow(run, "key string, grade int, buckets array<int>").toArrow())  # bounded by the sample
    rows = list(zip(table["key"].to_pylist(), table["grade"].to_pylist(), [x.values.to_numpy() for x in table["buckets"]]))
    return fit(rows, {g: n / total for g, n in counts.items()}, **options)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", doc_id: str = "doc_id",
          toxic_from: int = 1) -> DataFrame:
    """id, grade, expected_severity, p_toxic (probability of grade ``toxic_from`` or
    more) and toxic for every row of ``docs``."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField(doc_id, id_type), T.StructField("grade", T.IntegerType()),
        T.StructField("expected_severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()),
        T.StructField("toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        grades, theta = np.array(m.grades), np.array(m.thresholds)
        memory: dict[str, float] = {}
        for b in (part for whole in batches for part in slices(whole)):
            scores = np.zeros(b.num_rows)
            for i, text in enumerate(b.column(1).to_pylist()):
                words = distinct_words(text)
                new = [w for w in words if w not in memory]
                if len(memory) + len(new) > REMEMBERED:
                    memory.clear()
                    new = list(words)
                for w in new:
                    memory[w] = float(m.weights[bucket(w)])
                scores[i] = sum([memory[w] for w in words])
            above = 1 / (1 + np.exp(-np.clip(scores[:, None] - theta[None, :], -60, 60)))
            edges = np.c_[np.ones(len(scores)), above, np.zeros(len(scores))]
            probability = edges[:, :-1] - edges[:, 1:]
            toxic = probability[:, grades >= toxic_from].sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(grades[(above >= 0.5).sum(axis=1)], pa.int32()),
                 pa.array(probability @ grades, pa.float64()), pa.array(toxic, pa.float64()),
                 pa.array(toxic >= 0.5, pa.bool_())], names=schema.names)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
