"""Toxicity: the ordinal model, held-out accuracy, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from adflow.llm import toxicity
from adflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_query_catches_toxic_and_leaves_clean(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    toxic = [got[i].toxic for i, t in labels.items() if t]
    clean = [got[i].toxic for i, t in labels.items() if not t]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.005
    assert all(0 <= r.expected_severity <= 2 for r in got.values())


def graded_rows(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows = []
    for i in range(n):
        grade = int(rng.integers(0, 4))
        text = list(rng.choice(words, 30)) + ["vile"] * (grade > 0) + ["hateful"] * (grade > 1) + ["awful"] * (grade > 2)
        rows.append((i, " ".join(rng.permutation(text)), grade))
    return rows


def test_ordered_grades_on_held_out_rows():
    rows = graded_rows(1500, 1)
    held = [(i, g, sorted({toxicity.bucket(w) for w in toxicity.distinct_words(t)})) for i, t, g in rows]
    model = toxicity.fit([(i, g, np.array(b)) for i, g, b in held if i % 3])
    assert model.grades == (0, 1, 2, 3) and list(model.thresholds) == sorted(model.thresholds)
    right = []
    for i, g, b in held:
        if i % 3 == 0:
            right.append(sum(model.weights[b].sum() >= t for t in model.thresholds) == g)
    assert np.mean(right) > 0.9  # four grades; chance is 0.25
    assert toxicity.fit([(i, g, np.array(b)) for i, g, b in held if i % 3]).thresholds == model.thresholds


def test_edge_cases(spark):
    rows = [(i, t, "x", g) for i, t, g in graded_rows(300, 2)]
    odd = [(900, None, None, 0), (901, "", "y", 0), (902, "12 34 !!", "y", 0), (None, "vile hateful awful", "y", 0),
           (903, "vile " * 200_000, "y", 0), (904, "same", "y", 0), (904, "same", "y", 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic string, grade int")
    labels = spark.createDataFrame([(i, g) for i, _, _, g in rows] + [(0, None), (None, 3), (1, 0), (99_999, 2)],
                                   "doc_id long, g int")
    model = toxicity.train(docs, labels, F.col("g"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert by[None].grade >= 2 and by[903].grade == 1
    for i in (900, 901, 902):
        assert abs(by[i].expected_severity - by[900].expected_severity) < 1e-12
    assert all(abs(r.p_toxic - 0.5) > 1e-9 and r.toxic == (r.p_toxic >= 0.5) for r in got)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, g int")
    model = toxicity.train(docs, none, F.col("g"))
    assert [(r.grade, r.toxic) for r in toxicity.score(docs, model).collect()] == [(0, False)]
    assert toxicity.score(docs.limit(0), model).collect() == []
