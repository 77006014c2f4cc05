"""Language identification: held-out accuracy, rejection, edge cases."""

import zlib

import numpy as np

from adflow.llm import langid
from adflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    fold = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in fold]) > 0.98
    assert np.mean([r.rejected for r in got]) < 0.01


def test_edge_cases(spark):
    rows = [(i, f"the and of thing {i}", "en", "a", 1.0) for i in range(40)]
    rows += [(100 + i, f"der die und nicht {i}", "de", "b", 2.0) for i in range(40)]
    odd = [(900, None, "en", "x", 0.0), (901, "", "de", "x", 0.0), (902, "12 !!", None, "x", 0.0),
           (903, "these things", None, None, None), (903, "these things", None, None, None),
           (None, "und die der", "de", "y", 1.0), (904, "the and of " * 100_000, None, "z", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[None].held_out is False and by[None].lang_pred == "de"
    assert by[904].lang_pred == "en" and not by[904].rejected
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) >= len(rows) and not {900, 901, 902} & {r.doc_id for r in kept}
    assert all(r.score in (0.0, 1.0, 2.0, None) for r in kept)  # the input's own column


def test_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).collect() == [] and langid.accepted(empty).collect() == []
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in langid.identify(bare).collect()] == [("und", True)]


def test_pieces_give_the_same_scores(monkeypatch):
    text = "Häuser und der die das, été à la maison " * 200
    scores = np.random.default_rng(0).normal(size=(langid.BUCKETS, 3))
    whole, n = langid._score_batch([text, None, "x"], scores)
    monkeypatch.setattr(langid, "PIECE", 64)
    parts, m = langid._score_batch([text, None, "x"], scores)
    assert (n == m).all() and np.allclose(whole, parts)
    bucket, count = langid.bucket_counts(text)
    assert np.allclose(whole[0], (scores[bucket] * count[:, None]).sum(axis=0))


def test_unseen_script_is_rejected():
    rows = [(i, lang, *langid.bucket_counts(f"{word} {i * 'a'}"))
            for i in range(30) for lang, word in (("en", "the thing"), ("de", "der und"))]
    model = langid.fit(rows)
    summed, grams = langid._score_batch(["这是一个中文句子"], model.scores)
    p = langid._softmax(summed / grams[:, None] / model.temperature)
    assert p.max() < model.threshold + 0.1
    assert langid.fit(rows).threshold == model.threshold  # reruns agree
