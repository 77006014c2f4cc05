"""The pipeline's stages, each held against brute force on its own input."""

import re

import corpus_pipeline as cp
from test_decontam import brute as brute_leaks
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, stages = docs.columns, []
    for name, stage in cp.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        stages.append((before, docs.collect()))
    ids = lambda rows: sorted(r.doc_id for r in rows)
    (a0, a1), (b0, b1), (c0, c1), (d0, d1), (e0, e1) = stages
    assert ids(a0) == ids(a1)  # every document of the table has a clear language
    groups = {}
    for r in b0:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
    assert ids(b1) == sorted(min(g)[1] for g in groups.values()) and len(b1) < len(b0)
    comps = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in c0])
    assert ids(c1) == sorted(i for i, _, c in comps if i == c) and len(c1) < len(c0)
    leaked = {d for d, *_ in brute_leaks([(r.doc_id, r.text) for r in d0], items)}
    assert ids(d1) == sorted(r.doc_id for r in d0 if r.doc_id not in leaked) and leaked
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    longest = max(len(r.text.split()) for r in e0)
    assert abs(words(e1) - 1.5 * words(e0)) <= longest * len({r.source for r in e0}) / 2
    assert max(ids(e1).count(i) for i in set(ids(e1))) <= 2
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, e1))


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(1, None, None, None, None, None), (1, None, None, None, None, None), (2, "", "en", "s", 0, "x"),
            (3, "the and of thing", "en", "s", 9, "x"), (3, "the and of thing", "en", "s", 9, "x"),
            (None, "der und die das", "de", None, 9, None), (4, "w " * 100_000, "en", "s", 1, "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            assert all(tuple(r) in rows for r in out.collect())
