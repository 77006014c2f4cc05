"""Filter audit against orders that are really run, on odd rows and on the smallest tables."""

import random
import re
from itertools import permutations

import pytest

from adflow.llm import filter_audit as A


def fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}


def brute(docs, labels):
    """Every order, filter by filter, over the rows themselves."""
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        smaller = doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs)
        rows.append((source or "", fails(text, smaller), any(i == doc_id and q == 1 for i, q, _ in labels if i is not None),
                     any(i == doc_id and x == 1 for i, _, x in labels if i is not None)))
    out, gone = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                removed = [r for r in alive if r[1][f]]
                alive = [r for r in alive if not r[1][f]]
                gone[part, f] = gone.get((part, f), 0) + len(removed)
                failing = [r for r in mine if r[1][f]]
                out[part, "".join(order), step] = (
                    len(alive), len(removed), len(failing) - len(removed), sum(sum(r[1].values()) == 1 for r in failing),
                    sum(r[2] for r in removed), sum(r[3] for r in removed))
    return {(*k, *v, gone[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rows_of(df):
    assert tuple(df.columns) == COLUMNS
    return {tuple(r) for r in df.collect()}


def test_odd_rows_equal_orders_that_are_run(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "a b", " \t\x0b", "x#y", "A" * 50, "é " * 300, " ".join(words), " ".join(words) + " |",
             " ".join(words[:150] * 2), "long " * 30_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(120)]
    labels = [(k, k % 3 % 2, k % 5 // 4) for k in range(0, 70, 2)] + [(None, 1, 1), (4, 1, 1), (6, None, None)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, source string, mask string, h int")
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = rows_of(A.audit(d, lab))
    assert got == brute(docs, labels)
    # A sketch far too small clears little and changes nothing.
    assert rows_of(A.audit(d.repartition(7), lab, most_counters=8)) == got


def test_sketch_clears_most_unique_texts_and_no_repeat(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', if(id % 10 = 0, 0, id)) AS text", "'s' AS source")
    hashes = docs.selectExpr("xxhash64(text) AS h").repartition(5)
    test = A.may_repeat(A.repeat_sketch(hashes, 20_000))
    r = docs.selectExpr("doc_id % 10 = 0 AS again", "xxhash64(text) AS h").withColumn("m", test("h")).groupBy("again", "m").count().collect()
    n = {(x.again, x.m): x["count"] for x in r}
    assert n[True, True] == 2000 and (True, False) not in n and n[False, False] > 17_500
    assert A.filter_masks(docs).filter("mask >= 16").count() == 1999


def test_sketch_size_is_bounded():
    assert A.sketch_size(0) == (A.CHUNK, 4)
    counters, probes = A.sketch_size(10**12)
    assert counters == A.MOST_COUNTERS and probes == 1


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_and_single(spark, rows):
    d = spark.createDataFrame([(1, None, None)][:rows], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows_of(A.audit(d, lab))
    assert len(got) == 600 * rows and got == brute([(1, None, None)][:rows], [])
