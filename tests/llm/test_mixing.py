"""Mixing: targets against iterated resharing, samples near their targets."""

import random

from adflow.llm import mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        rest = budget - sum(target.values())
        over = [s for s in open_ if rest * w[s] / sum(w[t] for t in open_) >= cap * sizes[s]]
        if not over:
            target.update({s: rest * w[s] / sum(w[t] for t in open_) for s in open_})
            break
        target.update({s: cap * sizes[s] for s in over})
        open_ -= set(over)
    return target


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice(["a"] * 8 + ["b", "c", "é", "Z", None]), -1) for i in range(1500)]
    rows += [(9000, None, "a", 0), (9001, "", "empty", 0), (9002, " \n", "empty", 0), (None, "three short words", "b", 1)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = reshared(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30  # half a document
    again = mixing.mix_sources(table(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_of_the_mix_follow_the_plan(spark):
    rows = [(i, f"w{i} " * (1 + i % 13), f"s{i % 4}", i) for i in range(400)] + [(400, "same row", None, 0)] * 2
    df = table(spark, rows)
    copies = {}
    for r in mixing.mix_sources(df).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
        assert tuple(r) in rows
    assert seen == {i: n for i, n in copies.items() if n}


def test_sample_prefers_quality(spark):
    df = spark.createDataFrame([(i, 1.0 + (i % 2) * 9) for i in range(4000)], "doc_id long, q double")
    keys = df.select("q", mixing.sample_key(df.doc_id, df.q).alias("k")).orderBy("k").limit(1000).collect()
    assert sum(r.q > 1 for r in keys) > 800


def test_empty_table_and_long_text(spark):
    assert mixing.mix_sources(table(spark, [])).collect() == []
    assert mixing.mixed_documents(table(spark, [])).collect() == []
    one = mixing.mix_sources(table(spark, [(1, "a " * 500_000, "x", 0)])).first()
    assert (one.size, one.target, one.taken) == (500_000, 750_000.0, 500_000 * (1 if one.copies == 1 else 2))
