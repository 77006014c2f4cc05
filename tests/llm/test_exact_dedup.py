"""Exact de-duplication against brute force, groups across partition borders included."""

import hashlib
import re

import pytest

from adflow.llm import exact_dedup


def brute(rows):
    """rows: (id, text) -> id, keep_id, group_size, kept, sha; ids unique."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for n, members in groups.items():
        members.sort()
        for place, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), place == 0, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_hot_group_over_many_partitions(spark, partitions):
    rows = [(i, "hot  text" + " " * (i % 3)) for i in range(400)]
    rows += [(1000 + i, f"own text {i}") for i in range(150)] + [(2000 + i, f"pair {i // 2}") for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \t\v\f\r\n"), (3003, "\u00a0"), (None, "no id"), (3004, "noid")]
    rows += [(4000, "x" * 300_000), (4001, "x" * 150_000 + " " + "x" * 150_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = sorted(map(tuple, exact_dedup.exact_groups(df, partitions=partitions).collect()), key=str)
    assert got == brute(rows)
    kept = sorted((r.doc_id for r in exact_dedup.exact_dedup(df, partitions=partitions).collect()), key=str)
    assert kept == sorted((r[0] for r in got if r[3]), key=str)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b", "L", None), (1, "a b", "L", None), (2, "ab", "M", 5), (3, "c", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, run string, norm int")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()) == [
        (1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True)]
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "a b", "L", None), (3, "c", None, 6)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).collect() == [] and exact_dedup.exact_dedup(df).collect() == []
