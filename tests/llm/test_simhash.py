"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash

from adflow.llm import components, simhash
from adflow.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits=4):
    """rows: (id, fingerprint); id -> smallest id reachable."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in rows]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs])
    got = QUERIES["op2_simhash_near_dedup"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_edge_cases_and_filter(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n", None), (4, "Two Words", "z"), (5, "two words", "z"),
            (6, base, "a"), (7, base.upper(), "b"), (7, base.upper(), "b"), (None, base + " tail", "c"),
            (9, base + " tail", None), (10, "été " * 50, "d"), (None, "unlike anything else at all here", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, simhash.simhash_groups(df).collect()), key=str)
    want = sorted(brute_components([(r[0], brute_fingerprint(r[1])) for r in rows]), key=str)
    assert got == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    comp = {(i, f): c for i, f, c in want}
    stay = [r for r in rows if r[0] is None or comp[(r[0], f"{brute_fingerprint(r[1]):016x}")] == r[0]]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(stay, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp int")
    assert simhash.simhash_groups(df).collect() == []
    assert simhash.near_dedup(df).collect() == []


def test_long_text_in_pieces(monkeypatch):
    text = "\n".join(f"tok{i % 977} Ünï{i}" for i in range(4000))
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    assert int(simhash.fingerprints_of([text, "a", None], 4)[0]) == want


def families(seed, centres, members, flips):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(members):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("rows", [10, 20_000])
def test_links_on_dense_families(spark, monkeypatch, rows):
    """Families of near fingerprints, with whole groups and with groups dealt in chunks."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
    fps = families(3, 12, 40, 5)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node % 2**64: r.root for r in components.components(simhash.links(df, 4)).collect()}
    want = {int(f, 16): c for i, f, c in brute_components([(f, f) for f in fps])}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == [g for g in groups(want) if len(g) > 1]


def test_index_alone_finds_every_link(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    fps = np.array(families(5, 6, 60, 6), dtype=np.uint64)
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    member, root = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps, 4).forest()
    label = np.arange(len(fps))
    label[member] = root
    want = {f: c for f, _, c in brute_components([(int(f), int(f)) for f in fps])}
    for i, f in enumerate(fps):
        for j, g in enumerate(fps):
            assert (label[i] == label[j]) == (want[int(f)] == want[int(g)])


def test_masks_cover_every_pair():
    for bits in (0, 1, 4):
        for r in (1, 2, 3, 4):
            masks = simhash.block_masks(bits, r)
            assert len({m % 2**64 for m in masks}) == len(masks)
            rng = np.random.default_rng(1)
            for _ in range(200):
                x = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
                assert any(m & x == 0 for m in masks)


def test_one_id_with_texts_of_two_groups(spark):
    """Every component keeps a row, also if the id of its first row goes with another text."""
    x, y = "one two three four five six", "nothing of that is in here at all"
    rows = [(1, y), (2, x), (2, y), (3, x), (2, x)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, gone_id string")
    assert sorted((r.doc_id, r.text) for r in simhash.near_dedup(df).collect()) == [(1, y), (2, x), (2, x)]
