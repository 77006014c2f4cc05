"""Packing against the contract: ids by the reference tokenizer, each in one piece, gapless windows."""

import zlib

import public_tokenizers
import pytest

from adflow.llm import packing
from adflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def checked(pieces, total):
    """Windows are gapless, of at most 1024 ids, and all but the last are full."""
    windows = {}
    for p in pieces:
        assert p.length > 0
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == (1024 if s < max(windows) else total - 1024 * max(windows))
    assert sorted(windows) == list(range(len(windows)))


def test_query_covers_every_id_once(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = QUERIES["op12_packing"](spark, SF).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert set(by_doc) == set(docs)
    total = 0
    for d, text in docs.items():
        ids, at = ids_of(tokenizer, text), 0
        total += len(ids)
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            body = b"".join(i.to_bytes(4, "little") for i in ids[at:at + p.length])
            assert p.ids_crc32 == zlib.crc32(body)
            assert p.continues == (at > 0) and p.goes_on == (at + p.length < len(ids))
            at += p.length
        assert at == len(ids)
    checked(pieces, total)


ODD = ["", "a", " ", "\n\n x", "don't we'll 'S", "é ü 漢字 🙂", "x <|endoftext|> y", "tab\tand\x0bmore\x85", "b" * 5000,
       "word " * 700_000, " " * 300_000 + "x", "one two " * 10]


def test_ids_equal_the_tokenizers_library(tokenizer):
    for text in [*ODD, None]:
        ids = packing.token_ids(text, PATH)
        assert ids == b"".join(i.to_bytes(4, "little") for i in ids_of(tokenizer, text))


def test_texts_that_stop_the_quick_encoder(tokenizer):
    blanks = " " * 1_000_000
    assert len(packing.token_ids(blanks, PATH)) == 4 * len(ids_of(tokenizer, blanks))


def test_rows_ids_and_sequences(spark, tokenizer):
    rows = [(None, "null id"), (1, None), (1, "twice"), (1, "twice"), *[(k, t) for k, t in enumerate(ODD) if len(t) < 10_000]]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, place long").repartition(3)
    pieces = packing.pack(df, PATH, size=64)
    got = pieces.collect()
    assert sorted((p.doc_id or -1, p.doc_tokens) for p in got if not p.continues) == sorted(
        (d or -1, len(ids_of(tokenizer, t))) for d, t in rows)
    seqs = {r.sequence_id: r for r in packing.sequences(pieces, 64).collect()}
    assert all(len(s.ids) == 64 and s.starts[0] == 0 for s in seqs.values())
    assert all(s.n_ids == 64 for k, s in seqs.items() if k < max(seqs))
    for p in got:
        own = [int.from_bytes(p.ids[k:k + 4], "little") for k in range(0, len(p.ids), 4)]
        assert seqs[p.sequence_id].ids[p.offset:p.offset + p.length] == own and p.offset in seqs[p.sequence_id].starts


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    pieces = packing.pack(df, PATH)
    assert pieces.collect() == [] and packing.sequences(pieces).collect() == []
