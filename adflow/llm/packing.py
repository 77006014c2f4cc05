"""Packing by concatenate and cut: all documents end to end, cut into fixed windows.

1. Every partition turns its documents into token ids, each followed by the end id,
   and keeps a running total: a document knows where it starts in its partition. The
   ids are written once; a text is tokenised once.
2. The totals of the partitions (one row each) are summed up to the start of every
   partition. Partition start plus start in the partition is a document's place in
   the whole corpus.
3. Windows of ``size`` ids are cut at that place, row by row: a document yields one
   piece for each window it touches. ``continues`` and ``goes_on`` are the boundary
   records: the piece begins, or ends, inside its document.

Only the last window can be short, so padding is below one window for the whole
corpus. Nothing is shuffled but the totals. A retried task reads what was written,
so the places of documents never change under it.

Tokens are those of a byte-level BPE in the JSON format of the ``tokenizers`` library.
Its vocabulary is encoded by ``tiktoken``, which gives the same ids at a fifth of the
time (tests compare them); a text that it gives up on (a million blanks in a row) is
encoded by ``tokenizers``. Strings of added tokens inside a text are those tokens.

Defined results: a null text counts as empty: one piece with the end id alone. A null
id is an id like any other, and repeated rows are packed each. Documents keep the
order of the input's partitions, so there are no ties; another partitioning gives
other, equally valid windows. Very long texts are tokenised a megabyte at a time, cut
where the pattern always cuts (before a blank between two letters); one document's
ids have to fit into a task. An empty table gives an empty result. Columns are taken
by name into fresh ones, so that other columns of the input cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import checkpoint
from .common import slices

SIZE, END_ID = 1024, 0
#: Bytes of an id in the binary column ``ids`` (little-endian, unsigned).
ID_BYTES = 4
#: How a byte-level BPE cuts a text before it merges bytes (fixed by its format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")


def _byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable ones stand
    for themselves, the others for characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from a text to its ids (numpy uint32) for a tokenizer file."""
    import json

    import numpy as np
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    byte_of = _byte_of_char()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("the ids of the vocabulary are not its merge order")
    quick = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @lru_cache(maxsize=1)
    def thorough():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode(text: str):
        try:
            return quick.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern engine has a limit
            return np.array(thorough().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def _parts(text: str, limit: int = 1 << 20):
    """The text in parts of about ``limit`` characters whose ids are those of the whole."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:]


def token_ids(text: str | None, path: str, end_id: int = END_ID) -> bytes:
    """The ids of a text and the end id, four bytes each."""
    import numpy as np

    encode = _encoder(path)
    ids = [encode(part) for part in _parts(text)] if text else []
    return np.concatenate([*ids, [end_id]]).astype("<u4").tobytes()


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in slices(whole, 1 << 20)):
            ids = [token_ids(t, path, end_id) for t in batch.column(1).to_pylist()]
            n = [len(x) // ID_BYTES for x in ids]
            start = []
            for k in n:
                start.append(at)
                at += k
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid] * len(n), pa.int32()), batch.column(0), pa.array(start, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["pid", "id", "own_start", "n", "ids"])

    return run


def placed_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
                     end_id: int = END_ID) -> DataFrame:
    """id, n (ids of the document, with the end id), ids and place (of its first id among
    the ids of all documents)."""
    schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("id", docs.schema[doc_id].dataType),
                           T.StructField("own_start", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    rows = checkpoint(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
                      .mapInArrow(_tokenise(tokenizer, end_id), schema))
    totals = rows.groupBy("pid").agg(F.sum("n").alias("total"))  # a row for each partition
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "pid").select("id", "n", "ids", (F.col("base") + F.col("own_start")).alias("place"))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start (ids of the document before it), length, ids, doc_tokens,
    sequence_id, offset (in the sequence), continues and goes_on."""
    placed = placed_documents(docs, tokenizer, text, doc_id, end_id)
    place, end = F.col("place"), F.col("place") + F.col("n")

    def piece(window):
        first, last = F.greatest(window * size, place), F.least((window + 1) * size, end)
        start, length = first - place, last - first
        ids = F.substring("ids", (start * ID_BYTES + 1).cast("int"), (length * ID_BYTES).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), ids.alias("ids"), window.alias("sequence_id"),
                        (first - window * size).alias("offset"), (start > 0).alias("continues"), (last < end).alias("goes_on"))

    windows = F.sequence(F.floor(place / size), F.floor((end - 1) / size))
    rows = placed.select("id", "n", F.explode(F.transform(windows, piece)).alias("p"))
    return rows.select(F.col("id").alias(doc_id), "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"),
                       "p.sequence_id", "p.offset", "p.continues", "p.goes_on")


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = END_ID) -> DataFrame:
    """The training rows: sequence_id, ids (array of ``size``, padded at the end), n_ids
    (without padding) and starts (offsets at which pieces begin). A sequence has at most
    ``size`` pieces, which is all that one group holds."""
    each = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    # Ids are joined as hexadecimal text and cut into numbers again.
    text = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])

    def number(i):
        at = i * 2 * ID_BYTES + 1
        little = [F.substring(F.col("text"), at + 2 * k, F.lit(2)) for k in reversed(range(ID_BYTES))]
        return F.conv(F.concat(*little), 16, 10).cast("long")

    ids = F.transform(F.sequence(F.lit(0), F.col("n_ids").cast("int") - 1), number)
    return each.select("sequence_id", text.alias("text"), n.alias("n_ids"), F.transform("p", lambda x: x["offset"]).alias("starts")).select(
        "sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), (size - F.col("n_ids")).cast("int"))).alias("ids"),
        "n_ids", "starts")
