"""Near-duplicate detection on 64-bit SimHash fingerprints with a Gray-order
hierarchical index.

Fingerprint: words are runs of characters outside white space after lower-casing
A-Z; every run of ``shingle`` words (repeats included, joined by one space) is
hashed with XXH64, seed 42; a bit is 1 if it is set in more than half of the
hashes. A text of fewer words is one shingle; a text without words has
fingerprint zero, which links like any other.

Search for all pairs of distinct fingerprints within ``max_bits``:

* Top of the index: masked bit patterns. The 64 bits are cut into
  ``max_bits + r`` blocks; two fingerprints within ``max_bits`` agree on some
  ``r`` whole blocks. For every choice of r blocks the fingerprints that share
  that masked pattern form a group, and a pair that differs anywhere in the
  pattern is never looked at under that choice. This is an equi-join on (choice,
  pattern), so groups spread over the cluster. r follows from the number of
  distinct fingerprints and changes cost, never results.
* A group above ``GROUP_ROWS`` is dealt to chunks by hash and every pair of
  chunks is one block of work, so no task holds a whole hot group.
* Inside a block, fingerprints are sorted by Gray rank. Eight neighbours form a
  node that holds the bits all of them share (mask and value); nodes are grouped
  again up to one root. A query descends from the root, adds up its differences
  with each node's newly shared bits, and leaves a whole group as soon as the
  sum exceeds ``max_bits``. A group whose members are already linked to the query
  is skipped as well, so a dense family costs a tree, not all its pairs.
* Each block returns a spanning forest (at most one edge a fingerprint), and the
  forests are joined by distributed connected components.

Defined results: a null text counts as empty. A null id takes part in linking but is
never the component id unless all ids of the component are null. Repeated rows are
judged alike; rows of one id with different texts each by their own component. Ties
between fingerprints go to the smallest id. Very long texts are hashed in pieces of
``PIECE_BYTES``. Empty tables give empty results; other columns, whatever their names,
are passed through untouched by ``near_dedup``.

Size: the patterns kept for a fingerprint grow with the number of distinct ones (5, 15,
35 or 70 for four bits), as r does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import checkpoint
from .common import as_row, shuffle_partitions, slices, text_or_empty
from .components import components

SEED = 42
#: Largest chunk of one group; two chunks are one block of work.
GROUP_ROWS = 20_000
#: Wanted size of a group of unrelated fingerprints under one choice of blocks.
GROUP_WANTED = 8
#: Children of a node of the index.
FANOUT = 8
#: Queries that descend together, and (query, node) pairs held at once.
QUERIES, FRONTIER = 8192, 2_000_000
#: Texts above this many bytes are hashed piece by piece.
PIECE_BYTES = 4 << 20


# ---------------------------------------------------------------- fingerprints

def _pieces(data: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The words of a text in bounded lists that overlap by shingle - 1 words."""
    carry: list[bytes] = []
    at = 0
    while at < len(data):
        to = at + PIECE_BYTES
        while to < len(data) and data[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        words = carry + data[at:to].split()
        at = to
        if len(words) >= shingle or at >= len(data):
            yield words
            carry = words[len(words) - shingle + 1:] if shingle > 1 else []
        else:
            carry = words


def shingle_hashes(text: str | None, shingle: int) -> Iterator[list[int]]:
    """Unsigned XXH64 of every shingle of a text, in bounded lists."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    seen = False
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower(), shingle):
        if len(words) >= shingle:
            seen = True
            joined = b" ".join(words)
            ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
            starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
            yield [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:])]
        elif words and not seen:
            yield [digest(b" ".join(words), SEED)]


def _bit_counts(hashes, owner, docs: int):
    """counts[doc, bit] of set bits; ``owner`` is the doc of each hash, ascending.
    Eight bit planes are added in byte lanes, 255 hashes at a time."""
    import numpy as np

    counts = np.zeros((docs, 64), dtype=np.int64)
    if not len(hashes):
        return counts
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    length = np.diff(np.r_[first, len(owner)])
    slices = -(-length // 255)
    inside = np.arange(slices.sum()) - np.repeat(np.cumsum(slices) - slices, slices)
    cuts = np.repeat(first, slices) + inside * 255
    of = np.repeat(owner[first], slices)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), cuts)
        np.add.at(counts[:, bit::8], of, lanes.astype("<u8").view(np.uint8).reshape(-1, 8))
    return counts


def fingerprints_of(texts: list[str | None], shingle: int):
    """uint64 fingerprints of a list of texts."""
    import numpy as np

    counts = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    owner: list[tuple[int, int]] = []

    def flush():
        if owner:
            of = np.repeat([d for d, _ in owner], [n for _, n in owner])
            counts[:] += _bit_counts(np.array(hashes, dtype=np.uint64), of, len(texts))
            np.add.at(total, of, 1)
            hashes.clear()
            owner.clear()

    for d, text in enumerate(texts):
        for part in shingle_hashes(text, shingle):
            hashes.extend(part)
            owner.append((d, len(part)))
            if len(hashes) > 100_000:
                flush()
    flush()
    bits = (2 * counts > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(id, text_hash, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("text_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            fp = fingerprints_of(batch.column(2).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view("int64"))],
                                             names=["id", "text_hash", "fp"])

    body = text_or_empty(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------- the index of a block

class GrayIndex:
    """Levels of (mask, value) nodes over fingerprints sorted by (block, Gray
    rank). ``forest`` links everything within ``max_bits`` inside each block."""

    def __init__(self, block, fp, max_bits: int):
        import numpy as np

        self.np, self.fp, self.d = np, fp, max_bits
        self.label = np.arange(len(fp))
        ones = np.full(len(fp), ~np.uint64(0))
        # (mask, value, first child, end of children, end of leaves)
        self.levels = [(ones, fp, None, None, np.arange(1, len(fp) + 1))]
        low, high = fp, fp
        group, self.deep = block, 1
        while True:
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[at, len(group)])
            alone = size.max() == 1
            inside = np.arange(len(group)) - np.repeat(at, size)
            start = np.flatnonzero(inside % FANOUT == 0)
            end = np.r_[start[1:], len(group)]
            low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
            mask = ~(low ^ high)
            self.levels.append((mask, low & mask, start, end, self.levels[-1][4][end - 1]))
            group = group[start]
            if alone:
                break
        self.root_of = np.repeat(np.arange(len(group)), np.diff(np.r_[0, self.levels[-1][4]]))

    def _union(self, a, b):
        np, label = self.np, self.label
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def _spread(self):
        """Smallest and largest label below each node, by level."""
        np = self.np
        out = [(self.label.copy(), self.label.copy())]
        for _, _, start, _, _ in self.levels[1:]:
            out.append((np.minimum.reduceat(out[-1][0], start), np.maximum.reduceat(out[-1][1], start)))
        return out

    def _descend(self, level: int, q, node, diff, seen, spread):
        """Follow (query, node) pairs of one level; ``diff`` and ``seen`` are the
        differences so far and the bits they cover."""
        np = self.np
        while True:
            mask, value, start, end, leaf_end = self.levels[level]
            low, high = spread[level]
            keep = leaf_end[node] > q + 1
            keep &= ~((low[node] == high[node]) & (self.label[low[node]] == self.label[q]))
            q, node, diff, seen = q[keep], node[keep], diff[keep], seen[keep]
            diff = diff + np.bitwise_count((self.fp[q] ^ value[node]) & mask[node] & ~seen)
            keep = diff <= self.d
            q, node, diff = q[keep], node[keep], diff[keep]
            if not len(q):
                return
            if level == 0:
                self._union(q, node)
                return
            seen = mask[node]
            many = end[node] - start[node]
            if many.sum() > FRONTIER and len(q) > 1:
                for half in np.array_split(np.arange(len(q)), 2):
                    self._children(level, q[half], node[half], diff[half], seen[half], spread)
                return
            q, node, diff, seen = self._expand(level, q, node, diff, seen)
            level -= 1

    def _expand(self, level, q, node, diff, seen):
        np = self.np
        _, _, start, end, _ = self.levels[level]
        many = end[node] - start[node]
        child = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[node], many)
        return np.repeat(q, many), child, np.repeat(diff, many), np.repeat(seen, many)

    def _children(self, level, q, node, diff, seen, spread):
        many = (self.levels[level][3] - self.levels[level][2])[node]
        if many.sum() > FRONTIER and len(q) > 1:
            for half in self.np.array_split(self.np.arange(len(q)), 2):
                self._children(level, q[half], node[half], diff[half], seen[half], spread)
            return
        self._descend(level - 1, *self._expand(level, q, node, diff, seen), spread)

    def forest(self):
        """Indexes (member, root) of a spanning forest of the links."""
        np = self.np
        at, step = 0, 64  # a few queries first: what they link prunes the others
        while at < len(self.fp):
            q = np.arange(at, min(at + step, len(self.fp)))
            at, step = at + step, min(4 * step, QUERIES)
            zero = np.zeros(len(q), dtype=np.int64)
            self._descend(len(self.levels) - 1, q, self.root_of[q], zero, zero.astype(np.uint64), self._spread())
        member = np.flatnonzero(self.label != np.arange(len(self.fp)))
        return member, self.label[member]


def _link_blocks(max_bits: int):
    """Forest edges (a, b) of sorted (block, fp) rows, whole blocks at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def linked(block, fp):
            index = GrayIndex(block, fp.view(np.uint64), max_bits)
            member, root = index.forest()
            return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], names=["a", "b"])

        blocks, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            blocks = np.r_[blocks, batch.column(0).to_numpy()]
            fps = np.r_[fps, batch.column(1).to_numpy()]
            if len(blocks) < 100_000:
                continue
            cut = int(np.searchsorted(blocks, blocks[-1]))  # the last block may go on
            if cut:
                yield linked(blocks[:cut], fps[:cut])
                blocks, fps = blocks[cut:], fps[cut:]
        if len(blocks):
            yield linked(blocks, fps)

    return run


# ------------------------------------------------------------------ distribution

def gray_rank(fp: Column) -> Column:
    """Rank of a bit pattern in the reflected Gray code (prefix exclusive-or)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def block_masks(max_bits: int, shared: int) -> list[int]:
    """Signed masks: every choice of ``shared`` out of max_bits + shared blocks."""
    parts = max_bits + shared
    edge = [round(64 * i / parts) for i in range(parts + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edge, edge[1:])]
    masks = [sum(block[i] for i in pick) for pick in combinations(range(parts), shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shared_blocks(n: int, max_bits: int) -> int:
    """Smallest number of agreeing blocks for which unrelated fingerprints form
    groups of about GROUP_WANTED or fewer."""
    r = 1
    while r < 4 and n > GROUP_WANTED * 2 ** (64 * r / (max_bits + r)):
        r += 1
    return r


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): edges whose components are those of all pairs within ``max_bits``
    of the distinct fingerprints in column fp."""
    spark = distinct.sparkSession
    masks = block_masks(max_bits, shared_blocks(distinct.count(), max_bits))
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m).cast("long").alias("m"))
                                 for i, m in enumerate(masks)]))
    grouped = distinct.select("fp", choice.alias("x")).select(
        F.xxhash64("x.c", F.col("fp").bitwiseAND(F.col("x.m"))).alias("g"), "fp")
    sizes = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("mine")))
    dealt = (grouped.join(sizes, "g").withColumn("chunks", chunks).withColumn("mine", mine)
             .select("g", "fp", "mine", F.explode(others).alias("other"))
             .select(F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), "fp"))
    return (dealt.repartition(shuffle_partitions(spark), "block")
            .sortWithinPartitions("block", gray_rank(F.col("fp")))
            .mapInArrow(_link_blocks(max_bits), "a long, b long"))


def _reached(docs: DataFrame, text: str, doc_id: str, shingle: int, max_bits: int) -> DataFrame:
    """id, text_hash, fp and component_id of every row of ``docs``."""
    prints = checkpoint(fingerprints(docs, text, doc_id, shingle))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("min_id")))
    found = checkpoint(components(links(distinct.select("fp"), max_bits)))
    ids = found.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("min_id").alias("linked_id"))
    linked = found.join(ids, "root").select(F.col("node").alias("fp"), "linked_id", F.lit(True).alias("linked"))
    reached = checkpoint(distinct.join(linked, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("linked_id")).otherwise(F.col("min_id")).alias("component_id")))
    return prints.join(reached, "fp")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4,
                   max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id
    (smallest id that links reach, itself included)."""
    return _reached(docs, text, doc_id, shingle, max_bits).select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4,
               max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that bear the smallest id of their component, so that every
    component keeps a row. A row is judged by its id and text: of two texts with one id
    each is kept or not by its own component. Rows without an id stay."""
    gone = checkpoint(_reached(docs, text, doc_id, shingle, max_bits).filter(F.col("id") != F.col("component_id"))
                      .select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct())
    rows = docs.select(as_row(docs)).withColumn("_hash", F.xxhash64(text_or_empty(f"row.`{text}`")))
    same = (F.col(f"row.`{doc_id}`") == F.col("gone_id")) & (F.col("_hash") == F.col("gone_text"))
    return rows.join(gone, same, "left_anti").select("row.*")
