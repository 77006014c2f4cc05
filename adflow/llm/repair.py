r"""Conversation structure repair by a Viterbi search that forgets what is settled.

A repaired conversation has role initials ``(s?(ua)+)?``. Four states say what has been
written: nothing, s, a u that waits for its a, and a complete pair. Keep costs 0, Rerole
to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert of
an empty turn 3; a truncated row that stays adds 3. Of the cheapest edit sequences the
one whose initials (D, I, K, R) are ASCII-least is taken.

Survivor coalescence: every state keeps the best edit sequence that ends in it, as a leaf
of a tree of back pointers. A node counts its references (children, or being a survivor);
at zero it goes, and its parent loses one. As soon as all survivors descend from one
child of the root, that child's edit is settled: it is emitted and becomes the root. What
a task holds is therefore the unsettled part alone, not the conversation. A survivor that
costs more than another one that can do the same from its own state is dropped.

Ties: sequences of equal cost are compared over their whole unsettled suffixes. That needs
no walk: two survivors after the same row never are prefixes of each other, so their order
stays what it was when they parted, and each survivor carries its rank in that order. A
new edit is compared by (cost, rank of the survivor, letters added).

Scale: rows are shuffled once, by conversation, and sorted by Spark (which spills);
duplicates are found by a window on the same partitioning. A task reads its conversations
as a stream. The digest of a conversation and its edits are one value, so a conversation
is the unit that cannot be split.

Defined results: null roles and texts are one space (so a null text is blank and a null
role has to be changed or deleted). Rows are ordered by turn (nulls first), then role and
text, so that ties and repeated rows have one order; a repeated row is a duplicate. A null
conversation id is a conversation of its own. Very long texts stay in memory only while
their row is unsettled. A conversation without rows gives zeros, an empty audit and the
digest of the empty text. An empty table gives an empty result. Columns are taken by name
into fresh ones, so that other columns of the input cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

BLANKS = " \t\n\x0b\x0c\r"
RENAME, DROP, INSERT, CUT_SHORT = 3, 4, 3, 3
#: What has been written: nothing, s, a u without its a, complete pairs.
NOTHING, SYSTEM, OPEN, PAIRS = range(4)
#: The role that Rerole and Insert write in a state, and the state after it.
NEXT_ROLE = {NOTHING: "user", SYSTEM: "user", OPEN: "assistant", PAIRS: "user"}
AFTER = {NOTHING: OPEN, SYSTEM: OPEN, OPEN: PAIRS, PAIRS: OPEN}
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: OPEN, SYSTEM: OPEN, PAIRS: OPEN}, "a": {OPEN: PAIRS}}
#: MIMIC[r][q]: what it costs state r at most to end like state q, whatever comes. Pairs
#: deletes an s that nothing keeps (4), s alone needs a pair at the end (6), one insert
#: leads from a waiting u to pairs and back (3).
MIMIC = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))


def _moves(initial: str, delete_only: bool, cut_short: bool) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letters) of one row: up to two inserts, then its edit;
    for two states the cheapest, then ASCII-least letters."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state = start
        for inserts in range(3):
            options = [(state, DROP, "D")]
            if not delete_only:
                extra = CUT_SHORT if cut_short else 0
                options.append((AFTER[state], RENAME + extra, "R"))
                if state in KEPT.get(initial, {}):
                    options.append((KEPT[initial][state], extra, "K"))
            for end, cost, letter in options:
                found = (INSERT * inserts + cost, "I" * inserts + letter)
                best[start, end] = min(found, best.get((start, end), found))
            state = AFTER[state]
    return [(a, b, cost, letters) for (a, b), (cost, letters) in best.items()]


#: What ends a conversation in each state.
_ENDS = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), OPEN: (INSERT, "I"), PAIRS: (0, "")}


class _Node:
    __slots__ = ("letter", "role", "text", "parent", "kids")

    def __init__(self, letter, role, text, parent):
        self.letter, self.role, self.text, self.parent, self.kids = letter, role, text, parent, []


class Repairer:
    """The search over one conversation. ``add`` takes its rows in order, ``finish`` returns
    the cost; ``emit(letter, role, text)`` gets the settled edits in order."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None]):
        self.emit, self.moves = emit, {}
        self.restart()

    def restart(self) -> None:
        self.root = _Node("", None, None, None)
        # state -> (cost, rank, leaf)
        self.survivors = {NOTHING: (0, 0, self.root)}

    def _grow(self, leaf: _Node, state: int, letters: str, role: str, text: str) -> _Node:
        for letter in letters:
            if letter == "I":
                new, state = _Node("I", NEXT_ROLE[state], "", leaf), AFTER[state]
            elif letter == "D":
                new = _Node("D", None, None, leaf)
            else:
                new = _Node(letter, role if letter == "K" else NEXT_ROLE[state], text, leaf)
            leaf.kids.append(new)
            leaf = new
        return leaf

    def _prune(self, leaf: _Node) -> None:
        while leaf is not self.root and not leaf.kids:
            leaf.parent.kids.remove(leaf)
            leaf = leaf.parent

    def _settle(self) -> None:
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.emit(self.root.letter, self.root.role, self.root.text)

    def add(self, role: str, text: str, delete_only: bool, cut_short: bool) -> None:
        initial = role[:1] if role[:1] in KEPT else ""
        key = (initial, delete_only, cut_short)
        moves = self.moves.get(key)
        if moves is None:
            moves = self.moves[key] = _moves(*key)
        old, best = self.survivors, {}
        for start, end, cost, letters in moves:
            if start in old:
                found = (old[start][0] + cost, old[start][1], letters, start)
                if end not in best or found < best[end]:
                    best[end] = found
        kept = {q: b for q, b in best.items() if all(c[0] + MIMIC[r][q] >= b[0] for r, c in best.items())}
        order = sorted(kept, key=lambda q: kept[q][1:3])
        self.survivors = {q: (kept[q][0], rank, self._grow(old[kept[q][3]][2], kept[q][3], kept[q][2], role, text))
                          for rank, q in enumerate(order)}
        for _, _, leaf in old.values():
            self._prune(leaf)
        self._settle()

    def finish(self) -> int:
        cost, _, letters, state = min((c + _ENDS[q][0], rank, _ENDS[q][1], q) for q, (c, rank, _) in self.survivors.items())
        last = self._grow(self.survivors[state][2], state, letters, "", "")
        for q, (_, _, leaf) in self.survivors.items():
            if q != state:
                self._prune(leaf)
        self._settle()
        assert self.root is last
        self.restart()
        return cost

    def unsettled(self) -> int:
        """Nodes held."""
        count, todo = 0, [self.root]
        while todo:
            todo.extend(todo.pop().kids)
            count += 1
        return count - 1


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """The test damage of ``turns``: conv, turn, role, text, alive. By crc32 of "conv:turn"
    modulo 20 a row is dropped (0: alive is false, so that its conversation is still known),
    emptied (1), loses its sentence marks (2), is repeated (3) or becomes a user's (4)."""
    def said(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn))) % 20
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"),
                        said(text).alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    body = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       body.alias("text"), (F.col("kind") != 0).alias("alive"), copies.alias("copy")).drop("copy")


def conversation_rows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """Undamaged input for the repair: conv, turn, role, text, alive."""
    def said(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    return turns.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"),
                        said(text).alias("text"), F.lit(True).alias("alive"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, each conversation in one partition, with
    fault: blank, duplicate, truncated or null."""
    same = Window.partitionBy("conv", "alive", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(body == "", "blank").when(F.col("nth") > 1, "duplicate")
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated"))
    return (rows.repartition("conv").withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)
            .sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth")
            .select("conv", "turn", "role", "text", "alive", "fault"))


class _Audit:
    """What is counted and collected of one conversation."""

    def __init__(self, conv):
        self.conv, self.letters, self.sha, self.lines = conv, [], hashlib.sha256(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.last_turn = self.last_initial = None
        self.turns = self.illegal = 0

    def edit(self, letter, role, text) -> None:
        self.letters.append(letter)
        if role is not None:
            self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def row(self, turn, role, fault) -> None:
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        initial = role[:1]
        self.illegal += self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial

    def result(self, cost: int) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, cost, "".join(self.letters), self.sha.hexdigest())


def _conversations(batches: Iterator, begin, on_row, on_end, repairer: Repairer) -> Iterator:
    """Feeds sorted rows to the repairer; yields after every slice so that output can flow."""
    open_, conv = False, None
    for batch in (part for whole in batches for part in slices(whole, 1 << 20)):
        for c, turn, role, text, alive, fault in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if not open_ or c != conv:
                if open_:
                    on_end(repairer.finish())
                open_, conv = True, c
                begin(c)
            if alive:
                on_row(turn, role, fault)
                repairer.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        yield
    if open_:
        on_end(repairer.finish())
        yield


def _audit_task(schema_of):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema, done, now = schema_of(), [], [None]

        def begin(conv):
            now[0] = _Audit(conv)

        def edit(letter, role, text):
            now[0].edit(letter, role, text)

        def end(cost):
            done.append(now[0].result(cost))

        for _ in _conversations(batches, begin, lambda *r: now[0].row(*r), end, Repairer(edit)):
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)],
                                                 schema=schema)
                done.clear()

    return run


def _edit_task(schema_of):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema, done, state = schema_of(), [], {"conv": None, "n": 0}

        def begin(conv):
            state.update(conv=conv, n=0)

        def edit(letter, role, text):
            done.append((state["conv"], state["n"], letter, role, text))
            state["n"] += 1

        for _ in _conversations(batches, begin, lambda *r: None, lambda cost: None, Repairer(edit)):
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)],
                                                 schema=schema)
                done.clear()

    return run


def _arrow(schema: T.StructType):
    def build():
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema)

    return build


def audits(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation of ``rows`` (from ``damaged`` or ``conversation_rows``): gaps,
    blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    schema = T.StructType([T.StructField(conv_id, rows.schema["conv"].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return with_faults(rows).mapInArrow(_audit_task(_arrow(schema)), schema)


def edits(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per edit: conversation, nth, edit (K, R, D or I), role and text after it (null if deleted)."""
    schema = T.StructType([T.StructField(conv_id, rows.schema["conv"].dataType), T.StructField("nth", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])
    return with_faults(rows).mapInArrow(_edit_task(_arrow(schema)), schema)


def repaired(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """The repaired turns: conversation, turn (gapless from 0), role and text."""
    kept = edits(rows, conv_id).filter(F.col("edit") != "D")
    order = Window.partitionBy(conv_id).orderBy("nth")
    return kept.select(conv_id, (F.row_number().over(order) - 1).cast("long").alias("turn"), "role", "text")
