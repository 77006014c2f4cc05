"""Structure repair against a search over whole edit strings, and the memory it holds."""

import hashlib
import random
import re
import zlib

import pytest

from adflow.llm import repair
from adflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        k = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_edits(rows):
    """(cost, audit, repaired rows): the cheapest and then least audit of each (row, state) by
    relaxing whole strings until nothing changes."""
    states = ("", "s", "u", "p")
    step = {("", "u"): "u", ("s", "u"): "u", ("p", "u"): "u", ("u", "a"): "p", ("", "s"): "s"}
    best = {"": (0, "", ())}

    def inserted(best):
        changed = True
        while changed:
            changed = False
            for q in states:
                if q in best:
                    c, a, out = best[q]
                    role = "assistant" if q == "u" else "user"
                    new = (c + 3, a + "I", (*out, (role, "")))
                    to = step[q, role[0]]
                    if to not in best or new[:2] < best[to][:2]:
                        best[to], changed = new, True
        return best

    for role, text, fault in rows:
        found = {}
        extra = 3 if fault == "truncated" else 0
        for q, (c, a, out) in inserted(best).items():
            options = [(q, (c + 4, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                if (q, role[:1]) in step:
                    options.append((step[q, role[:1]], (c + extra, a + "K", (*out, (role, text)))))
                new = "assistant" if q == "u" else "user"
                options.append((step[q, new[0]], (c + 3 + extra, a + "R", (*out, (new, text)))))
            for to, o in options:
                if to not in found or o[:2] < found[to][:2]:
                    found[to] = o
        best = found
    return min(v for q, v in inserted(best).items() if q in ("", "p"))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in brute_damage(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faulty = set(), []
        for _, _, role, text in mine:
            body = text.strip(SPACE)
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                     "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, fixed = brute_edits(faulty)
        initials = [r[2][:1] for r in mine]
        count = [f for *_, f in faulty].count
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"),
                     count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_structure_repair"](spark, f"/root/testdata/{sf}")) == brute(rows)


def test_odd_rows_match_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " \t", "a.", "b!", "c", "d?\n", "e .x", "?"]
    rows = []
    for conv in [None, *range(-20, 200)]:
        for k in range(rng.choice([1, 2, 3, 8, 15, 30])):
            rows.append((conv, rng.choice([None, k, k, k, k // 2, k * 3]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "s", "Ux"]), rng.choice(texts)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, alive int").repartition(5)
    want = brute(rows)
    got = found(repair.audits(repair.damaged(df)))
    assert got == want
    # The repaired turns say what the digest says, and their roles alternate.
    said = {}
    for r in sorted(repair.repaired(repair.damaged(df)).collect(), key=lambda r: r.turn):
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, values in want.items():
        lines = said.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest() == values[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))


def test_undamaged_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 5, "assistant", "x."), (3, None, "system", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {k: (v[5], v[6]) for k, v in found(repair.audits(repair.conversation_rows(df))).items()}
    assert got == {1: (0, "KKK"), 2: (3, "IK"), 3: (4, "D")}


def test_memory_is_the_unsettled_part():
    edits = []
    r = repair.Repairer(lambda letter, role, text: edits.append(letter))
    rng, most = random.Random(1), 0
    for k in range(20_000):
        r.add("user" if (k % 2 == 0) != (rng.random() < 0.1) else "assistant", "t.", rng.random() < 0.05, rng.random() < 0.1)
        most = max(most, r.unsettled())
    r.finish()
    assert most < 500 and sum(x != "I" for x in edits) == 20_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audits(repair.damaged(df)).collect() == [] and repair.repaired(repair.conversation_rows(df)).collect() == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert found(repair.audits(repair.damaged(df))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
