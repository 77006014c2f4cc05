"""Benchmark decontamination against a brute-force matcher and planted cases."""

import time
import unicodedata

from adflow.llm import decontam
from adflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def kind_of(c):
    k = unicodedata.category(c)
    return "L" if k[0] == "L" else "d" if k == "Nd" else " " if c in SPACE else "."


def brute_tokens(text):
    """[(sort, value)] by a scan over characters: sorts are w, #, u, n (name) and f (name at a
    sentence start). Number words are not known here; callers use texts without them."""
    text, out, i = text or "", [], 0
    lower_at = []  # (index in out, word) of capitalised words that are no names inside a sentence
    while i < len(text):
        k, j = kind_of(text[i]), i
        if k == "L":
            while j < len(text) and kind_of(text[j]) == "L":
                j += 1
            word, back = text[i:j], i
            while back and text[back - 1] in SPACE:
                back -= 1
            capital = len(word) > 1 and unicodedata.category(word[0]) == "Lu" and all(unicodedata.category(c) == "Ll" for c in word[1:])
            inside = back < i and back > 0 and (kind_of(text[back - 1]) in "Ld" or text[back - 1] in ",;")
            after_number = bool(out) and out[-1][0] == "#" and (
                (back == i and i > 0 and kind_of(text[i - 1]) == "d") or
                (text[back:i] in (" ", "  ") and kind_of(text[back - 1]) == "d" and word.lower() not in decontam.ATTACHED_ONLY))
            if after_number and word.lower() in decontam.UNITS:
                out.append(("u", word.lower()))
            elif capital and inside:
                out.append(("n", word.lower()))
            else:
                if capital:
                    lower_at.append(len(out))
                out.append(("w", word.lower()))
        elif k == "d":
            while j < len(text) and kind_of(text[j]) == "d":
                j += 1
            listed = i > 1 and text[i - 1] == "," and kind_of(text[i - 2]) == "d"
            value = text[i:j]

            def digits(at):
                end = at
                while end < len(text) and kind_of(text[end]) == "d":
                    end += 1
                return end

            groups, end = [], j
            while end < len(text) and text[end] == "," and digits(end + 1) - end - 1 == 3:
                groups.append(text[end + 1:end + 4])
                end += 4
            more = end < len(text) and text[end] == "," and digits(end + 1) > end + 1
            if groups and len(value) <= 3 and not listed and not more:
                value, j = value + "".join(groups), end
                decimal = True
            elif (not listed and not (i > 1 and text[i - 1] == "." and kind_of(text[i - 2]) == "d") and j < len(text) and text[j] == ","
                    and digits(j + 1) > j + 1 and not (digits(j + 1) < len(text) and text[digits(j + 1)] == ","
                                                       and digits(digits(j + 1) + 1) > digits(j + 1) + 1)):
                e = digits(j + 1)
                value, j, decimal = value + "." + text[j + 1:e], e, False
            else:
                decimal = True
            while decimal and j < len(text) and text[j] == "." and digits(j + 1) > j + 1:
                e = digits(j + 1)
                value, j = value + "." + text[j + 1:e], e
            if i and text[i - 1] in "-−" and not (i > 1 and (kind_of(text[i - 2]) in "Ld" or text[i - 2] in ")]")):
                value = "-" + value
            out.append(("#", value))
        else:
            j = i + 1
        i = j
    names = {v for s, v in out if s == "n"}
    for at in lower_at:
        if out[at][1] in names:
            out[at] = ("f", out[at][1])
    return out


def bare(token):
    return token[1].lstrip("-") if token[0] == "#" else token[1]


def readings(window, least):
    """The templates of a window, under each way to read names, that say something."""
    for shut in ("", "f", "nf"):
        cells = [("w", bare(t)) if t[0] == "w" or t[0] in shut else ("n" if t[0] == "f" else t[0], None) for t in window]
        plain = sum(c[0] == "w" for c in cells)
        if plain < len(window) and plain >= min(least, len(window)):
            yield shut, tuple(cells)


def longest(places):
    best = 0
    for p in places:
        n = 0
        while p + n in places:
            n += 1
        best = max(best, n)
    return best


def brute(docs, items, window=5, least=3, coverage=0.8, run=13):
    """{(doc, item, covered tokens, how)} by comparing every window with every window."""
    held = set()
    for item, body in items:
        theirs = brute_tokens(body)
        n, size = len(theirs), min(window, len(theirs))
        if not any(s in "wnf" for s, _ in theirs):
            continue
        says = [tuple(map(bare, theirs[p:p + size])) for p in range(n - size + 1)]
        reads = [dict(readings(theirs[p:p + size], least)) for p in range(n - size + 1)]
        whole = {tuple(map(bare, theirs[p:p + run])) for p in range(n - run + 1)}
        for d, text in docs:
            ours = brute_tokens(text)
            at_says, at_reads = {}, {}
            for q in range(len(ours) - size + 1):
                w = ours[q:q + size]
                at_says.setdefault(tuple(map(bare, w)), []).append(q)
                for _, t in readings(w, least):
                    at_reads.setdefault(t, set()).add(q)
            covered = {p + k for p, w in enumerate(says) if w in at_says for k in range(size)}
            same_run = any(tuple(map(bare, ours[q:q + run])) in whole for q in range(len(ours) - run + 1))
            if n and (len(covered) >= coverage * n or same_run):
                held.add((d, item, len(covered), "verbatim"))
                continue
            met = {}  # diagonal -> place -> readings that match there
            for p in range(n - size + 1):
                for q in at_says.get(says[p], ()):
                    met.setdefault(q - p, {}).setdefault(p, set()).add("exact")
                for shut, t in reads[p].items():
                    for q in at_reads.get(t, ()):
                        met.setdefault(q - p, {}).setdefault(p, set()).add(shut)
            if not any(how != {"exact"} for places in met.values() for how in places.values()):
                continue
            union, run_found = set(), False
            for offset, places in met.items():
                windows = []  # (place, {slot: what it stands for} by place in the window)
                for p, how in places.items():
                    for shut in how:
                        cells = {}
                        for k in range(p, p + size):
                            if theirs[k][0] != "w":
                                value = ("n" if theirs[k][0] == "f" else theirs[k][0], theirs[k][1])
                                same = shut == "exact" or theirs[k][0] in shut
                                mine = ours[k + offset]
                                cells[k] = (value, value if same else ("n" if mine[0] == "f" else mine[0], mine[1]) if mine[0] != "w" else None)
                        windows.append((p, cells))
                stands = {}
                for _, cells in windows:
                    for value, mine in cells.values():
                        if mine is not None:
                            stands.setdefault(value, set()).add(mine)
                torn = {v for v, s in stands.items() if len(s) > 1}
                good = {p + k for p, cells in windows if not any(v in torn and m is not None and m != v for v, m in cells.values())
                        for k in range(size)}
                union |= good
                run_found = run_found or longest(good) >= run
            if len(union) >= coverage * n or run_found:
                held.add((d, item, len(union), "template"))
    return held


def found(docs, items, **options):
    return {(r.doc_id, r.item_id, r.covered_tokens, r.how)
            for r in decontam.contaminations(docs, items, **options).collect()}


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [d for d in docs if len(d[1]) < 6000]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.covered_tokens, r.how) for r in QUERIES["op3_decontamination"](spark, SF).collect()}
    ids = {d[0] for d in docs}
    assert {g for g in got if g[0] in ids} == brute(docs, items) and got


PLANTED = ["A farmer in the valley sold 12 apples to Maria and 12 pears to Tom for 5 kg of corn.",
           "Maria met Tom at the old bridge, and Tom gave Maria 3,500 coins of 2.5 g each; Maria left",
           "sum 1, 2 and 3 with 4 or 5 then ask Bob whether Bob agrees with the sum of it"]


def test_planted_changes_match_brute_force(spark):
    """Copies with other values, cases, spacing and cuts, each held or not as the matcher says."""
    changes = [str, str.lower, str.upper, str.title, lambda x: x.replace(" ", "  "), lambda x: x.replace("12", "90"),
               lambda x: x.replace("12", "90", 1), lambda x: x.replace("Maria", "Anna"), lambda x: x.replace("Tom", "Bob"),
               lambda x: x.replace("Maria", "Anna", 1).replace("5", "7"), lambda x: x[:len(x) // 2], lambda x: x[len(x) // 3:],
               lambda x: x.replace("Tom", "Bob").replace("Maria", "Anna").replace("3,500", "-1,250.5"), lambda x: x.replace("old", "new"),
               lambda x: x.lower().replace("12", "31"), lambda x: x.title().replace("12", "31").replace("2.5 g", "3 g")]
    docs = [(k, f"{pre}{f(x)}{post}") for k, (f, x, pre, post) in enumerate(
        (f, x, pre, post) for f in changes for x in PLANTED for pre, post in (("", ""), ("Some other words. ", " And Tom 9 kg.")))]
    items = list(enumerate(PLANTED))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert found(d, b) == want and {"verbatim", "template"} == {h for *_, h in want}


ITEMS = [(1, "A farmer in the valley sold 12 apples to Maria and 12 pears to Tom for 5 kg of corn."),
         (2, "why so"), (3, None), (4, "123 456"), (5, "the same words come again and the same words come again")]


def test_reparameterised_questions(spark):
    docs = [
        (1, "x y z. A farmer in the valley sold 90 apples to Anna and 90 pears to Bob for 7 lb of corn. More."),
        (2, "A farmer in the valley sold 90 apples to Anna and 91 pears to Bob for 7 lb of corn."),  # 12 is 90 and 91
        (3, "A FARMER!! in*** the valley,,, sold 12 apples to Maria and 12 pears to Tom for 5kg of corn"),
        (4, "A farmer in the valley sold many apples to people and pears to others for corn."),
        (5, "tell me why so it is"), (6, None), (7, ""), (8, "123 456"), (None, "why so"), (9, "why so " * 20_000),
        (10, "the same words come again and the same words come again")]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.contaminations(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert {(1, 1), (3, 1), (5, 2), (None, 2), (9, 2), (10, 5)} == got
    changed = {(r.doc_id, r.item_id): r.changed_slots for r in rows}
    assert changed[(1, 1)] == 6 and changed[(3, 1)] == 0
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7, 8]


def test_words_of_other_languages_are_no_numbers(spark):
    """Spanish "once" and German "elf" are words in English; "in" after a number is no inch."""
    texts = ["She once met the elf in the new house", "They had 5 in the house and it is null or mil", "Sie hat elf Birnen und die Elf ist da",
             "ella tiene once peras y una casa", "12345678901,5 kg"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(decontam.tokens(decontam.F.col("t")).alias("x"))
    got = [[x.replace("\x0e", ".") for x in r.x] for r in df.collect()]
    assert got[0] == "she once met the elf in the new house".split()
    assert got[1] == ["they", "had", "\x015", "in", "the", "house", "and", "it", "is", "null", "or", "mil"]
    assert "\x0111" in got[2] and "\x0111" in got[3] and got[4] == ["\x0112345678901.5", "\x02kg"]


def test_repetitive_text_against_a_repetitive_item(spark):
    """Time follows the text, not its occurrences times those of the item."""
    items = spark.createDataFrame([(1, "a b " * 100), (2, "q " * 60 + "r " * 60)], "item_id long, text string")
    short = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    decontam.contaminations(short, items).collect()
    began = time.monotonic()
    decontam.contaminations(short, items).collect()
    base = time.monotonic() - began
    docs = spark.createDataFrame([(1, "a b " * 10_000), (2, "q " * 20_000)], "doc_id long, text string")
    began = time.monotonic()
    assert {(r.doc_id, r.item_id) for r in decontam.contaminations(docs, items).collect()} == {(1, 1), (2, 2)}
    assert time.monotonic() - began < 3 * base + 10


def test_many_names_at_sentence_starts(spark):
    """Thousands of different names in one text are looked up by bucket."""
    words = ["N" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(4000)]
    text = " ".join(f"and {w} went. {w} came." for w in words)
    df = spark.createDataFrame([(text,)], "t string").select(decontam.tokens(decontam.F.col("t")).alias("x"))
    got = df.first().x
    assert sum(x.startswith(decontam.FIRST) for x in got) == 4000 == sum(x.startswith(decontam.NAME) for x in got)


def test_repeated_rows_ids_and_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = spark.createDataFrame([(1, "oh why so"), (1, "oh why so"), (1, "clean text here"), (2, "clean")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminations(d, b).collect()] == [(1, 2)]
    assert sorted(map(tuple, decontam.decontaminate(d, b).collect())) == [(1, "clean text here"), (2, "clean")]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some text of a few words")], "doc_id long, text string")
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contaminations(d, full).collect() == [] and decontam.contaminations(one, b).collect() == []
    assert decontam.decontaminate(one, b).count() == 1
