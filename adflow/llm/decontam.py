r"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

1. Canonical form. One pass of a pattern cuts a text into tokens: lower-cased runs of
   letters, and typed placeholders with the value they stand for. A number is one token
   with its sign, separators and decimals; a unit word after a number is a unit; a
   capitalised word inside a sentence is a name, at a sentence start too if the text has
   it as a name elsewhere. A number word ("twenty-five" and "two hundred" are one) counts
   only if it belongs to the language of the text, which is the one of English, German,
   French and Spanish with the most function words in it. "Anna has 5 kg" and "Anna has
   7 lb" have one template.
2. Hash join. Windows of ``window`` tokens are hashed by their words and values and, where
   they hold placeholders, as templates without the values, and joined with the windows
   of the benchmark on the hash. Templates need ``least_words`` plain words. Case decides
   what a name is, so templates are also hashed with the names at sentence starts, and
   with all names, as words. The hash of values knows no case or sign.
3. Verbatim. Distinct windows that agree in words and values cover tokens of the item, and
   a window that agrees over ``run`` tokens is a run of that length. An item that is
   held by these alone is decided here, whatever the number of its occurrences.
4. Slot consistency. Other items go on only if their windows of all kinds could reach the
   limits. Matching windows of one document and item with one offset form a diagonal.
   Along it every benchmark value must stand for one value of the document: a question
   with other numbers or names fits, a chance meeting of templates does not. Where a
   value stands for several, the windows that change it are dropped; windows without it,
   or with it as it is, stay on the diagonal.
5. A document holds an item if consistent windows cover at least ``coverage`` of the
   item's tokens, or ``run`` tokens in a row.

Items shorter than the window are matched by one window of their own length.

Scale: canonical texts are written once, about as large as the texts, and cut into windows
where they are read; texts never move. The hashes
of the benchmark (a fixed number of bytes each) are broadcast up to ``BROADCAST_WINDOWS``,
beyond it the join is shuffled on the hash. Only matching windows go further, first as
distinct windows of a document and item. Positions are looked up for documents and items
that step 4 needs, so a text that repeats a line of the benchmark costs its occurrences
once, not occurrences times occurrences.

Defined results: a null text counts as empty. A null item text, or one of numbers and
units alone, matches nothing. Rows are told apart by id and text hash, so repeated rows
are judged alike and reported once, and rows of one id with different texts are judged
each by its own. A null id is an id like any other. Ties between languages count for all
of them; a text without function words has no number words. Very long texts are cut in
time linear in their length (names at sentence starts: to the power 1.5 of the number of
different ones at worst); one text's windows have to fit into a task. Empty tables give
empty results; ``decontaminate`` returns exactly the columns it was given, and columns
are taken by name into fresh ones, so that none can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import checkpoint
from .common import as_row, text_or_empty

#: Marks in front of a placeholder's value.
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
#: The mark of a name at a sentence start.
FIRST = "\x04"
#: Every placeholder, and no word, sorts before this.
LAST_MARK = "\x05"
#: Decimal point, or joint of number words, and minus sign inside a number.
POINT, MINUS = "\x0e", "\x0f"
WHITE = " \t\n\x0b\x0c\r"
#: Unit words, recognised after a number.
UNITS = ("mm", "cm", "dm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "min", "h", "hr", "inch",
         "inches", "in", "ft", "feet", "yd", "mi", "mile", "miles", "oz", "lb", "lbs", "mph", "kmh", "hz", "w", "kw",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "gram", "grams",
         "kilogram", "kilograms", "liter", "liters", "litre", "litres", "dollar", "dollars", "euro", "euros", "cent",
         "cents", "percent", "degree", "degrees")
#: Units that are common words too: only where they follow the digits directly.
ATTACHED_ONLY = ("in", "mi", "s", "t", "l")
#: Fixed values by language (en, de, fr, es): number words and function words.
_SMALL = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
          "eighteen nineteen", "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn "
          "fünfzehn sechzehn siebzehn achtzehn neunzehn", "zéro _ deux trois quatre cinq six sept huit neuf dix onze douze "
          "treize quatorze quinze seize", "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece "
          "catorce quince dieciséis diecisiete dieciocho diecinueve")
_TENS = ("twenty thirty forty fifty sixty seventy eighty ninety", "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig "
         "neunzig", "vingt trente quarante cinquante soixante", "veinte treinta cuarenta cincuenta sesenta setenta ochenta "
         "noventa")
_SCALE = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "hundert": 100, "tausend": 1000, "mille": 1000,
          "cien": 100, "ciento": 100, "mil": 1000}
#: Number words of each language and their values; articles ("ein", "un", "une") are words.
_SCALES = [{w: v for w, v in _SCALE.items() if w in words} for words in (
    ("hundred", "thousand", "million", "billion"), ("hundert", "tausend"), ("mille",), ("cien", "ciento", "mil"))]
_TENS_OF = [{w: 20 + 10 * i for i, w in enumerate(words.split())} for words in _TENS]
NUMBER_WORDS = [{w: i for i, w in enumerate(words.split()) if w != "_"} | tens | scale
                for words, tens, scale in zip(_SMALL, _TENS_OF, _SCALES, strict=True)]
NUMBER_WORDS[1] |= {("ein" if unit == "eins" else unit) + "und" + ten: value + k
                    for ten, value in _TENS_OF[1].items() for k, unit in enumerate(_SMALL[1].split()[1:10], 1)}
VALUES = {w: v for words in reversed(NUMBER_WORDS) for w, v in words.items()}
FUNCTION_WORDS = tuple(words.split() for words in (
    "the of and a to in is has have was for on that with it as by from or how many what which are at",
    "der die das und ein eine ist hat von zu mit auf für den dem wie viele was nicht es im sich auch er sie",
    "le la les des et un une est a de du que pour dans en qui combien il elle sur avec au par ne pas",
    "el la los las de y un una es tiene que en por con para cuántos cuántas su del se al lo no más como"))
#: Keys of the benchmark that are broadcast: twelve bytes each.
BROADCAST_WINDOWS = 4_000_000
#: How a window was hashed: with its values, or as a template.
EXACT, ALL_NAMES, INNER_NAMES, NO_NAMES = range(4)
WINDOW, LEAST_WORDS, COVERAGE, RUN = 5, 3, 0.8, 13


def _any_of(words) -> str:
    """A pattern of these words, branching letter by letter, the longest first."""
    tails: dict[str, set[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], set()).add(w[1:])
    each = [c + _any_of(t) for c, t in sorted(tails.items())]
    whole = f"(?:{'|'.join(each)})" if each else ""
    return whole + "?" if whole and "" in words else whole



def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _listed(words) -> Column:
    """A constant array of words (folded by the optimizer)."""
    return F.split(F.lit(" ".join(sorted(words))), " ")


_UNIT_WORD = rf"(?i:{_any_of(UNITS)})(?!\p{{L}})"
_FREE_UNIT = rf"(?i:{_any_of([u for u in UNITS if u not in ATTACHED_ONLY])})(?!\p{{L}})"
#: One number: thousands with separators, a decimal comma outside a list, or digits and
#: points; with its sign, and with the MINUS or blanks behind it that lead to a unit.
_NUMBER = (r"(?=[-−\p{Nd}])(?:(?<![\p{L}\p{Nd})\]])[-−])?(?:(?<!\p{Nd},)\p{Nd}{1,3}(?:,\p{Nd}{3})++(?!\p{Nd}|,\p{Nd})(?:\.\p{Nd}++)*+"
           r"|(?<!\p{Nd}[.,])\p{Nd}++,\p{Nd}++(?!,\p{Nd})|\p{Nd}++(?:\.\p{Nd}++)*+)"
           rf"(?:{MINUS}|\x20{{1,2}}(?={_FREE_UNIT}))?")
#: White space before a capital, behind a letter, digit or comma: a name follows.
_INSIDE = r"(?=[\x20\x09-\x0D]++\p{Lu}\p{Ll})(?<=[\p{L}\p{Nd},;])[\x20\x09-\x0D]++"
#: Words, names with the white space before them, numbers.
_TOKEN = rf"\p{{L}}++(?:{POINT}\p{{L}}++)*+|{_INSIDE}\p{{Lu}}\p{{Ll}}++(?![\p{{L}}{POINT}])|{_NUMBER}"


def _languages(text: Column) -> Column:
    """array<boolean>: is it one of the languages that the text has most function words of?"""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}++"), F.lit(0))

    def most(counts: Column) -> Column:
        return F.transform(counts, lambda n: (n > 0) & (n == F.array_max(counts)))

    return _let(words, lambda w: _let(F.array(*[
        F.size(F.array_intersect(w, _listed(own))) for own in FUNCTION_WORDS]), most))


def _joined(text: Column, spoken: Column) -> Column:
    """The text with a POINT between number words that are one number."""
    for k, words in enumerate(NUMBER_WORDS):
        word, scale, left = (_any_of(set(x)) for x in (words, _SCALES[k], {**_TENS_OF[k], **_SCALES[k]}))
        gap = r"[\s-]++(?:(?:and|und|et|y)[\s-]++)?+"
        joint = (rf"(?iu)(?<!\p{{L}})(?:({left})(?={gap}{word}(?!\p{{L}}))|({word})(?=[\s-]++{scale}(?!\p{{L}}))){gap}")
        text = F.when(spoken[k], F.regexp_replace(text, joint, f"$1$2{POINT}")).otherwise(text)
    return text


def _member(words: Column) -> Column:
    """Buckets of a set of words, as many as the root of their number, so that a lookup
    reads one bucket."""
    n = F.greatest(F.lit(1), F.when(F.size(words) > 64, F.ceil(F.sqrt(F.size(words)))).otherwise(1)).cast("long")
    return _let(n, lambda m: F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda b: F.filter(
        words, lambda w: F.pmod(F.xxhash64(w), m) == b)))


def _has(buckets: Column, word: Column) -> Column:
    return F.array_contains(F.get(buckets, F.pmod(F.xxhash64(word), F.size(buckets).cast("long")).cast("int")), word)


def _number_value(token: Column) -> Column:
    """A number without separators; points and signs are marks, so that they stay in the token."""
    plain = F.translate(token, f".-−{MINUS} ", POINT + MINUS + MINUS)  # what leads to a unit goes
    thousands = plain.rlike(rf"^{MINUS}?\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})+(?!\p{{Nd}})")
    return F.when(~plain.contains(","), plain).when(thousands, F.replace(plain, F.lit(","), F.lit(""))).otherwise(
        F.replace(plain, F.lit(","), F.lit(POINT)))


def _classed(raw: Column, starts: Column, digits: bool, spoken: Column | None) -> Column:
    """Marked tokens of raw ones. ``starts`` are the buckets of the words that are names at
    sentence starts too."""

    def said(x: Column) -> Column:
        return F.when(x < "!", F.lower(F.ltrim(x, F.lit(WHITE)))).otherwise(F.lower(x))

    def marked(x: Column, i: Column) -> Column:
        plain = (x >= "a") & (x < "{")
        capital = (((x >= "A") & (x < "[")) | (x >= "\x80")) & _has(starts, F.lower(x)) & x.rlike(r"^\p{Lu}\p{Ll}+$")
        out = None

        def when(test: Column, value: Column) -> None:
            nonlocal out
            out = F.when(test, value) if out is None else out.when(test, value)

        if digits:
            before = F.get(raw, i - 1)
            when((i > 0) & (before.endswith(" ") | before.endswith(MINUS)), F.concat(F.lit(UNIT), said(x)))
            number = ((x >= "-") & (x < ":")) | ((x >= "\x80") & x.rlike(r"^[−\p{Nd}]"))
            when(number, F.concat(F.lit(NUMBER), _number_value(x)))
        if spoken is not None:
            joint = x.contains(POINT)
            when(joint, F.concat(F.lit(NUMBER), F.lower(x)))
            values = F.str_to_map(F.lit(" ".join(f"{w}={n}" for w, n in sorted(VALUES.items()))), F.lit(" "), F.lit("="))
            for k, words in enumerate(NUMBER_WORDS):
                when(spoken[k] & F.array_contains(_listed(words), said(x)), F.concat(F.lit(NUMBER), F.try_element_at(values, said(x))))
        when(plain, F.lower(x))
        return out.when(x < "!", F.concat(F.lit(NAME), said(x))).when(capital, F.concat(F.lit(FIRST), F.lower(x))).otherwise(F.lower(x))

    return F.transform(raw, marked)


def _starts(raw: Column) -> Column:
    """Buckets of the capitalised words that are names elsewhere in the text."""
    names = F.transform(F.filter(raw, lambda x: x < "!"), lambda x: F.lower(F.ltrim(x, F.lit(WHITE))))
    capitals = F.transform(F.filter(raw, lambda x: (((x >= "A") & (x < "[")) | (x >= "\x80")) & x.rlike(r"^\p{Lu}\p{Ll}+$")), F.lower)
    none = F.array(F.array().cast("array<string>"))
    return F.when(F.array_min(raw) < "!", _let(F.array_intersect(capitals, names), _member)).otherwise(none)


def _with_numbers(text: Column, spoken: Column | None) -> Column:
    """The canonical form of a text with digits or number words, token by token."""
    raw = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.array_join(_let(raw, lambda r: _let(_starts(r), lambda s: _classed(r, s, True, spoken))), " ")


def _plain(text: Column, kept: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{L}}{kept}]++", " "))


def _without_numbers(text: Column) -> Column:
    """The canonical form of any other text: a few passes over it, and token by token only
    where a name at a sentence start has to be told from a word."""

    def settled(marked: Column) -> Column:
        def words(mark: str) -> Callable[[Column], Column]:
            return lambda w: F.transform(F.filter(w, lambda x: x.startswith(mark)), _said)

        def some(w: Column) -> Column:
            both = F.array_intersect(words(FIRST)(w), words(NAME)(w))
            return _let(_let(both, _member), lambda m: F.array_join(F.transform(
                w, lambda x: F.when(x.startswith(FIRST) & ~_has(m, _said(x)), _said(x)).otherwise(x)), " "))

        return _let(F.split(marked, " "), some)

    def named(t: Column) -> Column:
        starts = F.regexp_replace(t, rf"(?<![\p{{L}}{NAME}])(\p{{Lu}}\p{{Ll}}++)(?!\p{{L}})", f" {FIRST}$1")
        return _let(_plain(starts, NAME + FIRST), settled)

    clean = F.replace(F.replace(text, F.lit(NAME), F.lit(" ")), F.lit(FIRST), F.lit(" "))
    inside = F.regexp_replace(clean, rf"{_INSIDE}(\p{{Lu}}\p{{Ll}}++)(?!\p{{L}})", f" {NAME}$1")
    return _let(inside, lambda t: F.when(t.contains(NAME), named(t)).otherwise(_plain(t, "")))


def canonical(text: Column) -> Column:
    """The tokens of a text between single blanks: words as they are, placeholders as a mark
    with their value behind it."""
    clean = F.replace(F.replace(text, F.lit(POINT), F.lit(" ")), F.lit(MINUS), F.lit(" "))
    digits = text.rlike(r"\p{Nd}")

    def attached(t: Column) -> Column:
        return F.regexp_replace(t, rf"(?<=\p{{Nd}})(?={_UNIT_WORD})", MINUS)

    def spoken(t: Column) -> Column:
        return _let(_languages(t), lambda k: _with_numbers(_joined(t, k), k))

    first = F.when(digits, _with_numbers(attached(clean), None)).otherwise(_without_numbers(text))
    marks = f"{NAME}{FIRST}"

    def checked(form: Column) -> Column:
        bare = F.when(form.contains(NAME) | form.contains(FIRST), F.translate(form, marks, "")).otherwise(form)
        words = F.arrays_overlap(F.split(bare, " "), _listed(VALUES))
        return F.when(words, spoken(F.when(digits, attached(clean)).otherwise(clean))).otherwise(form)

    return _let(first, checked)


def tokens(text: Column) -> Column:
    """array<string>: the tokens of the canonical form."""
    return _let(canonical(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def _said(token: Column) -> Column:
    """A placeholder without its mark."""
    return F.substring(token, 2, 1 << 30)


def _is_slot(token: Column) -> Column:
    return token < LAST_MARK


#: What sorts before this is a placeholder in templates of a kind.
_OPEN_BELOW = {ALL_NAMES: LAST_MARK, INNER_NAMES: FIRST, NO_NAMES: NAME}


def _slot(token: Column) -> Column:
    """A placeholder with one mark for all names, null for a word."""
    return F.when(token.startswith(FIRST), F.concat(F.lit(NAME), _said(token))).when(_is_slot(token), token)


def _marked(text: Column) -> Column:
    return text.contains(NUMBER) | text.contains(UNIT) | text.contains(NAME) | text.contains(FIRST)


def _bare(token: Column) -> Column:
    """What a token says, without mark and sign."""
    return F.when(_is_slot(token), F.translate(_said(token), MINUS, "")).otherwise(token)


def _shifted(array: Column, offsets: list[int]) -> Column:
    """array<struct<0, 1, ...>>: at each place, what stands there and at the offsets behind it;
    null behind the end."""
    return _let(array, lambda a: F.arrays_zip(*[F.slice(a, o + 1, 1 << 30) for o in offsets]))


def _exact_windows(forms: DataFrame, keys: list[str], size: int, window: int, run: int) -> DataFrame:
    """Every window of ``size`` tokens by its words and values: keys, at, size, kind, hash, long
    (hash of ``run`` tokens from there on, made of those of its windows; null where the
    text ends before, and for other sizes than ``window``) and held (null)."""
    words = F.split("form", " ")
    words = F.when(_marked(F.col("form")), F.transform(words, _bare)).otherwise(words)
    grams = F.transform(_shifted(words, list(range(size))), lambda x: F.when(
        x[str(size - 1)].isNotNull(), F.xxhash64(*[x[str(k)] for k in range(size)])))
    offsets = [*range(0, max(run - window, 0), window), max(run - window, 0)] if size == window else [0]
    # An outer generator: no filter is inferred from it that would make its input again.
    rows = forms.select(*keys, F.posexplode_outer(_shifted(grams, offsets)).alias("pos", "x"))
    parts = [F.col("x")[str(k)] for k in range(len(offsets))]
    long = F.when(parts[-1].isNotNull(), F.xxhash64(*parts)) if size == window else F.lit(None).cast("long")
    return rows.select(*keys, (F.col("pos") + 1).alias("at"), F.lit(size).alias("size"), F.lit(EXACT).alias("kind"),
                       parts[0].alias("hash"), long.alias("long"), F.lit(None).cast("string").alias("held")).filter("hash IS NOT NULL")


def _typed_windows(forms: DataFrame, keys: list[str], size: int, least_words: int) -> DataFrame:
    """The windows with placeholders as templates of each kind that says something of its own;
    held are their tokens. Only texts with placeholders are cut."""
    words = _shifted(F.split("form", " "), list(range(size)))
    rows = forms.filter(_marked(F.col("form"))).select(*keys, F.posexplode_outer(words).alias("pos", "x"))
    tokens_ = [F.col("x")[str(k)] for k in range(size)]
    some = tokens_[0] < LAST_MARK
    for t in tokens_[1:]:
        some = some | (t < LAST_MARK)
    rows = rows.filter(tokens_[-1].isNotNull() & some)

    def count(test: Callable[[Column], Column]) -> Column:
        return sum((F.when(test(t), 1).otherwise(0) for t in tokens_), F.lit(0))

    def template(kind: int) -> Column:
        cells = [F.when(t < _OPEN_BELOW[kind], F.when(t < FIRST, F.substring(t, 1, 1)).otherwise(NAME))
                 .when(_is_slot(t), _said(t)).otherwise(t) for t in tokens_]
        test = count(lambda t: t < _OPEN_BELOW[kind]).between(1, size - min(least_words, size))
        if kind != ALL_NAMES:  # else it says what another kind says
            test = test & (count(lambda t: (t >= _OPEN_BELOW[kind]) & _is_slot(t)) > 0)
        return F.when(test, F.struct(F.lit(kind).alias("kind"), F.xxhash64(*cells).alias("hash")))

    rows = rows.select(*keys, (F.col("pos") + 1).alias("at"), F.concat_ws(" ", *tokens_).alias("held"),
                       F.explode_outer(F.array(*[template(k) for k in _OPEN_BELOW])).alias("t"))
    return rows.filter("t IS NOT NULL").select(*keys, "at", F.lit(size).alias("size"), "t.kind", "t.hash",
                                               F.lit(None).cast("long").alias("long"), "held")


def _cut_windows(forms: DataFrame, keys: list[str], sizes: list[int], window: int, least_words: int, run: int) -> DataFrame:
    """Windows of ``forms`` (keys and ``form``, a canonical text that has been written)."""
    parts = [_exact_windows(forms, keys, s, window, run) for s in sizes] + [_typed_windows(forms, keys, s, least_words) for s in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
                      least_words: int = LEAST_WORDS, run: int = RUN) -> DataFrame:
    """item, n (tokens of the item), place (position), size, kind, hash, long and tokens (of the
    window) of every window: one row by its words and values, one for every kind of
    template that says something of its own."""
    items = checkpoint(benchmark.select(F.col(f"`{item_id}`").alias("item"), canonical(text_or_empty(f"`{text}`")).alias("form")))
    # Numbers and units alone are no item.
    items = items.filter(F.exists(F.split("form", " "), lambda x: x >= NAME)).withColumn(
        "n", F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1)
    items = items.withColumn("whole", F.col("form"))
    items = items.withColumn("size", F.least(F.lit(window), F.col("n")))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [window]  # at most ``window`` numbers
    rows = _cut_windows(items.drop("size"), ["item", "n", "whole"], sizes, window, least_words, run)
    words = F.slice(F.split("whole", " "), F.col("at"), F.col("size"))
    return rows.filter(F.col("size") == F.least(F.lit(window), F.col("n"))).select(
        "item", "n", F.col("at").alias("place"), "size", "kind", "hash", "long", words.alias("tokens"))


def _row_hash(text: str) -> Column:
    return F.xxhash64(text_or_empty(f"`{text}`"))


def _found_windows(docs: DataFrame, windows: DataFrame, text: str, doc_id: str, window: int, least_words: int,
                   run: int) -> DataFrame:
    """The windows of the documents that occur in the benchmark: id, row_hash, size, at, hash,
    long, held."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [window]  # at most ``window`` numbers
    keys = windows.select("size", "hash").distinct()
    hint = F.broadcast if keys.count() <= BROADCAST_WINDOWS else (lambda df: df)
    forms = checkpoint(docs.select(F.col(f"`{doc_id}`").alias("id"), _row_hash(text).alias("row_hash"),
                                   canonical(text_or_empty(f"`{text}`")).alias("form")))
    seen = _cut_windows(forms, ["id", "row_hash"], sizes, window, least_words, run).drop("kind")
    return checkpoint(seen.join(hint(keys), ["size", "hash"]))


_PAIR = ["id", "row_hash", "item", "n"]


def _covered(starts: str, size: str) -> Column:
    """The distinct places (sorted) of windows of one size at these starts."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + F.col(size) - 1)))))


def _longest_run(places: Column) -> Column:
    """The longest run of consecutive numbers in a sorted array (of an item's places)."""
    first = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, p: Column) -> Column:
        run = F.when(p == a["last"] + 1, a["run"] + 1).otherwise(1)
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(places, first, step, lambda a: a["best"])


def _verbatim(found: DataFrame, windows: DataFrame) -> DataFrame:
    """id, row_hash, item, n, size, starts (places where windows agree in words and values)
    and whole_run (does one agree over the run?)."""
    ours = found.filter("held IS NULL").select("id", "row_hash", "size", "hash", "long").distinct()
    theirs = windows.filter(F.col("kind") == EXACT).select("size", "hash", "item", "n", "place", F.col("long").alias("item_long"))
    return (ours.join(theirs, ["size", "hash"]).groupBy(*_PAIR, "size")
            .agg(F.collect_set("place").alias("starts"),  # at most the item's tokens
                 F.max(F.coalesce(F.col("long") == F.col("item_long"), F.lit(False))).alias("whole_run")))


def _reachable(found: DataFrame, windows: DataFrame, exact: DataFrame, coverage: float, run: int) -> DataFrame:
    """id, row_hash, item of pairs that templates could still decide: all their windows
    together reach the coverage or a run."""
    ours = found.filter("held IS NOT NULL").select("id", "row_hash", "size", "hash").distinct()
    theirs = windows.filter(F.col("kind") != EXACT).select("size", "hash", "item", "n", "place").distinct()
    some = (ours.join(theirs, ["size", "hash"]).groupBy(*_PAIR, "size").agg(F.collect_set("place").alias("more")))
    same = [some[c].eqNullSafe(exact[c]) for c in _PAIR]
    both = some.join(exact, same[0] & same[1] & same[2] & same[3], "left").select(
        *[some[c] for c in [*_PAIR, "size", "more"]], "starts", "held")
    both = both.filter(~F.coalesce("held", F.lit(False))).withColumn(
        "starts", F.array_union("more", F.coalesce("starts", F.array().cast("array<int>"))))
    places = both.withColumn("places", _covered("starts", "size"))
    return places.filter((F.size("places") >= F.lit(coverage) * F.col("n")) | (_longest_run(F.col("places")) >= run)).select(
        "id", "row_hash", "item")


def _consistent(found: DataFrame, windows: DataFrame, pairs: DataFrame, coverage: float, run: int) -> DataFrame:
    """The pairs that consistent windows hold: id, row_hash, item, n, covered_tokens, changed_slots."""
    diagonal = ["id", "row_hash", "item", "offset"]
    kind = F.col("kind")

    def cell(x: Column, k: Column) -> Column:
        theirs = _slot(x["tokens"])
        fixed = ((kind == EXACT) | ((kind == INNER_NAMES) & x["tokens"].startswith(FIRST))
                 | ((kind == NO_NAMES) & (x["tokens"] >= NAME)))  # told by the hash itself
        return F.struct((F.col("place") + k).alias("p"), theirs.alias("theirs"),
                        F.when(fixed, theirs).otherwise(_slot(x["held"])).alias("ours"))

    asked = pairs.select(F.col("id").alias("_id"), F.col("row_hash").alias("_row"), F.col("item").alias("_item"))
    ours = found.drop("long").join(asked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_row")))
    theirs = windows.select("item", "n", "place", "size", "kind", "hash", "tokens")
    met = (ours.join(theirs, (ours["size"] == theirs["size"]) & (ours["hash"] == theirs["hash"])
                     & F.col("_item").eqNullSafe(F.col("item")))
           .select("id", "row_hash", "item", "n", (F.col("at") - F.col("place")).alias("offset"), "place",
                   F.transform(F.arrays_zip("tokens", F.coalesce(F.split("held", " "), "tokens").alias("held")), cell).alias("cs")))
    clash = (met.filter(F.exists("cs", lambda c: c["theirs"].isNotNull())).select(*diagonal, F.explode("cs").alias("c"))
             .filter("c.theirs IS NOT NULL").groupBy(*diagonal, "c.theirs")
             .agg(F.min("c.ours").alias("a"), F.max("c.ours").alias("b")).filter("a <> b")
             .groupBy(*diagonal).agg(F.collect_set("theirs").alias("torn")))  # at most the item's placeholders
    clash = clash.select(*[F.col(c).alias(f"{c}_") for c in diagonal], "torn")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in diagonal]
    changes = F.exists("cs", lambda c: F.array_contains(F.col("torn"), c["theirs"]) & (c["theirs"] != c["ours"]))
    good = (met.join(clash, same, "left").filter(~F.coalesce(changes, F.lit(False)))
            .select(*diagonal, "n", F.explode("cs").alias("c")).select(*diagonal, "n", "c.*"))
    # A diagonal's places and changed places, at most the item's tokens; then the union over diagonals.
    each = good.groupBy(*diagonal, "n").agg(
        F.array_sort(F.collect_set("p")).alias("ps"),
        F.collect_set(F.when(F.col("theirs") != F.col("ours"), F.col("p"))).alias("changed"))
    each = each.select("id", "row_hash", "item", "n", F.explode("ps").alias("p"), _longest_run(F.col("ps")).alias("run"),
                       F.size("changed").alias("changed"), F.col("ps")[0].alias("lead"))
    whole = each.groupBy(*_PAIR).agg(
        F.count_distinct("p").alias("covered_tokens"), F.max("run").alias("run"),
        F.sum(F.when(F.col("p") == F.col("lead"), F.col("changed")).otherwise(0)).alias("changed_slots"))
    return whole.filter((F.col("covered_tokens") >= F.lit(coverage) * F.col("n")) | (F.col("run") >= run)).drop("run")


def contaminations(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   least_words: int = LEAST_WORDS, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """One row per document text and benchmark item it holds: id, item id, how (verbatim, or
    template if values changed), covered_tokens, item_tokens, coverage, changed_slots
    (placeholders whose value differs, over all diagonals) and row_hash."""
    windows = checkpoint(benchmark_windows(benchmark, item_id, item_text, window, least_words, run))
    found = _found_windows(docs, windows, text, doc_id, window, least_words, run)
    exact = _verbatim(found, windows).withColumn("covered_tokens", F.size(_covered("starts", "size")))
    exact = checkpoint(exact.withColumn("held", (F.col("covered_tokens") >= F.lit(coverage) * F.col("n")) | F.col("whole_run")))
    pairs = checkpoint(_reachable(found, windows, exact, coverage, run))
    held = exact.filter("held").select(*_PAIR, "covered_tokens", F.lit(0).alias("changed_slots"), F.lit("verbatim").alias("how"))
    held = held.unionByName(_consistent(found, windows, pairs, coverage, run).select(
        *_PAIR, F.col("covered_tokens").cast("int").alias("covered_tokens"), "changed_slots", F.lit("template").alias("how")))
    return held.select(
        F.col("id").alias(doc_id), F.col("item").alias(item_id), "how",
        F.col("covered_tokens").cast("long").alias("covered_tokens"), F.col("n").cast("long").alias("item_tokens"),
        (F.col("covered_tokens") / F.col("n")).alias("coverage"), F.col("changed_slots").cast("long").alias("changed_slots"),
        "row_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    held = checkpoint(contaminations(docs, benchmark, text, doc_id, **options)
                      .select(F.col(doc_id).alias("i"), F.col("row_hash").alias("h")).distinct())
    rows = docs.select(as_row(docs)).withColumn("row_hash", F.xxhash64(text_or_empty(f"row.`{text}`")))
    gone = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("i")) & (F.col("row_hash") == F.col("h"))
    return rows.join(held, gone, "left_anti").select("row.*")
