"""Decontamination of items that a plain template of words does not hold."""

from adflow.llm import decontam


def held(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contaminations(d, b).collect()}


def test_verbatim_copies_of_number_heavy_items(spark):
    items = ["What is 12 + 30 * 4 - 7?", "Table: 3 4 5 6 7 8 9 10 11 12 end of it",
             "Am Montag ging Peter mit Anna, Maria, Klara, Jonas nach Berlin, Hamburg, Bremen"]
    docs = [f"Some words before. {x} And some after." for x in items]
    assert held(spark, docs, items) == {(i, i) for i in range(len(items))}
    assert held(spark, ["What is 13 + 30 * 5 - 8?", "3 4 5 6 7 8"], items) == set()


LONG = " ".join(f"word{chr(97 + i)} and" for i in range(13)) + " he buys 12 pens " + " ".join(
    f"then{chr(97 + i)} so" for i in range(13)) + " he sells 12 pens"


def test_one_changed_value_leaves_the_rest_of_the_copy(spark):
    short = "Give 12 now or 12 later"
    docs = [LONG[:-len("12 pens")] + "13 pens", LONG.replace("12", "9", 1).replace("12 pens", "8 pens"), LONG,
            "give 13 now or 14 later"]
    assert held(spark, docs, [LONG, short]) == {(0, 0), (1, 0), (2, 0)}


TOM = "Tom has 5 apples. Tom eats 2. How many has Tom left?"
PRICE = "A shop near the old harbour sold 120 red chairs on the first day of the sale"


def test_names_at_sentence_starts_and_whole_numbers(spark):
    docs = ["Anna has 9 apples. Anna eats 3. How many has Anna left?", "Tom has five apples. Tom eats two. How many has Tom left?",
            *[PRICE.replace("120", n) for n in ("1,250.5", "-3.5", "fourteen", "twenty-five", "two hundred and six", "3,75")]]
    assert held(spark, docs, [TOM, PRICE]) == {(0, 0), (1, 0), *[(i, 1) for i in range(2, 8)]}


def test_copies_in_other_case_and_spacing(spark):
    german = "Der Bauer im Tal verkauft 12 Birnen an Maria und Peter, die mit dem Zug nach Berlin fahren"
    items = [german, TOM]
    docs = [f(x) for x in items for f in (str.lower, str.upper, str.title, lambda x: x.replace(" ", "  "))]
    assert held(spark, docs, items) == {(i, i // 4) for i in range(8)}


def test_tokens(spark):
    text = "In 1,200 or 3.5, -7 and 4 - 1, 1,2,3: two hundred, Twenty-five. So Five men; so the So."
    df = spark.createDataFrame([(text,)], "t string").select(decontam.tokens(decontam.F.col("t")))
    assert [x.replace("\x0e", ".").replace("\x0f", "-") for x in df.first()[0]] == [
        "in", "\x011200", "or", "\x013.5", "\x01-7", "and", "\x014", "\x011", "\x011", "\x012", "\x013",
        "\x01two.hundred", "\x01twenty.five", "\x04so", "\x015", "men", "so", "the", "\x03so"]
