import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import charforms as c


@pytest.mark.parametrize(
    "text, form",
    [
        ("ｈａｓ－ｄｅｆｅｃｔ ", "has-defect"), ("15 µm", "15 μm"), ("Kaνitatiοn", "kavitation"), ("НХ-5В-532", "hx-5b-532"), ("diﬀ", "diff"), ("zero​width", "zerowidth"),
        ("no break", "no break"), ("⼆次检查", "二次检查"), ("Über", "über"), ("IІ", "ii"), ("Пoка неясно", "пока неясно"), ("tհermal", "thermal"), ("5 \u2126", "5 ω"), ("a−b", "a-b"),
    ],
)
def test_odd_forms(text, form):
    assert c.unify(text) == (form, True)


@pytest.mark.parametrize("text", ["", "plain", "Überwurf é ñ", "Пока неясно, износ", "轴承（HX-1），读数：3", "15 μm, 3 Ω, Δp, β", "mm² m³ ° · …", "В 14:11 толщина стенки", "насос GEN-насос 1", "cut�"])
def test_ordinary_forms(text):
    assert c.unify(text)[1] is False


def test_equal_looks_become_equal():
    assert c.unify("Ｂｅａｒｉｎｇ wear")[0] == c.unify("bearing wear")[0] == c.unify("BEARING  wеar")[0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_form_is_stable(text):
    form, _ = c.unify(text)
    assert c.unify(form)[0] == form


def test_form_of_every_character_is_stable():
    """Alone and inside words of two scripts."""
    for code in range(sys.maxunicode + 1):
        if not 0xD800 <= code <= 0xDFFF:
            form = c.unify(chr(code))[0]
            assert c.unify(form)[0] == form, hex(code)
    for code in (*range(0x80, 0x3400), *range(0xA640, 0xABC0), *range(0xF900, 0x10000)):
        form = c.unify(f"ab{chr(code)}c1 шт{chr(code)}")[0]
        assert c.unify(form)[0] == form, hex(code)


@pytest.mark.parametrize("word", ["сахар", "АО", "АО-", "тест", "Кавитация", "ΝΟΤΟΣ", "cocтaв", "кey", "НС-2", "has"])
@pytest.mark.parametrize("around", ["{} завод", "Ремонт {}", "the {} pump", "{}, {}", "第{}号 {}"])
def test_neighbours_count_for_nothing(word, around):
    text = around.format(word, word)
    assert c.unify(text)[0] == " ".join(around.format(c.unify(word)[0], c.unify(word)[0]).casefold().split())


@pytest.mark.parametrize("text, form", [("тest", "test"), ("нouse", "house"), ("мotor", "motor"), ("ɡear", "gear"), ("ɑlpha", "alpha"), ("Ꭺlpha", "alpha"), ("πump", "nump"), ("ηot", "not"), ("εxit", "exit"), ("ᴀlpha", "alpha"), ("cocтaв", "состав"), ("изoляции", "изоляции"), ("ѕpare", "spare")])
def test_letters_of_another_script(text, form):
    assert c.unify(text) == (form, True)


@pytest.mark.parametrize("text", ["сахар", "АО", "тест", "ΝΟΤΟΣ", "Καλημέρα", "Ꭰ", "μm", "kΩ", "ΔT", "βγ"])
def test_words_in_their_own_script(text):
    assert c.unify(text)[1] is False


def test_frame_with_nulls_clashes_and_long_texts(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Ａ" * 200_000, None), (3, "same", "same"), (3, "same", "same")]
    frame = spark.createDataFrame(rows, "id bigint, form string, odd string")
    found = c.odd_values(frame, "id", ["form", "odd"], "t").collect()
    assert [(r.tbl, r.row_id, r.field_name, len(r.form)) for r in found] == [("t", 3, "form", 200_000)]
    assert c.odd_values(frame.limit(0), "id", ["form"], "t").count() == 0


def test_folded_agrees_on_lookalikes(spark):
    from pyspark.sql import functions as F

    pairs = [("ВFР－9C", "bfp-9c"), ("в", "В"), ("É​cole", "ecole"), ("ﬁn", "fin"), (None, None), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(c.folded(F.col("a")).alias("a"), c.folded(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
