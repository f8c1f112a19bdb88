import unicodedata

import pytest
from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.functions import textform as tf
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("ｏｆｆｉｃｅ", "office"), ("vi​deo", "video"), ("a b　c", "a b c"), ("café", "café"), ("ﬁle", "file"), ("оffiсe", "office"),
        ("οffісе", "office"), ("рhοnе?", "phone?"), ("திச\u0d3fத்தம்", "திசித்தம்"), ("எங்கௗ்", "எங்கள்"), ("௰னம்", "யனம்"), ("மொ", "மொ"),
        ("௧௨௩", "௧௨௩"), ("42 жизнь", "42 жизнь"), ("മലയാളം", "മലയാളം"), ("officeல்", "officeல்"), ("௧௦ம்", "௧௦ம்"), ("a\nb\tc", "a\nb c"), ("", ""), ("  x ", "  x "),
    ],
)
def test_consistent_form(text, form):
    assert tf.consistent(text) == form
    assert tf.consistent(form) == form


def test_null_and_long_texts():
    assert tf.consistent(None) is None and tf.letters(None) == "" and tf.words(None) == [] and tf.filled(None) == 0
    assert len(tf.consistent("கொ " * 200_000)) == 600_000


@given(st.text(alphabet=st.sampled_from("abcàकதമоеα௧௰ௗ​­  \ńｆ２,."), max_size=30))
def test_consistent_form_is_stable(text):
    form = tf.consistent(text)
    assert tf.consistent(form) == form == unicodedata.normalize("NFKC", form)
    assert tf.letters(text) == tf.letters(form) and tf.words(text) == tf.words(form)


def test_readings():
    assert tf.readings("office") == [] and tf.readings("бtж") == []
    assert tf.readings("οffісе") == ["office"]
    assert set(tf.readings("сapе")) == {"cape", "саре"}


def test_ids(spark):
    rows = [(" mile-0000977-0000012.wav\n", "spk_0000977"), ("KDLF_12345678_1", "000001015"), ("odd", "1503.0"), (None, None), ("  ", "none"), ("A_1_99999999999999999999", "9" * 30)]
    df = spark.createDataFrame(rows, "u string, s string")
    got = [tuple(r) for r in df.select(ids.utterance_key(F.col("u")), ids.first_number(F.col("s")), ids.speaker_number(F.col("s"), F.col("u"))).collect()]
    assert got == [
        ("MILE_0000977_0000012", 977, 977), ("KDLF_12345678_0000001", 1015, 1015), ("ODD", 1503, 1503), (None, None, None), (None, None, None), ("A_1_99999999999999999999", None, 1),
    ]


@pytest.mark.parametrize("space", ["\t", "\x1c", "\x1f", " ", "\x85", "\xa0", " ", " ", " ", " ", "　", "\n"])
def test_white_space_is_pythons(spark, space):
    t = f"{space}a{space}{space}b{space}"
    row = spark.createDataFrame([(t,)], "t string").select(tx.words(F.col("t")), tx.strip(F.col("t")), tx.unspaced(F.col("t")), tx.prepare_text(F.col("t"))).first()
    assert list(row[0]) == t.split() and row[1] == t.strip() and row[2] == "ab" and row[3] == " ".join(t.split())


def test_scripts_of_every_kind(spark):
    chars = {"க": "tamil", "௰": "tamil", "a": "latin", "×": "latin", "Ḁ": "latin", "7": "digit", "७": "digit", ".": "punctuation", "+": "symbol", " ": "whitespace", "\x1c": "whitespace", "ж": "other", "́": "other"}
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    assert {r[0]: r[1] for r in df.select("c", tx.script_of(F.col("c"))).collect()} == chars
    coarse = {"க": "tamil_block", "7": "ascii_digit", "z": "ascii_latin", " ": "ascii_other", "　": "whitespace", "ж": "other_non_tamil"}
    df = spark.createDataFrame([(c,) for c in coarse], "c string")
    assert {r[0]: r[1] for r in df.select("c", tx.inventory_class(F.col("c"))).collect()} == coarse


def test_unknown_normal_form(spark):
    with pytest.raises(ValueError):
        tx.normalize_text(F.lit("a"), "NFX")


def test_plain_texts_are_composed():
    """Texts of plain characters against the normal form itself, pairs of them exhaustively."""
    plain = [c for c in map(chr, range(0x110000)) if tf._PLAIN.fullmatch(c)]
    marks = [c for c in plain if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc")]
    for a in plain:
        for b in marks:
            assert tf.consistent(a + b) == unicodedata.normalize("NFC", a + b)
    for a in marks:
        for b in marks:
            assert tf.consistent("க" + a + b + "x") == unicodedata.normalize("NFC", "க" + a + b + "x")


def test_confusables_of_all_scripts(spark):
    table = tf.confusables(spark._jvm)
    assert len(table) > 2_000 and tf.LOOK_ALIKE.items() <= table.items()
    assert table["\u0585", "latin"] == "o" and table["\u13a1", "latin"] == "R" and table["\u0966", "latin"] == "o"  # Armenian, Cherokee, a Devanagari digit
    assert tf.readings("c\u0585py", table) == ["copy"] and tf.readings("c\u0585py") == []
    assert tf.readings("\u10e7\u10d0x", table) == []  # Georgian letters without a Latin look-alike
    assert [tf.script_block(c) for c in "\u0561\u0915\u10d0\u4e2d\u0301\u0967"] == ["armenian", "devanagari", "georgian", "", "", "devanagari"] or tf.script_block("\u4e2d") in ("cjk", "")
    assert tf.consistent("c\u0585py \u0501", lambda w: (tf.readings(w, table) or [w])[0], every=True) == "copy \u0501"
