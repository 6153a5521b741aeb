import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from graphloom.llm import plain_forms
from graphloom.llm.visual import consistent_form, look_alike_classes, look_alike_pairs, mappings

SAME = [
    ("Ｈｅｌｌｏ， ｗｏｒｌｄ１２！", "Hello, world12!"), ("ﬁne ﬂow oﬃce", "fine flow office"), ("Неllo ехаm", "Hello exam"), ("cafe\u0301 u\u0308ber", "café über"), ("e\u200b\u0301a", "éa"),
    ("a\u200bb\u200cc\u200dd\ufeffe\u2060f\u00adg", "abcdefg"), ("a\u00a0b\u2003c\u3000 \td\u2028e", "a b c d e"), ("  a\n\nb  ", "a b"), ("Κόσμος", "Kόσμος"), ("ｶﾞｷﾞ", "ガギ"), ("K", "K"), ("ё е\u0308", "ë ë"),
    ("Ёлка", "Ëлка"), ("✅️", "✅"), ("wait…", "wait..."), ("Ⅳ", "IV"), ("ѐ", "è"), ("ў", "у\u0306"), ("ΌΧΙ", "ÓXI"), ("a\x00b\x7f\x85c", "ab c"), ("non‑stop", "non-stop"), ("ᎪᏴ ꓮꓐ ɑɡ", "AB AB ag"), ("Bä\u2026 \u0391\u0308", "Bä... Ä"),
]
DIFFERENT = [("Hello", "hello"), ("café", "cafe"), ("a1", "a2"), ("a.", "a!"), ("a b", "ab"), ("x²", "x2"), ("½", "1/2"), ("и", "u"), ("ß", "ss"), ("“a”", '"a"'), ("で", "て"), ("№", "No"), ("𝐀", "A"), ("ı", "i")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("id", F.lit("x"))
    return {r.id: r.form for r in consistent_form(df, "doc_id", "text").collect()}


def test_forms(spark):
    flat = [t for pair in SAME + DIFFERENT for t in pair]
    got = forms(spark, flat)
    for i, pair in enumerate(SAME + DIFFERENT):
        assert (got[2 * i] == got[2 * i + 1]) == (i < len(SAME)), pair


def test_forms_are_stable_and_composed(spark):
    rng = random.Random(1)
    chars = [*"abcXYZ 019.!", *mappings()[0], *mappings()[1], "\u0301", "\u0308", "\u3099", "か", "\u200d", "\u00a0"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(30))) for _ in range(300)]
    first = forms(spark, texts)
    again = forms(spark, [first[i] for i in range(len(texts))])
    assert first == again
    assert all(unicodedata.normalize("NFC", f) == f and f == f.strip() and "  " not in f for f in first.values())


def test_null_empty_and_long(spark):
    long = "Ａ\u200b " * 400_000
    got = forms(spark, [None, "", " \u200b\u3000", long])
    assert got == {0: None, 1: "", 2: "", 3: ("A " * 400_000).strip()}


@pytest.mark.parametrize("sizes", [{}, {"hot_rows": 1, "tile": 1}, {"tile": 2}])
def test_pairs(spark, sizes):
    texts = ["Hello", "Неllo", "Hello", "hello", None, "", " ", "\u200b", "Ｈello", "x", "x", "ｙ", "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("f", F.lit(1)).withColumn("t", F.lit(2))
    got = look_alike_pairs(df, "doc_id", "text", **sizes)
    assert sorted(map(tuple, got.collect())) == [(0, 1), (0, 8), (1, 2), (1, 8), (2, 8), (11, 12)]


def test_classes(spark):
    texts = ["Hello", "Неllo", "Hello", "hello", None, "", " ", "\u200b", "Ｈello", "x", "x", "ｙ", "y"]
    df = spark.createDataFrame([*enumerate(texts), (None, "y")], "doc_id long, text string")
    for limit in (1, 10**6):
        got = sorted(map(tuple, look_alike_classes(df, "doc_id", "text", hot_rows=limit).collect()))
        assert got == [(0, 0, 4, 3), (1, 0, 4, 3), (2, 0, 4, 3), (8, 0, 4, 3), (11, 11, 2, 2), (12, 11, 2, 2)]


def test_many_copies_of_one_text(spark):
    rows = [(i, "Hello") for i in range(400)] + [(1000, "Неllo")]
    got = look_alike_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", hot_rows=50, tile=4)
    assert sorted(map(tuple, got.collect())) == [(i, 1000) for i in range(400)]


def test_forms_against_characters_looked_up_one_by_one(spark):
    rng = random.Random(2)
    odd = [chr(c) for c in plain_forms._odd() if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(rng.choice([odd, "abc Äöу", "\u0301\u0308 x"])) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    got = forms(spark, texts)
    for i, text in enumerate(texts):
        want = unicodedata.normalize("NFC", "".join(plain_forms.shown(c) for c in text))
        assert got[i] == re.sub(" +", " ", want).strip(" "), [hex(ord(c)) for c in text]


def test_no_pairs(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert look_alike_pairs(df, "doc_id", "text").count() == 0
