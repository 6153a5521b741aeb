import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import encode
from graphloom.llm.encode import TOKENIZERS, Known, Vocabulary, encode_corpus

TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world's end, they're 12345 x!!", "<|endoftext|> is text", "héllo wörld ÆØ", "日本語のテキスト と 語", "Привет, мир", "😀😀 e\u0301 \u200b\ufeff",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 200_000, "xyz" * 40_000, " " * 50_000 + "x", "\x00\x01\x7f", "don't DON'T I'll  we've", "naïve — “quotes” … ½ ² №",
]


@pytest.fixture(scope="module")
def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [list(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def random_texts(seed, n):
    rng = random.Random(seed)
    pieces = ["the", " The", "ing", "tion", " ", "  ", "\n", "1", "23", "é", "Ж", "語", "!", "'s", "'", "zq", "\u3000", "😀", "\u0301"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_against_the_public_library(spark, expected):
    texts = TEXTS + random_texts(3, 400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    got = {r[0]: list(r[1]) for r in encode_corpus(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_small_blocks_and_a_full_table_of_words(spark, expected, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_CHARS", 40)
    monkeypatch.setattr(encode, "KEPT_CHARS", 60)
    texts = random_texts(8, 200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r[0]: list(r[1]) for r in encode_corpus(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_replay_gives_the_words_back():
    v = Vocabulary(open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8").read())
    words = [" hello", "ing", "ßx", "", "aaa"]
    import json

    names = {i: t for t, i in json.load(open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8"))["model"]["vocab"].items()}
    letters = {x: b for b, x in enumerate(encode.byte_letters())}
    back = [bytes(letters[c] for i in ids for c in names[i]).decode() for ids in v.replay(words)]
    assert back == words


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted((str(r[0]), len(r[1])) for r in encode_corpus(df, "doc_id", "text").collect()) == [("1", 1), ("1", 1), ("None", 0)]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_words_are_remembered_in_two_generations():
    known = Known(30)
    for w in ("aa", "bb", "cc", "dd"):
        known.keep(w, (1,))
    assert len(known.new) == 4 and not known.old
    known.keep("ee", (2,))
    assert set(known.old) == {"aa", "bb", "cc", "dd"} and set(known.new) == {"ee"}
    assert known.recall({"aa", "zz"}) == {"aa": (1,)} and "aa" in known.new
