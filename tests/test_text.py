import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearkin.functions import text as X
from nearkin.operators import embedding as E
from nearkin.operators import pooling, words

SPACES = [c for c in map(chr, range(1, 0x3101)) if c.isspace()]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.fixture(scope="module")
def texts():
    return [
        "a　b",
        "a \u0085\u001c\u000bb",
        " a \n\t b ",
        "　",
        "",
        "   ",
        "one  two\r\nthree",
        "".join(f"x{c}" for c in SPACES),
        "日本語の 職務　経歴",
    ]


def test_the_whitespace_set_is_the_usual_one():
    assert len(X.WHITESPACE) == 29
    assert all(re.fullmatch(r"\s", c) for c in X.WHITESPACE)


def test_clean_text_and_tokens_agree_with_split(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i",
        X.clean_text(F.col("t")).alias("clean"),
        X.token_count(F.col("t")).alias("n"),
        X.embed_input(F.col("t")).alias("e"),
    ).collect()
    for r in rows:
        t = texts[r.i]
        assert r.clean == " ".join(t.split())
        assert r.n == len(t.split())
        assert r.e == t.replace("\n", " ").strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from(SPACES + list("ab。é😀")), max_size=40), min_size=30, max_size=60))
def test_clean_text_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.clean_text(F.col("t")).alias("c"), X.token_count(F.col("t")).alias("n"))
    for r in got.collect():
        assert r.c == " ".join(r.t.split())
        assert r.n == len(r.t.split())


def test_word_chunks(spark):
    text = " ".join(f"w{i}" for i in range(10))
    assert one(spark, text, lambda t: E.chunks_of(t, 4)) == [
        "w0 w1 w2 w3",
        "w4 w5 w6 w7",
        "w8 w9",
    ]
    assert one(spark, "a", lambda t: E.chunks_of(t, 4)) == ["a"]
    assert one(spark, " \n ", lambda t: E.chunks_of(t, 4)) == []
    assert one(spark, text, lambda t: E.chunks_of(t, 1)) == text.split()


def test_long_text_is_chunked_whole(spark):
    text = "  ".join(f"word{i}" for i in range(50_000))
    chunks = one(spark, text, lambda t: E.chunks_of(t, 2048))
    assert " ".join(chunks) == " ".join(text.split())
    assert [len(c.split()) for c in chunks] == [2048] * 24 + [50_000 - 24 * 2048]


def test_char_chunks_do_not_split_characters(spark):
    text = "日本語😀" * 13
    chunks = one(spark, text, lambda t: E.chunks_of(t, 7, "char"))
    assert "".join(chunks) == text
    assert [len(c) for c in chunks] == [7] * 7 + [3]
    long = "語" * 100_003
    assert "".join(one(spark, long, lambda t: E.chunks_of(t, 2048, "char"))) == long


def test_blank_char_chunks_drop_out(spark):
    assert one(spark, "ab\n\n\ncd", lambda t: E.chunks_of(t, 2, "char")) == ["ab", "c", "d"]


def test_unknown_unit():
    with pytest.raises(ValueError):
        E.chunks_of(F.lit("x"), 4, "page")


def test_previews_count_characters(spark):
    assert one(spark, "😀日本", lambda t: X.preview(t, 2)) == "😀日"
    assert one(spark, "abc", lambda t: X.preview(t, 2, "...")) == "ab..."


def test_hashes(spark):
    import hashlib

    assert one(spark, "日本", X.text_id) == hashlib.sha1("日本".encode()).hexdigest()


def test_parts_are_joined_in_order(spark):
    rows = [("d", i, f"<{i}>") for i in range(1000)] + [("e", 1, "b"), ("e", 0, "a")]
    df = spark.createDataFrame(rows, "doc string, part int, text string").repartition(7)
    got = {r.doc: r.text for r in pooling.assemble_parts(df, "doc", "part").collect()}
    assert got == {"d": "".join(f"<{i}>" for i in range(1000)), "e": "ab"}


def test_word_counts_and_ties(spark):
    df = spark.createDataFrame([("b a b",), ("c　a",), ("",)], "text string")
    counts = words.word_counts(df)
    assert {r.word: r["count"] for r in counts.collect()} == {"a": 2, "b": 2, "c": 1}
    assert [r.word for r in words.most_common(counts, 2).collect()] == ["a", "b"]


def test_text_stats(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("",), ("a b c d",)], "text string")
    r = words.text_stats(df).first()
    assert (r.mean_tokens, r.unique_texts, r.total_texts) == (2.0, 3, 4)
    assert abs(r.std_tokens - 2**0.5) < 1e-12


def test_chunks_are_bounded_in_any_script(spark):
    rows = [("日本語" * 6667, 10), ("x" * 1000, 1), ("ภาษา" * 3000, 5), ("a b c " * 3000, 5)]
    df = spark.createDataFrame(rows, "t string, n int")
    cut = df.select("t", "n", E.chunks_of(F.col("t"), 2048).alias("c")).collect()
    for r in cut:
        assert len(r.c) >= r.n
        assert "".join(r.c).replace(" ", "") == r.t.replace(" ", "")
    assert max(len(c) for c in cut[0].c) <= 2048
    long = df.select(E.chunks_of(F.col("t"), 2).alias("c")).collect()[1].c
    assert max(map(len, long)) <= 128
