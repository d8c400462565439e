from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from glossweave.functions import text, vectors


def one(spark, make, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(make(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize("s", ["hello world", "44th street", "o'neil MCDONALD", "ÉCOLE normale", "", "a-b c_d", "x1y2"])
def test_title_case_is_that_of_python(spark, s):
    assert one(spark, text.title_case, s) == s.title()


def test_strings(spark):
    assert one(spark, text.cap_words, "  new   york ") == "New York"
    assert one(spark, text.cap_phrase, "NEW YORK") == "New York"
    assert one(spark, text.cap_phrase, "New YORK") == "New YORK"
    assert one(spark, text.first_upper, "abc") == "Abc"
    assert one(spark, lambda c: text.split_nonempty(c, "\t "), "a \t\tb ") == ["a", "b"]
    assert one(spark, text.tokens, "F.C. 12-3") == ["F", ".", "C", ".", "12", "-", "3"]
    assert one(spark, text.alnum_only, "a b_c-1é") == "abc1é"
    assert one(spark, text.entity_title, " new_york&amp;co ") == "New york&co"
    assert one(spark, text.percent_decoded, "T%C3%B6th+a") == "Töth+a"
    assert one(spark, text.percent_decoded, "50%") is None
    assert one(spark, text.unicode_unescaped, "caf\\u00e9") == "café"
    assert one(spark, text.plain_quotes, "“") == '"'
    assert one(spark, text.is_content_word, "the") is False
    assert one(spark, text.is_content_word, "12.5") is False
    assert one(spark, text.is_content_word, "river") is True
    assert one(spark, text.title_case, None) is None


def test_stop_words_are_those_of_the_reference(spark):
    words = ["between", "Although", "during", "yourselves", "fify", "using", "does", "like", "river"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["w"] for r in df.where(text.is_content_word(F.col("w"))).collect()] == ["does", "like", "river"]
    assert len(set(text.STOP_WORDS)) == len(text.STOP_WORDS) == 331


@pytest.mark.parametrize("whole,part,want", [("John Smith", "Smith", True), ("John Smith", "Smi", False), ("John Smith", "John", True), ("Smith", "Smith", False), ("Johnson-Lee", "Lee", True), ("Leeds Lee", "Lee", True), ("", "a", False)])
def test_word_boundary(spark, whole, part, want):
    df = spark.createDataFrame([(whole, part)], "w string, p string")
    assert df.select(text.at_word_boundary(F.col("w"), F.col("p"))).collect()[0][0] is want


def test_numbers(spark):
    assert one(spark, text.clamped_log, 0.0, "double") == pytest.approx(math.log(1e-6))
    assert one(spark, text.clamped_log, 2.0, "double") == 0
    assert [one(spark, lambda c: text.bucket(c, [1, 2, 5]), v, "double") for v in (0.0, 1.0, 4.9, 9.0)] == [0, 1, 2, 3]


def test_vectors(spark):
    v = [3.0, 4.0]
    k = "array<float>"
    assert one(spark, vectors.norm, v, k) == 5
    assert one(spark, vectors.unit, v, k) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.unit, [0.0, 0.0], k) == [0, 0]
    assert one(spark, lambda c: vectors.cosine(c, c), [0.0, 0.0], k) is None
    assert sum(one(spark, vectors.softmax, [1.0, 2.0, 500.0], k)) == pytest.approx(1)
    assert one(spark, lambda c: vectors.linear(c, [[1, 1], [2, 0]], [1, 0]), v, k) == [8, 6]
    assert one(spark, vectors.relu, [-1.0, 2.0], k) == [0, 2]
    assert one(spark, lambda c: vectors.minus(c, vectors.scaled(c, F.lit(2.0))), v, k) == [-3, -4]
