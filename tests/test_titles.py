"""Normalisation, markers, trigrams and the distinct-title rules."""

import pytest
from pyspark.sql import functions as F

from tasteplane.functions import text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("  The   Wall ", "the wall"), ("A B", "a b"), ("Ｆｕｌｌ", "full"), ("Straße", "strasse"), ("X – Y", "x - y"), ("x−y", "x-y"), ("", ""), (None, None), ("ÉTÉ", "été"),
])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize(F.col("t")), t=raw) == want


def test_forms_keep_their_order(spark):
    forms = one(spark, text.comparison_forms(text.normalize(F.col("t"))), t="The Mill: A Tale")
    assert forms == ["the mill: a tale", "the mill a tale", "mill: a tale", "mill a tale"]
    assert one(spark, text.comparison_forms(text.normalize(F.col("t"))), t="") == []


@pytest.mark.parametrize("t, want", [("Part III", ["3"]), ("Seven", ["7"]), ("2001", ["2001"]), ("One plus Two", ["1", "2"]), ("Mixed", []), ("iv and 4", ["4"])])
def test_markers(spark, t, want):
    assert one(spark, text.markers(text.tokens(text.normalize(F.col("t")))), t=t) == want


def python_grams(s):
    import re

    return {p[i : i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)}


@pytest.mark.parametrize("a, b", [("word", "words"), ("the end", "end the"), ("", ""), ("", "x"), ("naïve café", "naive cafe"), ("a-b c", "ab c")])
def test_similarity(spark, a, b):
    x, y = python_grams(a), python_grams(b)
    want = len(x & y) / len(x | y) if x | y else 0.0
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize("query, candidate, want", [
    ("Night Run 2", "Night Run", True), ("Night Run", "Night Run 2", False), ("Night Run II", "Night Run 3", True), ("Night Run Two", "Night Run 2", False),
    ("River the Old", "Old the River", True), ("Colour Harbour", "Color Harbor", False), ("Grey Harbour", "Gray Harbour", True), ("Harbour Dark", "Harbour", True), ("Harbour", "Harbour: A Long Tale", False), ("Vol. 1 Song", "Volume 1 Song", False),
])
def test_distinct(spark, query, candidate, want):
    df = spark.createDataFrame([(query, candidate)], "q string, c string").select(text.normalize(F.col("q")).alias("q"), text.normalize(F.col("c")).alias("c"))
    assert df.select(text.titles_distinct(F.col("q"), F.col("c")).alias("x")).first().x is want
