"""Tokeniser, stemmer, query parsing, snippets, highlighting."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.functions.stem import stem_word, with_stem

STEMS = {
    "cats": "cat", "processes": "process", "ponies": "poni", "ties": "ti", "motoring": "motor", "sing": "sing", "feed": "feed", "agreed": "agre", "plastered": "plaster", "as": "as", "at": "at", "be": "be",
    "flying": "flying", "happy": "happi", "sky": "sky", "running": "run", "hopping": "hop", "hoping": "hope", "falling": "fall", "relational": "relat", "controlling": "control", "databases": "databas", "distributed": "distribut", "2024s": "2024", "ies": "i", "aed": "a", "oing": "o",
}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_stems(spark):
    got = with_stem(spark.createDataFrame([(w,) for w in STEMS], "word string")).collect()
    assert {r["word"]: r["term"] for r in got} == STEMS
    assert {w: stem_word(w) for w in STEMS} == STEMS
    assert stem_word("") == stem_word(None) == ""


def test_stem_forms_agree(spark):
    rng = random.Random(4)
    parts = ["a", "e", "i", "o", "u", "y", "b", "l", "s", "t", "z", "at", "bl", "iz", "ing", "ed", "eed", "ational", "izer", "ousness", "icate", "ness", "ement", "ion", "ll", "ss", "ies", "w", "x", "7"]
    words = list({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(3000)})
    got = with_stem(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {r["word"]: r["term"] for r in got} == {w: stem_word(w) for w in words}


@pytest.mark.parametrize(
    ("raw", "query", "document"),
    [("The C language", ["c", "language"], ["language"]), ("Don’t stop", ["don", "t", "stop"], ["don", "stop"]), ("café_x", ["caf", "x"], ["caf"]), ("structure of data", ["structure", "data"], ["structure", "data"]), ("the of and", [], []), ("a bc﻿de", ["bc", "de"], ["bc", "de"]), ("", [], [])],
)
def test_tokens(spark, raw, query, document):
    assert one(spark, text.tokens(F.col("t"), text.QUERY_LEAST), t=raw) == query == text.tokens_literal(raw)
    assert one(spark, text.tokens(F.col("t")), t=raw) == document


def test_parse_query(spark):
    assert text.parse_query('say "data x" data') == (["sai", "data", "x"], [["data", "x"]])
    assert text.parse_query('"data" ""')[1] == []
    assert text.parse_query('"big cats" and "big cats"') == (["big", "cat"], [["big", "cat"], ["big", "cat"]])
    assert one(spark, text.query_phrases(F.col("q")), q='say "data x" "one"') == [["data", "x"]]
    assert text.parse_query("") == text.parse_query(None) == ([], [])


def test_snippet(spark):
    body = "".join(chr(97 + i % 7) for i in range(300))
    hit = body[:100] + "zzword" + body[106:]
    cut = lambda c, q: one(spark, text.snippet(F.col("c"), F.col("q")), c=c, q=q)
    assert cut(body, "zzz") == body[:200] + "..."
    assert cut(hit, "x none ZZWORD") == "..." + hit[40:240] + "..."
    assert cut("short text", "text") == "short text" and cut("", "x") == "" and cut(None, "x") == ""
    assert cut(hit, '"zzword') == hit[:200] + "..."  # the quote is part of the word
    assert cut("b aa first", "first b aa") == "b aa first"


def test_highlight_and_completion(spark):
    assert one(spark, text.highlight(F.col("t"), 'Cat "d.g'), t="<Cat> d.g dog & cat") == '&lt;<mark class="highlight">Cat</mark>&gt; <mark class="highlight">d.g</mark> dog &amp; <mark class="highlight">cat</mark>'
    assert one(spark, text.highlight(F.col("t"), ""), t="a<b") == "a&lt;b"
    assert one(spark, text.last_word(F.col("q")), q=" big da ") == "da" and one(spark, text.last_word(F.col("q")), q="big d") is None
    assert one(spark, text.complete(F.col("q"), F.lit("data")), q="big da") == "big data"
    assert one(spark, text.display_score(F.col("s").cast("double")), s="1.23456") == "1.235"
