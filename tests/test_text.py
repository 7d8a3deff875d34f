import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as tx
from tarnwick.functions.porter import stem, stemmed


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "\n\n"])
def test_lines_are_python_lines(spark, text):
    assert one(spark, tx.lines, text) == text.splitlines() == tx.split_lines(text)


@pytest.mark.parametrize(
    ("token", "parts"),
    [("HTTPServer", "httpserver http server"), ("set_relay", "set_relay set relay"), ("relay", "relay"), ("__init__", "__init__ init"), ("RateLimitFilter", "ratelimitfilter rate limit filter"), ("x2y", "x2y x 2 y"), ("ABc", "abc a bc")],
)
def test_identifier_parts(spark, token, parts):
    assert one(spark, tx.identifier_parts, token) == parts.split()


def test_words(spark):
    assert one(spark, tx.words, "How does the RateLimiter retry_later? 42 caf\u00e9 it's") == ["ratelimiter", "rate", "limiter", "retry_later", "retry", "later", "caf"]


def test_joined_name(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["x" * 150, "y" * 150],)], "n array<string>").select(tx.joined_name(F.col("n")))
    assert [r[0] for r in df.collect()] == ["a | b", "x" * 150 + " | " + "y" * 47]


@pytest.mark.parametrize(
    "pair",
    "retries retri|retry retri|limiting limit|decided decid|complication complic|caresses caress|ponies poni|ties tie|cats cat|agreed agre|hopping hop|hoping hope|relational relat|conditional condit|rational ration|generously generous|happily happili|sky sky|consistency consist|knightly knight|replacement replac|adoption adopt|controlling control|by by|enjoyed enjoy|communication communic|hopeful hope|goodness good|luxuriated luxuri".split("|"),
)
def test_stem(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_stemmed_keeps_rows(spark):
    df = spark.createDataFrame([(1, "retries"), (2, "retry"), (3, None)], "idx int, term string")
    assert {r["idx"]: r["term"] for r in stemmed(df).collect()} == {1: "retri", 2: "retri", 3: None}
