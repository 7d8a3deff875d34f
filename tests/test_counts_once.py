"""What the retrieval queries make of whole texts in one pass: counts of words, scores of batches, keys of passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as tx
from tarnwick.operators import labels as lb
from tarnwick.operators import retrieval as rt

TEXTS = ["", "the", "HTTPServer3 set_up __init__ parseXML2Json io_NOW a_b", "snake_case snake_case Plain plain été x", "tab\tHTTP http Http1\n\n_ __ _9 A"]


def test_word_counts_as_the_column(spark):
    """Words of a text counted in one pass are the words of the Column; a null text has no length."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "idx long, text string")
    want = {r["idx"]: sorted(r["w"]) for r in df.where("text is not null").select("idx", tx.words(F.col("text")).alias("w")).collect()}
    got = {r["idx"]: r for r in rt.Lexical.count(df, stem=False).collect()}
    assert got[5]["dl"] is None and not got[5]["terms"]
    for i, w in want.items():
        assert got[i]["dl"] == len(w) and sorted(t for t, n in zip(got[i]["terms"], got[i]["tfs"]) for _ in range(n)) == w


@pytest.mark.parametrize("k, block", [(1, 4096), (7, 4096), (7, 5)])
def test_best_hits_of_batches(spark, monkeypatch, k, block):
    """What leaves the batches holds each question's best hits, ties by id, negative scores and blocks of questions among them."""
    rng = random.Random(3)
    rows = [(i, " ".join(["common", *rng.choices("abcdefghij klmno".split() + [f"w{n}" for n in range(30)], k=rng.randint(0, 12))])) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(40)]
    index = rt.Lexical.build(spark.createDataFrame(rows, "idx long, text string"), stem=False).stored()
    asked = spark.createDataFrame([(f"q{n}", " ".join(rng.choices([f"w{n}" for n in range(30)] + ["common", "abcdefghij"], k=4))) for n in range(20)], "qid string, q string")
    terms = rt.query_terms(asked, stem=False)
    want = rt.top(rt.bm25_scores(index, terms).withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col("idx"))
    flat = rt.Lexical(index.postings, index.lengths, index.terms, index.averages)
    for one in (index, flat):
        got = rt.top(rt.bm25_hits(one, terms, k, 6, block), k, F.desc("score"), F.col("idx"))
        assert sorted(map(tuple, got.select("qid", "idx", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "idx", "score", "rank").collect()))


def test_scoring_sends_little(spark):
    """A batch sends no more than k hits a question, however many chunks share a term."""
    rows = [(i, "common " + "word " * (i % 5)) for i in range(3000)]
    index = rt.Lexical.build(spark.createDataFrame(rows, "idx long, text string").coalesce(1), stem=False).stored()
    asked = spark.createDataFrame([(1, "common"), (2, "word")], "qid long, q string")
    assert rt.bm25_hits(index, rt.query_terms(asked, stem=False), 10).count() <= 2 * 10 * 2


@pytest.mark.parametrize("few", [0, 100_000])
def test_containment_by_keys(spark, monkeypatch, few):
    """Passages found whether or not their keys are few; words that no passage has don't meet, and short passages are found."""
    monkeypatch.setattr(lb, "FEW_KEYS", few)
    docs = [(1, "x one  two three four five six y"), (2, "one two three four five six"), (3, "one two\nthree four five six"), (4, None), (5, "aone two three four five sixb"), (6, "one two three four nope five six")]
    passages = [(10, "one two three four five six"), (11, "one two\nthree four five six"), (12, "ne t"), (13, None), (14, "three four five six y")]
    got = lb.containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, p) for d, t in docs for p, q in passages if t and q and q in t)


def test_half_up():
    assert list(rt._half_up(np.array([0.5, 1.5, -0.5, 2.4]), 0)) == [1, 2, -1, 2]
