import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import toxicity as tx
from tarnwick.llm.logistic import logistic


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(weights, word):
    best = (0.0, None, 0)
    for term, w in weights.items():
        begin, letters = term.endswith("*"), term.removesuffix("*")
        near = min(distance(letters, word[:k]) for k in range(len(word) + 1)) if begin else distance(letters, word)
        if near <= (tx.allowed(len(letters), begin) if w >= tx.FIRM else 0):
            best = max(best, (w * tx.DECAY**near, term, near))
    return best


def test_automaton_against_edit_distances():
    rng = random.Random(3)
    weights = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 10))) + rng.choice(["", "", "*"]): rng.uniform(1, 8) for _ in range(60)}
    lexicon = tx.Lexicon(weights)
    met = 0
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        if rng.random() < 0.5:
            base = rng.choice(list(weights)).removesuffix("*")
            k = rng.randrange(len(base))
            word = rng.choice([base[:k] + base[k + 1 :], base[:k] + "d" + base[k:], base[:k] + "d" + base[k + 1 :], base + word]) or "a"
        found, (weight, term, errors) = lexicon.match(word), brute(weights, word)
        if term is None:
            assert found is None, word
        else:
            met += 1
            assert found is not None and found[2] == pytest.approx(weight) and (found[1] == errors or weights[lexicon.terms[found[0]]] != weights[term]), word
    assert met > 500


def test_a_lexicon_forgets_and_finds_again(monkeypatch):
    lexicon = tx.Lexicon({"horrible": 3.0, "scum": 2.0}, {"horrable": 0.5})
    before = [lexicon.match(w) for w in ("horrible", "horrible", "horible", "scum", "scin", "horrable", "fine")]
    assert [b and b[1:] for b in before] == [(0, 3.0), (0, 3.0), (1, pytest.approx(3.0 * tx.DECAY)), (0, 2.0), None, (1, 0.5), None]
    monkeypatch.setattr(tx, "REMEMBERED", 1)
    assert [lexicon.match(w) for w in ("horrible", "horrible", "horible", "scum", "scin", "horrable", "fine")] == before


def test_quotation_marks():
    def marked(text):
        words = tx._WORD.findall(text)
        return tx.quoted(text, [i for i, t in enumerate(words) if t == "x"])

    assert marked('he said "you x you" and x') == [True, False]
    assert marked("x «x» “a x b” x") == [False, True, True, False]
    assert marked('a " x\nx " b x') == [False, False, False]
    assert marked('"' + "a " * 60 + "x " + '"') == [False]
    assert tx.quoted("", []) == [] and marked("x y") == [False]


def test_windows_tell_quotation_from_abuse():
    lexicon = tx.Lexicon({"idiot": 5.0, "stupid": 4.0})
    named = lambda text: dict(zip(tx.FEATURES, tx.features(lexicon, {"you": 2.0}, text)))
    abuse, quote = named("you are an idiot and a stupid one"), named('the word "idiot" and the word "stupid" are rude')
    assert abuse["abuse"] == pytest.approx(np.log1p(9)) and abuse["crowded"] == abuse["abuse"] and abuse["quoted"] == 0 and abuse["context"] > 0
    assert quote["abuse"] == quote["terms"] == 0 and quote["quoted"] == abuse["abuse"]
    assert named("he called him stupid")["reported"] > 0 and 0 < named("idiit")["abuse"] < named("idiot")["abuse"]
    far = named("idiot " + "a " * 30 + "stupid")
    assert far["abuse"] == abuse["abuse"] and far["crowded"] == pytest.approx(np.log1p(5))
    assert tx.features(lexicon, {}, None) == tx.features(lexicon, {}, "") == [0.0] * len(tx.FEATURES)


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    x[:, 2] = 7.0
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] - 0.5)))).astype(float)
    bias, w = logistic(x, y, 1e-3)
    assert w == pytest.approx([1.5, -1.0, 0.0], abs=0.2) and bias == pytest.approx(-0.5, abs=0.2)


FAIR = "river stone garden window letter morning bridge market winter music paper summer candle forest harbour".split()
FOUL = ["blockhead", "nitwit", "dunderpate"]


def table(spark, n=900):
    """Documents of which a tenth abuse and a tenth quote; some abuse misspelt, held-out ones among them."""
    rng, docs, labels = random.Random(9), [], []
    for i in range(n):
        words = [rng.choice(FAIR) for _ in range(rng.randint(20, 60))]
        kind = i % 10
        if kind == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "you " + rng.choice(FOUL) + rng.choice(["", ",", "!"]))
        elif kind == 1:
            words.insert(rng.randrange(len(words)), f'they wrote "{rng.choice(FOUL)}" there')
        docs.append((i, " ".join(words), "xx", 7))
        labels.append((i, 0, int(kind == 0)))
    wrong = [(2000 + k, " ".join(["garden"] * 20 + ["you blokhead, you nitwiit, you dunderpatte"] + ["river"] * 20), None, 7) for k in range(5)]
    odd = [(3000, None, None, 1), (3001, "", "a", 2), (None, "you nitwit you blockhead you dunderpate", None, 3), (0, docs[0][1], "xx", 7), (3002, "stone " * 30_000, None, 4)]
    df = spark.createDataFrame([*docs, *wrong, *odd], "doc_id long, text string, source string, score int")
    return df, spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_end_to_end(spark):
    docs, labels = table(spark)
    rows = tx.toxicity(docs, tx.learn(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    for r in rows:
        if r["doc_id"] is None or 2000 <= r["doc_id"] < 2005:
            assert r["predicted"] == 1, r
        elif r["doc_id"] >= 3000:
            assert r["predicted"] == 0, r
        else:
            assert r["predicted"] == (r["doc_id"] % 10 == 0), r


def test_labels_that_are_held_out_teach_nothing(spark):
    docs, labels = table(spark, 300)
    turned = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda given: sorted((r["doc_id"] or -1, r["score"]) for r in tx.toxicity(docs, tx.learn(docs, given)).collect())
    assert score(labels) == score(turned)


def test_learning_from_nothing(spark):
    docs, labels = table(spark, 40)
    for given in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        rows = tx.toxicity(docs, tx.learn(docs, given)).collect()
        assert len({r["score"] for r in rows}) == 1 and len(rows) == docs.count()
    assert tx.toxicity(docs, tx.learn(docs, labels.limit(0))).where("predicted = 1").count() == 0
    assert tx.toxicity(docs.limit(0), tx.learn(docs.limit(0), labels)).count() == 0


def test_steps_of_long_texts(monkeypatch):
    lexicon = tx.Lexicon({"idiot": 5.0})
    text = ("fine words\n" * 40 + "idiot ") * 3
    whole = tx.features(lexicon, {}, text)
    monkeypatch.setattr(tx, "STEP", 64)
    assert tx.features(lexicon, {}, text) == whole


def test_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.op13_toxicity(spark, sf_dir)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == docs.count()
    met = rows.join(labels.where("toxic is not null"), "doc_id").where("held_out")
    assert met.where("predicted = toxic").count() >= 0.85 * met.count()
