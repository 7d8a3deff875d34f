import math
import re
from collections import Counter

import numpy as np
import pytest

from tarnwick.llm import lexical_search as ls
from tests.test_oracle import same

TERM = re.compile(ls.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(n for *_, n in tfs)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, c, n in tfs:
            m, score = 10 + 90 * n * n_docs // n_terms, 0
            for t in own & c.keys():
                df = sum(t in x for _, x, _ in tfs)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_matches_sql(spark, sf_dir):
    same(spark, sf_dir, ls.op11_lexical_search, ls.ORACLE)


DOCS = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 23))) for i in range(300)]
DOCS += [(900, None), (901, ""), (902, "--- \n"), (None, "w1 W2 w3"), (None, "w1 w2 w3"), (5, DOCS[5][1]), (903, "Éa_b x İ w1"), (904, "rare " + "w7 " * 5000)]
ITEMS = [(i, f"w{i} w{i * 3 % 37} W{i * 5 % 37}, rare") for i in range(40)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w1 Éa x"), (3, "w30 w31"), (3, "w30"), (53, "b x İ")]


@pytest.mark.parametrize("most", [ls.BLOCK_PAIRS, 20])
def test_search_by_brute_force(spark, most):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, term string, score int").repartition(5)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in ls.search(docs, items, most=most).collect()), key=repr)
    assert got == brute(DOCS, ITEMS)


def test_search_long_text_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(ls, "STEP", 50)
    texts = [t.encode() if t is not None else None for _, t in DOCS]
    queries = ls.Queries([(0, "w1"), (0, "rare"), (1, "w1"), (1, "w7")])
    doc, term, tf, sizes = queries.frequencies(texts)
    assert [queries.terms[t] for t in term if t == 0][:1] == [b"rare"] and sizes.tolist() == [len(terms(t)) for _, t in DOCS]
    assert {(d, queries.terms[t].decode()): n for d, t, n in zip(doc, term, tf)} == {(d, w): n for d, (_, t) in enumerate(DOCS) for w, n in Counter(terms(t)).items() if w in ("w1", "rare", "w7")}


def test_steps_of_impacts_agree(monkeypatch):
    rng = np.random.default_rng(1)
    queries = ls.Queries([(int(i), f"t{t}") for i in range(30) for t in rng.choice(20, 5, replace=False)])
    texts = [" ".join(f"t{t}" for t in rng.integers(0, 25, 30)).encode() for _ in range(200)]
    doc, term, tf, _ = queries.frequencies(texts)
    weights, m = rng.integers(1, 5000, len(queries.terms)), rng.integers(10, 200, 200)

    def whole():
        return sorted(x for part in ls.accumulate(queries, weights, doc, term, tf, m) for x in zip(*(c.tolist() for c in part)))

    at_once = whole()
    for most in (1, 100, 777):
        monkeypatch.setattr(ls, "STEP_IMPACTS", most)
        assert whole() == at_once


def test_radix_order():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) % np.uint64(1 << 40)
    assert ls.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    assert ls.radix_order(np.empty(0, np.uint64)).tolist() == []


def test_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ls.search(docs, items).count() == 0
    assert ls.search(docs, spark.createDataFrame([(1, "a")], items.schema)).count() == 0
    assert ls.search(spark.createDataFrame([(1, "a")], docs.schema), items).count() == 0
