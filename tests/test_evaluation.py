import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import statistics as st
from tarnwick.operators import evaluation as ev


def metrics(spark, paths, relevant):
    ranked = spark.createDataFrame([("q", p, r) for r, p in enumerate(paths, 1)] or [("x", "x", 1)], "qid string, path string, rank int")
    rels = spark.createDataFrame([("q", p) for p in relevant] or [("other", "x")], "qid string, path string")
    return ev.question_metrics(ranked, rels, spark.createDataFrame([("q",)], "qid string")).first()


def test_metrics(spark):
    m = metrics(spark, "xyzwa", "abcd")
    assert (m["hit_rate@5"], m["recall@5"], m["hit_rate@3"], m["first_hit_rank"], m["mrr"]) == (1, 0.25, 0, 5, 0.2)
    assert metrics(spark, "aaabb", "abcd")["recall@5"] == 0.5
    m = metrics(spark, "ab", "ab")
    assert m["ndcg@10"] == pytest.approx(1)
    assert metrics(spark, "xa", "ab")["ndcg@10"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert metrics(spark, "x" * 10 + "a", "a")["mrr"] == 0
    m = metrics(spark, "abc", "")
    assert m["recall@5"] == m["ndcg@10"] == m["mrr"] == 0 and m["first_hit_rank"] is None


def test_sign_test(spark):
    assert st.sign_test(0, 0) == 1 and st.sign_test(4, 0) == 0.125 and st.sign_test(3, 3) == 1
    pairs = [(a, b) for a in range(30) for b in range(30)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", st.sign_test_column(ev.F.col("a"), ev.F.col("b")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(st.sign_test(r["a"], r["b"]), abs=1e-12) for r in got)


def test_published_sign_tests():
    # fixed values: (better, worse, p to three places) of published comparisons
    for better, worse, p in ((2, 1, 1.0), (11, 4, 0.118), (12, 6, 0.238), (10, 4, 0.180), (10, 3, 0.092), (7, 6, 1.0), (1, 5, 0.219), (14, 11, 0.690), (20, 3, 0.001), (9, 0, 0.004), (4, 0, 0.125), (5, 12, 0.143), (10, 13, 0.678), (16, 3, 0.004)):
        assert f"{round(st.sign_test(better, worse), 4):.3f}" == f"{p:.3f}"  # stored to four places, shown to three


def test_bootstrap():
    x = np.array([0, 1, 1, 0, 1, 0.5])
    a = st.bootstrap_interval(x, 3, 500)
    assert a == st.bootstrap_interval(x, 3, 500) != st.bootstrap_interval(x, 4, 500)
    assert a[0] <= x.mean() <= a[1] and st.bootstrap_interval([], 1) == (0, 0)
    draws = np.random.default_rng(3).integers(0, 6, (500, 6))
    assert a == pytest.approx(np.quantile(x[draws].mean(axis=1), [0.025, 0.975]))
    assert st.difference_interval([1], [], 1) == (0, 0)


def test_intervals_in_spark_are_the_same(spark):
    rows = [("k", m, i, float((i * 7 + len(m)) % 3)) for m in ("mrr", "recall@5") for i in range(9)]
    df = spark.createDataFrame(rows, "key string, metric string, ord int, value double")
    for r in ev.with_intervals(df, resamples=300).collect():
        values = [x[3] for x in rows if x[1] == r["metric"]]
        assert (r["low"], r["high"]) == st.bootstrap_interval(values, st.derived_seed(st.SEED, f"k/{r['metric']}"), 300)


def test_seed(spark):
    assert st.derived_seed(5, "x") == (5 + zlib.crc32(b"x")) % 2**32
    df = spark.createDataFrame([("x",), ("a/b",)], "l string")
    assert [r[0] for r in df.select(st.derived_seed_column(5, ev.F.col("l"))).collect()] == [st.derived_seed(5, "x"), st.derived_seed(5, "a/b")]


def test_round_4(spark):
    df = spark.createDataFrame([(0.12345,), (0.28125,), (None,)], "x double")
    assert [r[0] for r in df.select(st.round_4("x")).collect()] == [round(0.12345, 4), round(0.28125, 4), None]


def test_paired(spark):
    values = [(k, f"q{i}", i, "mrr", float(i < 4) if k == "a" else 0.0) for k in "ab" for i in range(8)]
    df = spark.createDataFrame(values, "key string, qid string, ord int, metric string, value double")
    pairs = spark.createDataFrame([("a vs b", "a", "b", "mrr"), ("absent", "a", "c", "mrr")], "label string, a string, b string, metric string")
    (r,) = ev.paired(df, pairs).collect()
    assert (r["better"], r["worse"], r["same"], r["diff"], r["sign_test_p"]) == (4, 0, 4, 0.5, 0.125)
    assert sorted(x["value"] for x in ev.paired_differences(df, pairs).collect()) == [0.0] * 4 + [1.0] * 4


def test_choose_cap_prefers_no_cap_on_ties(spark):
    rows = [(c, q, 0.5, 1.0, 0.5) for c in (None, 3, 2, 1) for q in ("a", "b")]
    df = spark.createDataFrame(rows, "per_file int, qid string, mrr double, `hit_rate@5` double, `recall@5` double")
    halves = spark.createDataFrame([("a", "dev"), ("b", "test")], "qid string, half string")
    assert {r["per_file"] for r in ev.choose_cap(df, halves).where("chosen").collect()} == {None}
    better = spark.createDataFrame([(1, "a", 0.6, 1.0, 0.5), (1, "b", 0.1, 1.0, 0.5)], df.schema)
    assert {r["per_file"] for r in ev.choose_cap(df.where("per_file is null or per_file > 1").union(better), halves).where("chosen").collect()} == {1}


def test_failure_shares(spark):
    ranked = spark.createDataFrame([("k", "q", "corpus/p/a.md", 1), ("k", "q", "corpus/z/b.py", 2), ("k", "q", "corpus/p/c.py", 6)], "key string, qid string, path string, rank int")
    rels = spark.createDataFrame([("q", "corpus/p/c.py"), ("r", "corpus/p/c.py")], "qid string, path string")
    got = {r["qid"]: r for r in ev.failure_shares(ranked, rels, rels.select("qid").distinct()).collect()}
    assert (got["q"]["doc_share"], got["q"]["wrong_project_share"], got["q"]["hit"]) == (0.2, 0.2, False)
    assert got["r"]["doc_share"] == 0


def test_split():
    ids = {"b": ["b3", "b1", "b2"], "a": ["a1", "a2"]}
    s = ev.make_split(ids, 5)
    assert s == ev.make_split(ids, 5) and sorted(s["dev"] + s["test"]) == ["a1", "a2", "b1", "b2", "b3"]
    assert len(s["dev"]) == 2 and sum(i[0] == "b" for i in s["test"]) == 2


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (1, 0), (None, 1)], "a int, b int")
    r = ev.kappa(df, "a", "b").first()
    assert (r["n"], r["agreement"], r["expected"], r["kappa"]) == (4, 0.75, 0.5, 0.5)
    assert ev.kappa(df.where("a = 1 and b = 1"), "a", "b").first()["kappa"] is None


def test_bootstrap_hash_with_all_resamples(spark, sf_dir):
    """10,000 resamples against numpy."""
    import numpy as np

    from tarnwick.plans import catalog

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    groups = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/labels.parquet").collect(), key=lambda r: r["doc_id"]):
        if r["doc_id"] in lang:
            groups.setdefault(lang[r["doc_id"]], []).append(float(r["quality"]))
    got = {r["lang"]: (r["value"], r["low"], r["high"]) for r in catalog.bootstrap_hash(spark, sf_dir).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        b, j = np.arange(10_000)[:, None], np.arange(len(v))[None, :]
        means = np.array(v)[(b * 7919 + j * 104_729 + b * j * 31) % 1_000_003 % len(v)].mean(axis=1)
        assert np.allclose(got[k], (np.mean(v), *np.quantile(means, [0.025, 0.975])), atol=2e-6)


def test_rounding_is_pythons(spark):
    """Ties of the binary value and what only looks like one, all sizes and signs, a million values."""
    rng = np.random.default_rng(5)
    ties = (np.arange(-400, 400) * 2 + 1) * 625 / 2**5 / 1e4
    near = np.concatenate([np.nextafter(ties, np.inf), np.nextafter(ties, -np.inf), (np.arange(20_000) + 0.5) / 1e4])
    wide = rng.standard_normal(400_000) * 10.0 ** rng.integers(-8, 14, 400_000)
    x = np.concatenate([ties, near, wide, rng.random(600_000), [0.0, -0.0, 5e-324, 1e300, -1e300, math.inf, -math.inf, 2.0**39, 2.0**39 - 0.00005]])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", st.round_4("x").alias("y")).toPandas()
    assert len(got) > 1_000_000 and got["y"].tolist() == [round(v, 4) for v in got["x"].tolist()]
    for places in (0, 1, 3):
        some = spark.createDataFrame(pd.DataFrame({"x": x[:5000]})).select("x", st.round_half_even(F.col("x"), places).alias("y")).toPandas()
        assert some["y"].tolist() == [round(v, places) for v in some["x"].tolist()]
    assert math.isnan(spark.createDataFrame([(math.nan,)], "x double").select(st.round_4("x")).first()[0])


def test_sign_test_of_many_pairs(spark):
    pairs = [(0, 0), (3, 0), (500, 700), (9000, 9100), (40_000, 0), (0, 1), (7, 7)]
    got = spark.createDataFrame(pairs, "b long, w long").select("b", "w", st.sign_test_column(F.col("b"), F.col("w")).alias("p")).collect()
    assert {(r["b"], r["w"]): r["p"] for r in got} == {p: pytest.approx(st.sign_test(*p), rel=1e-9, abs=1e-300) for p in pairs}


def log(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ev.LOG)


def test_adjudication(spark):
    said = [
        ("q1", "f1", "ann", True, None), ("q1", "f1", "bo", True, None), ("q1", "f2", "ann", True, None), ("q1", "f3", "bo", True, None), ("q2", "f1", "ann", True, None), ("q2", "f1", "bo", False, None),
        ("q2", "f1", "ann", False, "second thoughts"), ("q2", "f4", "ann", True, None), ("q1", "f2", "decision", True, "first"), ("q1", "f2", "decision", False, "it only names it"),
    ]
    rows = {(r["id"], r["path"]): (r["labeller_a"], r["labeller_b"], r["decision"], r["reason"], r["relevant"]) for r in ev.adjudicated(log(spark, said), "ann", "bo").collect()}
    assert rows == {
        ("q1", "f1"): (True, True, None, None, True), ("q1", "f2"): (True, False, False, "it only names it", False), ("q1", "f3"): (False, True, None, None, None),
        ("q2", "f1"): (False, False, None, None, False), ("q2", "f4"): (True, False, None, None, None),
    }
    assert sorted((r["id"], r["path"]) for r in ev.disagreements(log(spark, said), "ann", "bo").collect()) == [("q1", "f3"), ("q2", "f4")]
    with pytest.raises(RuntimeError):
        ev.frozen(log(spark, said), "ann", "bo")
    done = [*said, ("q1", "f3", "decision", True, "x"), ("q2", "f4", "decision", False, "y")]
    assert sorted(map(tuple, ev.frozen(log(spark, done), "ann", "bo").collect())) == [("q1", "f1"), ("q1", "f3")]
    got = {r["stage"]: r for r in ev.agreement(log(spark, done), "ann", "bo").collect()}
    assert got["labelled"]["n"] == 5 and got["labelled"]["agreement"] == pytest.approx(0.4) and got["decided"]["agreement"] == 1.0
    assert got["labelled"]["kappa"] == pytest.approx((0.4 - (0.6 * 0.4 + 0.4 * 0.6)) / (1 - 0.48))
    assert ev.adjudicated(log(spark, []), "ann", "bo").count() == 0


def test_hash_differences_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ev, "HASH_BLOCK", 7)
    monkeypatch.setattr(ev, "HASH_RANGE", 16)
    rng = np.random.default_rng(2)
    sides = {"x": {False: rng.random(23), True: rng.random(9)}, "y": {False: rng.random(4), True: []}}
    rows = [(k, s, i, float(v)) for k, both in sides.items() for s, values in both.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, hit boolean, ord long, value double")

    def means(v):
        return np.array([np.mean([v[(b * 7919 + j * 104_729 + b * j * 31) % 1_000_003 % len(v)] for j in range(len(v))]) for b in range(50)])

    got = {r["key"]: (r["low"], r["high"]) for r in ev.difference_hash(df, ("key",), "hit", resamples=50).collect()}
    assert got["x"] == pytest.approx(tuple(np.quantile(means(sides["x"][False]) - means(sides["x"][True]), [0.025, 0.975]))) and got["y"] == (0.0, 0.0)
    one = {r["key"]: (r["value"], r["low"], r["high"]) for r in ev.bootstrap_hash(df.where("hit"), ("key",), resamples=50).collect()}
    assert one["x"] == pytest.approx((sides["x"][True].mean(), *np.quantile(means(sides["x"][True]), [0.025, 0.975])))


def test_intervals_alike_in_one_task_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = spark.createDataFrame([(k, "mrr", i, float(v)) for k in "ab" for i, v in enumerate(rng.random(40))], "key string, metric string, ord long, value double")
    shares = spark.createDataFrame([("a", i, i % 3 == 0, float(v), float(v) / 2) for i, v in enumerate(rng.random(30))], "key string, ord long, hit boolean, doc_share double, wrong_project_share double")
    both = lambda: (sorted(map(tuple, ev.with_intervals(values, resamples=200).collect())), sorted(map(tuple, ev.difference_intervals(shares, resamples=200).collect())))
    one = both()
    monkeypatch.setattr(ev, "GROUP", 5)
    many = both()
    assert [r[:2] + r[3:] for r in one[0]] == [r[:2] + r[3:] for r in many[0]] and one[1] == many[1]
    assert [r[2] for r in one[0]] == pytest.approx([r[2] for r in many[0]])
