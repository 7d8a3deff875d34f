import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import providers as pv
from tarnwick.operators import evaluation as ev
from tarnwick.operators import retrieval as rt


def lists(spark, *ranked):
    return [spark.createDataFrame([("q", i, r) for r, i in enumerate(one, 1)], "qid string, idx bigint, rank int") for one in ranked]


def order(df):
    return [r["idx"] for r in df.orderBy("rank").collect()]


def test_rrf_order_and_ties(spark):
    assert order(rt.fuse(lists(spark, [1, 2, 3], [3, 1, 4]), 9)) == [1, 3, 2, 4]
    assert order(rt.fuse(lists(spark, [7, 8], [9, 10]), 9)) == [7, 9, 8, 10]


def capped(spark, paths, per_file, k=None):
    df = spark.createDataFrame([("q", i, p, i + 1) for i, p in enumerate(paths)], "qid string, idx bigint, path string, rank int")
    return order(rt.cap(df, per_file=per_file, k=k))


def test_file_cap(spark):
    assert capped(spark, "aabacbd", 1) == [0, 2, 4, 6, 1, 3, 5]
    assert capped(spark, "aabacbd", 2) == [0, 1, 2, 4, 5, 6, 3]
    assert capped(spark, "aaaaabbbbb", 1, 3) == [0, 5, 1]
    with pytest.raises(ValueError):
        capped(spark, "a", 0)


TEXTS = ["retry the job later", "rate limiter for jobs", "report download url", "the job the job job", "nothing to see", "limit retries"]


def bm25(texts, query):
    from tarnwick.functions.porter import stem

    toks = [[stem(w) for w in t.lower().split() if w not in rt.tx.STOPWORDS] for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    words = [stem(w) for w in query.lower().split() if w not in rt.tx.STOPWORDS]
    score = [sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in words) for t in toks]
    return sorted(range(n), key=lambda i: (-score[i], i)), score


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame([(i, f"corpus/p/{i % 3}.py", f"n{i}", t) for i, t in enumerate(TEXTS)], "idx bigint, path string, name string, text string")
    return rt.Index(chunks, rt.Lexical.build(chunks).stored(), pv.embed(chunks, pv.HashingEmbedder(), "text", "idx").persist(), pv.OverlapReranker())


def asked(spark, *queries):
    df = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "qid string, q string")
    return df.join(pv.embed(df, pv.HashingEmbedder(), "q", "qid"), "qid").persist()


@pytest.mark.parametrize("query", ["retry job job", "limiting the rate", "zebra", "the of"])
def test_bm25_against_a_loop(spark, index, query):
    want, score = bm25(TEXTS, query)
    got = index.bm25(asked(spark, query), 4).orderBy("rank").collect()
    assert [r["idx"] for r in got] == want[:4]
    assert np.allclose([r["score"] for r in got], [score[i] for i in want[:4]])


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "idx bigint, vector array<double>")
    queries = vectors.where("idx < 7").withColumnRenamed("idx", "qid")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4096, 2):
        spark.sparkContext.setCheckpointDir("/tmp/tarnwick-test-checkpoints")
        got = rt.top(rt.dense_scores(vectors, queries, 5, block=block), 5, F.desc("score"), F.col("idx"))
        for q in range(7):
            assert order(got.where(f"qid = {q}")) == np.argsort(-(u @ u[q]), kind="stable")[:5].tolist()


def test_strategies(spark, index):
    questions = asked(spark, "retry job", "rate limit")
    found = {s: index.search(questions, s, 5) for s in rt.STRATEGIES}
    for s, df in found.items():
        for q in ("q0", "q1"):
            got = order(df.where(F.col("qid") == q))
            assert len(got) == len(set(got)) == 5, s
    parts = rt.fuse([index.bm25(questions, 60), index.dense(questions, 60)], 60)
    assert order(found["hybrid"].where("qid = 'q0'")) == order(parts.where("qid = 'q0'"))[:5]
    whole = rt.cap(parts.join(index.chunks.select("idx", "path"), "idx"))
    assert order(found["hybrid+cap"].where("qid = 'q0'")) == order(whole.where("qid = 'q0'"))[:5]
    with pytest.raises(ValueError):
        index.search(questions, "other")
    with pytest.raises(RuntimeError):
        rt.Index(index.chunks, index.lexical).search(questions, "dense")
    with pytest.raises(RuntimeError):
        rt.Index(index.chunks, index.lexical, index.vectors).search(questions, "hybrid+rerank")


def test_hashing_vectors_are_the_embedders(spark):
    df = spark.createDataFrame([(1, "The quick the\tfox"), (2, ""), (3, "a b")], "k int, t string")
    want = pv.HashingEmbedder().encode(["The quick the\tfox", "", "a b"])
    got = [r["vector"] for r in pv.hashing_vectors(df, "k", "t").orderBy("k").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_the_cap_never_lowers_a_metric(spark):
    rng = random.Random(4)
    paths = [f"f{rng.randint(0, 6)}" for _ in range(40)]
    data = [(str(q), i, rng.choice(paths), i + 1) for q in range(12) for i in range(20)]
    fused = spark.createDataFrame(data, "qid string, idx bigint, path string, rank int")
    rels = spark.createDataFrame([(str(q), f"f{f}") for q in range(12) for f in rng.sample(range(7), 2)], "qid string, path string")
    questions = rels.select("qid").distinct()
    before = {r["qid"]: r for r in ev.question_metrics(fused, rels, questions).collect()}
    for r in ev.question_metrics(rt.cap(fused), rels, questions).collect():
        assert all(r[m] >= before[r["qid"]][m] - 1e-12 for m in ("hit_rate@1", "hit_rate@5", "recall@5", "mrr", "ndcg@10"))


def test_providers_from_folders(tmp_path, monkeypatch):
    import json
    import pickle
    from types import SimpleNamespace

    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    from tarnwick.functions import models

    with pytest.raises(FileNotFoundError):
        models.load_token_counter(str(tmp_path))
    t = Tokenizer(WordLevel({"a": 0, "b": 1, "c": 2, "?": 3}, unk_token="?"))
    t.pre_tokenizer = Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    count = pickle.loads(pickle.dumps(models.load_token_counter(str(tmp_path))))
    assert count("a b  c zebra!") == 5 and count("") == 0
    with pytest.raises(FileNotFoundError):
        models.load_embedder(str(tmp_path))
    (tmp_path / "model.onnx").write_bytes(b"weights")
    (tmp_path / "config.json").write_text(json.dumps({"max_position_embeddings": 4}))
    with pytest.raises(ValueError):
        models.load_embedder(str(tmp_path))
    eye = np.eye(4)
    fake = SimpleNamespace(get_inputs=lambda: [SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")], run=lambda _, given: [eye[given["input_ids"]]])
    monkeypatch.setattr(models, "_session", lambda folder: fake)
    e = models.load_embedder(str(tmp_path), 4)
    assert np.allclose(e.encode(["a a b", "c", "a b c a b"]), [[2 / 5**0.5, 1 / 5**0.5, 0, 0], [0, 0, 1, 0], [2 / 6**0.5, 1 / 6**0.5, 1 / 6**0.5, 0]]) and e.revision == pickle.loads(pickle.dumps(e)).revision
    fake.run = lambda _, given: [given["input_ids"].sum(axis=1, keepdims=True).astype(float)]
    r = models.load_reranker(str(tmp_path))
    assert r.predict([("a", "b c"), ("c", "c")]).tolist() == [3.0, 4.0] and not len(r.predict([]))


def test_fillers_of_questions_that_hit_most(spark):
    """Of 400 chunks all but three of the last hit, at a score that is floored below zero: the list is those three, then hits."""
    rows = [(k, "common" if k not in (390, 395, 397) else "other words") for k in range(400)]
    index = rt.Lexical.build(spark.createDataFrame(rows, "idx bigint, text string"), stem=False).stored()
    asked = spark.createDataFrame([(1, "common"), (2, "nothing here"), (3, "")], "qid bigint, q string")
    got = {}
    for r in sorted(rt.bm25_rank(index, asked, 5, stem=False).collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["idx"])
    scores = {r["idx"]: r["score"] for r in rt.bm25_scores(index, rt.query_terms(asked, stem=False)).collect()}
    want = sorted(range(400), key=lambda k: (-scores.get(k, 0.0), k))[:5]
    assert got == {1: want, 2: [0, 1, 2, 3, 4], 3: [0, 1, 2, 3, 4]}


def test_bounds_skip_blocks_and_lose_nothing(spark):
    """The best by blocks are those of all hits, with blocks of all sizes; texts of topics leave most blocks below the threshold."""
    rng = random.Random(4)
    words = [[f"t{k}w{i}" for i in range(12)] for k in range(20)]
    rows = [(i, " ".join(rng.choice(words[i // 30] + ["common", "often"]) for _ in range(rng.randint(3, 30)))) for i in range(600)]
    index = rt.Lexical.build(spark.createDataFrame(rows, "idx long, text string"), stem=False).stored()
    asked = spark.createDataFrame([(k, " ".join(rng.sample(words[k], 3)) + " common") for k in range(20)] + [(50, "nowhere"), (51, "common common often")], "qid long, q string")
    want = rt.top(rt.bm25_scores(index, rt.query_terms(asked, stem=False)).withColumn("score", F.round("score", 6)), 10, F.desc("score"), F.col("idx")).select("qid", "idx", "score", "rank")
    for size in (1, 16, 1000):
        best, met = rt.Blocks.build(index, size).top(asked, 10, stem=False, digits=6)
        assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect())), size
        if size == 16:
            counts = {r["qid"]: (r["met"], r["ranges"]) for r in met.collect()}
            assert sum(m for m, _ in counts.values()) < sum(n for _, n in counts.values()) / 3


def test_fillers_by_gaps(spark):
    """Questions that hit all chunks, all but some, the first ones, and none; ids with gaps."""
    rng = random.Random(6)
    ids = sorted(rng.sample(range(10_000), 300))
    rows = [(i, "allhit " + ("tophit " if k % 50 else "") + ("headhit " if k < 7 else "") + ("solo" if k == 5 else "")) for k, i in enumerate(ids)]
    index = rt.Lexical.build(spark.createDataFrame(rows, "idx long, text string"), stem=False).stored()
    asked = spark.createDataFrame([(0, "allhit"), (1, "tophit"), (2, "headhit"), (3, "nowhere"), (4, "solo")], "qid long, q string")
    short = asked.select("qid")
    hits = rt.bm25_scores(index, rt.query_terms(asked, stem=False)).select("qid", "idx")
    got = {}
    for r in rt._fillers(index, hits, short, 10).collect():
        got.setdefault(r["qid"], []).append(r["idx"])
    held = {0: set(ids), 1: {i for k, i in enumerate(ids) if k % 50}, 2: set(ids[:7]), 3: set(), 4: {ids[5]}}
    assert {q: sorted(v) for q, v in got.items()} == {q: [i for i in ids if i not in h][:10] for q, h in held.items() if len(h) < len(ids)}


def test_kept_tables_are_made_again(spark, tmp_path, monkeypatch):
    """A table that retention took is made again; one that was broken off is not read; what is whole is not made twice."""
    import pathlib
    import shutil
    import uuid

    from tarnwick import session

    key, made = uuid.uuid4().hex, []

    def make():
        made.append(1)
        return spark.range(5)

    folder = pathlib.Path(session.shared_folder(spark).removeprefix("file://")) / f"kept-{key}"
    assert session.kept(spark, key, make).count() == session.kept(spark, key, make).count() == 5 and len(made) == 1
    shutil.rmtree(folder)
    assert session.kept(spark, key, make).count() == 5 and len(made) == 2
    shutil.rmtree(folder)
    (folder / "_temporary" / "0").mkdir(parents=True)
    assert session.kept(spark, key, make).count() == 5 and len(made) == 3


def test_queries_outlive_retention(spark, sf_dir):
    import pathlib
    import shutil

    from tarnwick import session
    from tarnwick.plans import catalog

    before = sorted(map(tuple, catalog.bm25_topk(spark, sf_dir).collect()))
    for kept in pathlib.Path(session.shared_folder(spark).removeprefix("file://")).glob("kept-*"):
        shutil.rmtree(kept)
    assert sorted(map(tuple, catalog.bm25_topk(spark, sf_dir).collect())) == before
