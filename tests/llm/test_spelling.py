import re
import zlib
from collections import Counter

import pytest

from tarnwick.llm import common
from tarnwick.llm import spelling as sp
from tests.test_oracle import same


def spelt(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def counted(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            counts[spelt(doc, "".join(c.lower() if c <= "Z" else c for c in run))] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    form = {}
    beside = {w: [v for v in words if near(v, w)] for w in words}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(beside[w]), form[w], words.get(form[w]), root))
    return sorted(out, key=repr)


def test_matches_sql(spark, sf_dir):
    same(spark, sf_dir, sp.op12_spelling, sp.ORACLE)


def corpus():
    """Words in chains of growing counts, anagrams, doubled letters, capitals that stay, ties, runs of all lengths."""
    text = []
    for n, w in enumerate(["abcde", "abcdef", "abcdeg", "abcdegg", "bbcdegg", "Äbcde", "äbcde", "aabbaa", "aabaa", "aabbba", "edcba", "decba", "xaaaaa", "aaaaa", "axaaa", "ÀÉÎÕÜ", "àéîõü", "ZZZZz", "zzzzz"]):
        text += [w] * (3 + n * n % 41)
    text += ["chainab"] * 5 + ["chainac"] * 12 + ["chainacd"] * 30 + ["chxinacd"] * 90
    docs = [(k, " ".join(text[k::17]) + "." + "-".join(text[k::13])) for k in range(17)]
    return [*docs, (None, "abcde abcde edcba"), (None, None), (50, ""), (51, "a b c 12345"), (3, docs[3][1]), (60, "long" * 3000 + " abcdf" * 4000)]


def test_variants_by_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(5)
    want = brute(counted(docs))
    assert any(r[3] for r in want) and any(r[5] != r[0] and r[5] != r[3] for r in want)
    assert sorted((tuple(r) for r in sp.variants(df).collect()), key=repr) == want


def test_all_anagrams_of_one_key(spark):
    """A thousand permutations and neighbours: one key, but no group beyond an alphabet a place."""
    import itertools

    words = {"".join(p) + "q": 3 + k % 5 for k, p in enumerate(itertools.islice(itertools.permutations("abcdefg"), 800))}
    words |= {w[:3] + "z" + w[4:]: 2 * n for w, n in list(words.items())[::7]}
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    got = sp.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(counted(docs))


@pytest.mark.parametrize("hot", [1, 2000])
def test_roots(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_NODES", hot)
    links = [(f"w{k}", f"w{k // 3}") for k in range(1, 200)] + [(f"v{k}", f"v{k + 1}") for k in range(50)]
    got = dict(sp.roots(spark.createDataFrame(links, "word string, to string")).collect())
    assert got == {**{f"w{k}": "w0" for k in range(1, 200)}, **{f"v{k}": "v50" for k in range(50)}}


def test_join_unique(spark):
    left = spark.createDataFrame([(k, 1 if k < 900 else k % 7 if k % 5 else None) for k in range(1000)], "id int, key int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "key int, r string")
    got = {(r["id"], r["r"]) for r in common.join_unique(left, right, ["key"]).collect()}
    assert got == {(r["id"], f"r{r['key']}" if r["key"] is not None and r["key"] < 5 else None) for r in left.collect()}
    inner = common.join_unique(left, right, ["key"], "inner", left.where("key = 1").select("key").limit(1))
    assert {(r["id"], r["r"]) for r in inner.collect()} == {x for x in got if x[1]} and inner.count() == len([x for x in got if x[1]])


def test_variants_empty(spark):
    assert sp.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sp.variants(spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")).count() == 0


def test_steps_agree(monkeypatch):
    docs = corpus()
    whole = Counter(r for _, t in docs for runs in sp._runs(t.encode() if t else None) for r in runs)
    monkeypatch.setattr(sp, "STEP", 7)
    assert whole == Counter(r for _, t in docs for runs in sp._runs(t.encode() if t else None) for r in runs)
