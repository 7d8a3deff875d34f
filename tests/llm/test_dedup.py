import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwick.llm import common, embedding_dedup, exact_dedup, queries, simhash


def compare(spark, sf_dir, name):
    from tests.test_oracle import same

    same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, name)


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- exact


def test_directory_splits_and_doubles():
    d = exact_dedup.Directory()
    assert d.split(0) == 1 and d.split(1) == 2
    assert d.depth == 2 and d.slots == [0, 0, 1, 2] and d.local == [1, 2, 2] and d.prefix == [0, 2, 3]
    assert d.split(0) == 3 and d.depth == 2 and d.slots == [0, 3, 1, 2]  # no doubling: the bucket was less deep
    rng = random.Random(3)
    for _ in range(50):
        bits, capacity = rng.randint(1, 6), rng.randint(1, 9)
        counts = {k: rng.randint(0, 5) for k in range(1 << bits) if rng.random() < 0.6}
        f = exact_dedup.Directory().fit(counts, bits, capacity)
        assert len(f.slots) == 1 << f.depth and max(f.local) == f.depth <= bits and set(f.slots) == set(range(len(f.local)))
        for b, d in enumerate(f.local):
            slots = [s for s, x in enumerate(f.slots) if x == b]
            assert slots == list(range(f.prefix[b] << (f.depth - d), (f.prefix[b] + 1) << (f.depth - d)))
            n = sum(c for k, c in counts.items() if k >> (bits - d) == f.prefix[b])
            assert n <= capacity or d == bits
            if d:  # its parent was too full
                assert sum(c for k, c in counts.items() if k >> (bits - d + 1) == f.prefix[b] >> 1) > capacity
        ranks = [r for _, _, r in f.in_order()]
        assert ranks == sorted(ranks)


def test_the_directory_finds_the_owners(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i % 70}") for i in range(300)], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(df, capacity=2)
    assert got.count() == 300 and got.select("bucket").distinct().count() > 16
    find = exact_dedup.Directory.in_order
    monkeypatch.setattr(exact_dedup.Directory, "in_order", lambda self: find(self)[:1])  # a directory of one slot knows few keys
    assert exact_dedup.exact_dedup(df, capacity=2).count() < 100


def test_texts_of_one_digest_are_told_apart(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(30)] + [(50, None)], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(df, digest=lambda norm: F.when(norm == "t6", F.lit("f" * 20)).otherwise(F.lit("0" * 20))).collect()
    assert len(got) == 31 and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, i % 7, 5 if i % 7 < 2 else 4) for i in range(30)} | {(50, 50, 1)}


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (7, "a b "), (8, " "), (1, "\n"), (None, "a b"), (None, "lone"), (6, "x" * 300_000), (10, "x" * 300_000), (3, "a\tb"), (11, "é b"), (12, "é b")]


@pytest.mark.parametrize("options", [{}, {"key_bits": 1, "capacity": 1}, {"key_bits": 4, "capacity": 1, "flush_bytes": 10}])
def test_exact_dedup_against_a_loop(spark, options):
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in ROWS], "doc_id bigint, text string, key int, sha string").repartition(3)
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in ROWS:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i is not None and i == keep))
    got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(df, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(df.limit(0), **options).count() == 0


def test_colliding_keys_are_chained(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(30)], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(df, key_bits=1, capacity=1).select("text_sha256", "chain").distinct().collect()
    assert len(got) == 7 and max(r["chain"] for r in got) >= 3


# ---------------------------------------------------------------- simhash


def brute_print(text):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, prints, bits=3):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, p), (j, q) in itertools.combinations(zip(ids, prints), 2):
        if (p ^ q).bit_count() <= bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "a b c", "A B C d É é", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text else None) == brute_print(text)


def test_simhash_against_a_loop(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(150)) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += ["", None, " ", "same text here", "Same text here", "x"]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(10, texts[0]), (None, "x"), (None, "only null ids have this")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, fp int").repartition(3)
    known = {i: brute_print(t) for i, t in rows if i is not None}
    want = brute_components(list(known), list(known.values()))
    for tile in (1024, 2):
        got = simhash.simhash_dedup(df, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                assert (int(r["fingerprint"], 16), r["component_id"]) == (known[r["doc_id"]], want[r["doc_id"]])
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {max(known), None}
    assert len(set(want.values())) < len(known) - 20
    assert simhash.simhash_dedup(df.limit(0)).count() == 0


def dealt(rows, pivots, bits=3):
    """(path, cell) -> fingerprints of rows (cell, path, fp), dealt once."""
    cell, path, fp = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(path, pa.int32()), pa.array(range(len(fp))), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["cell", "path", "rep", "fp"])
    out = {}
    for b in simhash._dealt(pivots, bits)([batch]):
        for c, p, _, x in zip(*(col.to_pylist() for col in b.columns)):
            out.setdefault((p, c), set()).add(x % (1 << 64))
    return out


@pytest.mark.parametrize("bits", [1, 3, 4])
def test_cells_miss_no_pair(bits):
    rng = random.Random(1)
    pivots = np.random.default_rng(2).integers(0, 1 << 64, 16, dtype=np.uint64)
    for _ in range(60):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), bits):
            y ^= 1 << b
        rows = [(0, 1, x), (0, 1, y)]
        for _ in range(3 if bits == 3 else 1):  # in any cell that both are in they meet again when it is dealt
            met = [(c, p) for (p, c), held in dealt(rows, pivots, bits).items() if {x, y} <= held]
            assert met
            c, p = rng.choice(met)
            rows = [(c, p, x), (c, p, y)]


def test_pivots_part_what_is_far():
    fp = np.random.default_rng(4).integers(0, 1 << 64, 400, dtype=np.uint64).tolist()
    pivots = np.random.default_rng(2).integers(0, 1 << 64, 16, dtype=np.uint64)
    assert max(map(len, dealt([(0, 1, x) for x in fp], pivots).values())) <= 2
    # without pivots all meet in one cell a part, with pivots that see nothing of a part too
    assert max(map(len, dealt([(0, 1, x) for x in fp], pivots[:0]).values())) == 400


def test_cells_decide_which_pairs_meet(spark, monkeypatch):
    rows = [(i, i * 0x9E3779B97F4A7C15 % (1 << 63) ^ j) for i in range(40) for j in (0, 1 << 3, 1 << 40 | 1 << 5)]
    prints = spark.createDataFrame([(3 * i + k % 3, x) for k, (i, x) in enumerate(rows)], "rep bigint, fp bigint")
    assert simhash.simhash_links(prints).count() >= 80
    apart = np.random.default_rng(0)

    def blind(pivots, bits):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(apart.permutation(n) + b.column(2).to_numpy() * 1_000_003), pa.array(np.full(n, 2, np.int32)), b.column(2), b.column(3)], names=["cell", "path", "rep", "fp"])

        return run

    monkeypatch.setattr(simhash, "_dealt", blind)
    assert simhash.simhash_links(prints).count() == 0


def test_links_within_a_group():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    fp = np.concatenate((fp, fp[:30] ^ np.uint64(5), fp[:10] ^ np.uint64(0b10101 << 40)))
    pivots = rng.integers(0, 1 << 64, 16, dtype=np.uint64)
    fp = fp[np.argsort(np.bitwise_count(fp ^ pivots[0]), kind="stable")]
    label = simhash.linked(np.zeros(len(fp), np.int64), fp, pivots, 3)
    want = brute_components(list(range(len(fp))), [int(x) for x in fp])
    assert label.tolist() == [want[i] for i in range(len(fp))]


def test_simhash_query(spark, sf_dir):
    docs = {r["doc_id"]: brute_print(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_components(list(docs), list(docs.values()))
    got = simhash.op8_simhash(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{p:016x}", want[i]) for i, p in docs.items())


# ---------------------------------------------------------------- embeddings


def brute_vectors(rows, threshold=0.93):
    ok = [k for k, (i, v, g) in enumerate(rows) if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, b in itertools.combinations(ok, 2):
        if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [rows[x][0] for x in seen]
        out.append((rows[k][0], len(links[k]), min(ids) if None not in ids else None))
    return sorted(out, key=repr)


def test_embeddings_against_a_loop(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((25, 16))
    rows = []
    for k in range(260):
        c = centres[rng.integers(0, 25)] if k < 200 else centres[0]
        rows.append((1000 - k, (c + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.35])).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [None] + [1.0] * 15, 0), (5, [float("nan")] * 16, 0), (6, [float("inf")] + [1.0] * 15, 0), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (9, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(2000, rows[5][1], rows[5][2]), (2001, rows[5][1], rows[5][2]), (2002, [2 * x for x in rows[5][1]], rows[5][2])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<float>, label int, grp string").repartition(3)
    for options in ({}, {"rounds": 0}, {"tile": 4, "recall": 0.999999}):
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df, **options).collect()), key=repr)
        assert got == brute_vectors(rows), options
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_of_a_dense_topic(spark, monkeypatch):
    """A topic whose vectors part slowly by signs, beside spread ones; some pairs are near the threshold."""
    rng = np.random.default_rng(3)
    topic = rng.standard_normal(64) + 0.5 * rng.standard_normal((6000, 64))
    x = np.concatenate((topic, rng.standard_normal((4000, 64))))
    x = np.concatenate((x, topic[:1500] + np.where(np.arange(1500) % 3 == 0, 0.3, 0.4)[:, None] * rng.standard_normal((1500, 64)))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[lo : lo + 1000] @ u.T >= 0.93).sum(axis=1) - 1 for lo in range(0, len(u), 1000)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").repartition(4)
    monkeypatch.setattr(embedding_dedup, "TASK_ROWS", 3_000)
    for options in ({}, {"worth": -190, "span": 700}):  # mostly all with all; passes for all that part
        got = dict(map(tuple, embedding_dedup.embedding_dedup(df, **options).select("vec_id", "n_links").collect()))
        assert [got[i] for i in range(len(x))] == want.tolist(), options


def test_passes_find_planted_pairs_in_a_large_label(spark, monkeypatch):
    """20,000 vectors of one label, pairs at cosine 0.93 to 0.99 among them: all go through the passes, and the pairs that are found are counted."""
    rng, n, pairs = np.random.default_rng(12), 20_000, 500
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.linspace(0.9305, 0.99, pairs)
    away = rng.standard_normal((pairs, 64))
    away -= (away * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x[n - pairs :] = cos[:, None] * x[:pairs] + np.sqrt(1 - cos**2)[:, None] * away
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(8)
    whole, seen = embedding_dedup._with_all, []

    def watched(leaders, *more):
        seen.append(tuple(leaders.agg(F.count_if("crowded"), F.max("upto"), F.count(F.lit(1))).first()))
        return whole(leaders, *more)

    monkeypatch.setattr(embedding_dedup, "_with_all", watched)
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.embedding_dedup(df).where("n_links > 0").collect()}
    found = sum(got.get(n - pairs + k) == k for k in range(pairs))
    crowded, most, leaders = seen[0]
    print(f"{found} of {pairs} pairs, {leaders} leaders, {crowded} compared with all, {most} passes at most")
    assert crowded <= leaders // 100 and leaders > 19_000
    assert found >= 0.9 * pairs and len(got) == 2 * found


def test_labels_of_more_than_a_window_go_through_passes(spark):
    d = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(16).tolist(), i % 2 if i < 400 else 2) for i in range(420)], "vec_id bigint, embedding array<double>, label int")
    rows = d.select(F.col("vec_id").alias("lead"), F.col("label").cast("string").alias("grp"), F.lit(16).alias("dim"), F.lit(0.4).alias("angle"), F.col("embedding").alias("vec"))
    needed = {r["lead"]: r["upto"] for r in embedding_dedup.passes_needed(rows, 0.93, 64, 0.999, 1).collect()}
    cut = {r["lead"]: r["upto"] for r in embedding_dedup.passes_needed(rows, 0.93, 64, 0.999, 1, task_rows=150).collect()}
    assert len(needed) == len(cut) == 420 and all(needed[i] == 1 for i in range(400, 420))
    assert min(cut.values()) >= 1 and sum(needed[i] for i in range(400)) <= 1.3 * sum(cut[i] for i in range(400))  # what a cut hides is not taken for less


@pytest.mark.parametrize("options", [{"worth": -190, "recall": 0.9}, {}])
def test_embeddings_of_a_shell(spark, monkeypatch, options):
    """All pairs link, none shares a cell, and the group is cut over ten tasks: every link is counted, and rows that are handed on grow with the vectors."""
    rng, n = np.random.default_rng(5), 2000
    far = rng.standard_normal((n, 128)) * ([0] + [1] * 127)
    x = np.eye(128)[0] + 0.2 * far / np.linalg.norm(far, axis=1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = (u @ u.T)[np.triu_indices(n, 1)]
    assert cos.min() > 0.93 and cos.max() < math.cos(math.acos(0.93) / 2)
    monkeypatch.setattr(embedding_dedup, "TASK_ROWS", 200)
    handed = []
    monkeypatch.setattr(embedding_dedup, "components", lambda e: (handed.append(e.count()), common.components(e))[1])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(8)
    got = embedding_dedup.embedding_dedup(df, **options)
    assert {tuple(r)[1:3] for r in got.collect()} == {(n - 1, 0)}
    assert len(handed) == 2 and max(handed) < 100 * n  # a forest a pass; there are 1,999,000 links


def test_embeddings_of_large_cells(spark):
    """Cells that are compared as wholes, some of them near each other, against a loop."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = []
    for k, (far, n) in enumerate(((0.0, 60), (0.28, 60), (0.33, 40), (0.5, 30), (1.5, 20))):
        c = centre + far * rng.standard_normal(16)
        rows += [(1000 * k + i, (c + 0.03 * rng.standard_normal(16)).tolist(), 0) for i in range(n)]
    rows += [(9000 + i, (centre + 0.3 * rng.standard_normal(16)).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    for options in ({"large": 8}, {"large": 8, "span": 20}):
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df, **options).collect()), key=repr)
        assert got == brute_vectors(rows), options
