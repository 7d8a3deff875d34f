import hashlib
import heapq
import itertools
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwick.llm import bpe, common, lm_scoring, mixing, quality, secrets
from tests.llm.test_dedup import brute_components, brute_print

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- mixing


def highest_quotients(votes, seats):
    won = [0] * len(votes)
    heap = [(-Fraction(v), j) for j, v in enumerate(votes)]  # the highest quotient first, of equal ones the first party
    heapq.heapify(heap)
    for _ in range(seats):
        i = heap[0][1]
        won[i] += 1
        heapq.heapreplace(heap, (-Fraction(votes[i]) / (2 * won[i] + 1), i))
    return won


@pytest.mark.parametrize("votes", [[53, 24, 23], [1, 1, 1], [0, 5, 0, 3], [1000, 1, 1, 1], [7], [340, 280, 160, 60, 15]])
def test_sainte_lague(votes):
    for seats in (0, 1, 2, 7, 15, 101):
        assert mixing.sainte_lague(votes, seats) == highest_quotients(votes, seats)


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, Fraction(250, 3), Fraction(500, 3)]
    assert mixing.targets([10, 1000], [3, 1]) == [20, 1495]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, 1.0) for r in rows], "doc_id bigint, text string, source string, size int, target double")
    return mixing.mix(df, **options)


def sources(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 90)), "b" if i % 3 else None if i % 2 else "a") for i in range(600)]
    return rows + [(700, None, "a"), (701, "", "c"), (702, " x\n\ty ", "d"), (None, "n n n", "d"), (3, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("options", [{}, {"shard_words": 500}, {"shard_words": 500, "block": 1}])
def test_mix(spark, options):
    rows = sources(spark)
    got = mixed(spark, rows, **options).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixed(spark, rows[::-1], **options).collect()))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(float(goal[r["source"]]))
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["epochs"] * r["size"] + sum(x["length"] for x in r["runs"])
        assert all(0 <= x["start"] and x["start"] + x["length"] <= r["size"] for x in r["runs"])
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(3, 0.02 * goal[s])
    assert len(got) == len(rows)


@pytest.mark.parametrize("options", [{}, {"shard_words": 500, "block": 7}])
def test_mix_row_by_row(spark, options):
    """What each document gives, by laying out the words of every shard; only the draws are taken from Spark."""
    long = " ".join(["w"] * 70_000)
    rows = [*sources(spark), (800, long, "b"), (801, long, "a")]
    seed, per_shard, block = 42, options.get("shard_words", mixing.SHARD_WORDS), options.get("block", mixing.BLOCK)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    drawn = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"], r["d"]) for r in df.select("*", F.xxhash64(F.lit(seed), "doc_id", F.length("text")).alias("d")).collect()]
    size = Counter()
    for _, n, s, _ in drawn:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    sizes = [size[s] for s in names]
    goals = mixing.targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])
    b = max(1, min(block, int(min(t for t in goals if t > 0) / 400)))
    quotas = highest_quotients(goals, round(sum(goals) / b))
    per_shard = max(per_shard, sum(sizes) // (mixing.MAX_SHARDS // 2) + 1)
    starts = {(r["s"], r["k"]): r["h"] for r in spark.range(len(names)).selectExpr("int(id) AS s").join(spark.range(400).selectExpr("int(id) AS k")).select("s", "k", F.xxhash64(F.lit(seed), "s", "k").alias("h")).collect()}
    want = []
    for k, s in enumerate(names):
        n_shards, shards = max(1, round(sizes[k] / per_shard)), {}
        for i, n, own, d in drawn:
            if own == s:
                shards.setdefault(d % n_shards, []).append((d, i is not None, i or 0, n, i))
        full = sorted(x for x, held in shards.items() if sum(r[3] for r in held))
        share = dict(zip(full, highest_quotients([sum(r[3] for r in shards[x]) for x in full], quotas[k])))
        for x, held in shards.items():
            held.sort()
            w = sum(r[3] for r in held)
            words = min(2 * w, share.get(x, 0) * b)
            at = b * (starts[k, x] % -(-w // b)) if w else 0
            taken = {(at + j) % w for j in range(words % w)} if w else set()
            lo = 0
            for _, _, _, n, i in held:
                want.append((i, n, (words // w * n if w else 0) + len(taken.intersection(range(lo, lo + n)))))
                lo += n
    got = [(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(df, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_mix_orders_rows_without_ids_by_number(spark, partitions):
    """Rows that tie in id and length are dealt to all shards, and taken alike however they are shuffled."""
    rows = [(None, f"w{i % 10} " + "x " * 9, "a", i) for i in range(4000)] + [(5, f"v{i % 10} y", "b", 4000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, row bigint")

    def decided(given):
        return sorted((r["row"], r["taken"], r["epochs"], [tuple(x) for x in r["runs"]]) for r in mixing.mix(given, row_col="row", shard_words=4000).collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = decided(df.coalesce(1))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert decided(df.orderBy(F.desc("row")).repartition(11)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    shares = {len(r[3]) for r in want if r[0] < 4000}
    assert len(want) == 4300 and len(shares) > 1  # a run begins and ends in each of ten shards


def test_mix_of_nothing(spark):
    assert mixed(spark, []).count() == 0
    assert [r["taken"] for r in mixed(spark, [(1, None, None), (2, "", "a")]).collect()] == [0, 0]


def test_apply_mix(spark):
    df = spark.createDataFrame([(i, t, s, len(t or ""), "e", 7, i) for i, t, s in sources(spark)], "doc_id bigint, text string, source string, n_chars bigint, epochs string, row int, __row bigint")
    out = mixing.apply_mix(df).collect()
    assert out[0].asDict().keys() == set(df.columns) and all((r["epochs"], r["row"], r["__row"]) == ("e", 7, r["doc_id"]) for r in out)
    assert mixing.apply_mix(df.limit(0)).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    decided = Counter()
    for r in mixing.mix(df).collect():
        decided[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == +decided


# ---------------------------------------------------------------- secrets


KEY = "AKIA" + "Q" * 12


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("", ""), ("password = hunter22", "assign:0:19"), ("password = short", ""), ('x API-KEY token : "abcdefgh12"', "assign:10:29"), ("token: secret: abcdefghijk", ""), ("é token=abcdefgh", "assign:2:16"), (f"🙂 {KEY} {KEY}", "access:2:18,access:19:35"),
        ("f" * 31, ""), ("0" * 32 + "G" + "a" * 40, "hex:0:32,hex:33:73"), ("secret=" + "a" * 32, "assign:0:39,hex:7:39"), ("PassWd:'x1234567'", "assign:0:16"), ("-----BEGIN RSA PRIVATE KEY-----", "private_key:0:31"), ("tokentoken=12345678", "assign:5:19"),
    ],
)
def test_spans(spark, text, want):
    r = secrets.secret_digests(spark.createDataFrame([(1, text, "q")], "doc_id bigint, text string, spans string")).first()
    assert r["spans"] == want
    base = ",".join(s for s in want.split(",") if s and s.split(":")[0] in ("assign", "access", "hex"))
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert [r["n_assign"], r["n_access"], r["n_hex"]] == [base.count(k) for k in ("assign:", "access:", "hex:")]


def test_base_kinds_against_python(spark, sf_dir):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in secrets.op9_secrets(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        t = d["text"] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert got[d["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_secrets_of_odd_rows(spark):
    far = "clean words " * 400_000
    rows = [(1, far + f"token=abcdefgh {KEY}", 0), (None, f"x {KEY}", 0), (None, f"x {KEY}", 0), (None, None, 0), (2, f"x {KEY}", 0), (2, f"x {KEY}", 0), (3, "f" * 3_000_000, 0)]
    got = secrets.secret_digests(spark.createDataFrame(rows, "doc_id bigint, text string, start int")).collect()
    assert sorted(((r["doc_id"], r["spans"]) for r in got), key=repr) == sorted(
        [(1, f"assign:{len(far)}:{len(far) + 14},access:{len(far) + 15}:{len(far) + 31}"), (None, ""), (3, "hex:0:3000000"), *[(i, "access:2:18") for i in (None, None, 2, 2)]], key=repr
    )


def test_the_ledger_scans_only_what_it_has_not_seen(spark):
    ledger = secrets.Ledger(spark, common.shared_path(spark, "test-ledger"))
    rows = lambda *x: spark.createDataFrame(list(x), "path string, version int, text string")
    old = rows(("a", 1, "token=abcdefgh"), ("a", 2, "clean"), ("b", 1, "token=abcdefgh"), ("c", 1, None))
    at, found = secrets.scan(old, ledger, secrets.BASE, keep=("path", "version"))
    assert at.count() == 4 and found.count() == 1 and ledger.scanned().count() == 3
    again = secrets.scan(old, ledger, secrets.BASE, keep=("path", "version"))
    assert ledger.scanned().count() == 3 and again[1].count() == 1
    new = rows(("b", 2, f"now {KEY}"), ("d", 1, "clean"))
    at, found = secrets.scan(new, ledger, secrets.BASE, keep=("path", "version"))
    assert ledger.scanned().count() == 4 and found.count() == 2
    newer = (secrets.Rule("hex", "[a-z]{5,}", version=2),)
    _, found = secrets.scan(old, ledger, newer, keep=("path", "version"))
    assert {(r["rule"], r["start"], r["end"]) for r in found.collect()} == {("hex:2", 0, 5), ("hex:2", 6, 14)}
    assert ledger.findings().count() == 5 and secrets.secret_digests(old.limit(0).withColumn("doc_id", F.lit(1))).count() == 0


# ---------------------------------------------------------------- language model


def brute_scores(texts, order=2, alpha=0.4):
    docs = [WORD.findall(t or "") for t in texts]
    grams = [Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1)) for d in docs]
    total = sum(grams, Counter())
    n_all, out = sum(map(len, docs)), []
    for d, own in zip(docs, grams):
        rest, score, backed = lambda g, own=own: total[g] - own[g], 0.0, 0
        for i in range(len(d)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                g = tuple(d[i - n + 1 : i + 1])
                if rest(g) > 0:
                    score += math.log(alpha ** (top - n) * rest(g) / (rest(g[:-1]) if n > 1 else n_all - len(d)))
                    break
            else:
                n = 0
                score += math.log(alpha**top / max(1, n_all - len(d)))
            backed += n < top
        out.append((len(d), backed, score / len(d) if d else None))
    return out


@pytest.mark.parametrize(("order", "chars"), [(1, 1 << 22), (2, 1 << 22), (3, 40), (2, 5)])
def test_scores_against_a_loop(spark, order, chars):
    texts = ["a b c a b", "a b d", "", None, "zebra", "a b c a b", "x\n\ty a", "the " * 300, "c a b c"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "a b", 0.5)], "doc_id bigint, text string, log_score double").repartition(3)
    want = brute_scores([*texts, "a b"], order)
    got = {r["doc_id"]: r for r in lm_scoring.backoff_scores(df, order, block_chars=chars).collect()}
    for i, w in zip([*range(len(texts)), None], want):
        r = got[i]
        assert (r["n_tokens"], r["n_backoff"]) == w[:2] and (r["log_score"] is None if w[2] is None else r["log_score"] == pytest.approx(w[2]))
    assert lm_scoring.backoff_scores(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in lm_scoring.backoff_scores(df.where("doc_id = 3")).collect()] == [(0, 0, None)]


def test_blocks_hold_when_rows_come_in_another_order(spark):
    """A table read in other splits, and rows that no file holds, are dealt to the same blocks by both uses."""
    texts = [f"w{i % 7} w{i % 5} w{i % 3}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: w for i, w in enumerate(brute_scores(texts))}
    for rows in (df.repartition(7).orderBy(F.rand()), common.stored(df.repartition(5), "test-lm")):
        for r in lm_scoring.backoff_scores(rows, block_chars=100).collect():
            assert (r["n_tokens"], r["n_backoff"]) == want[r["doc_id"]][:2] and r["log_score"] == pytest.approx(want[r["doc_id"]][2])
    held = common.stored(df.repartition(5), "test-lm")
    assert [common.is_table(x) for x in (held, held.where("doc_id > 3").select("text"), df, held.join(df, "doc_id"), held.orderBy("text"), held.groupBy("text").count())] == [True, True, False, False, False, False]
    assert sorted(common.with_row_hash(held, "_metadata").select("_metadata").distinct().count() for _ in "ab") == [200, 200]


def test_levels():
    assert lm_scoring.fanned(1) == (1, 1) and lm_scoring.fanned(199) == (1, 199) and lm_scoring.fanned(1 << 14) == (1, 1 << 14)
    assert lm_scoring.fanned((1 << 14) + 1) == (2, 129) and lm_scoring.fanned(1 << 28) == (2, 1 << 14)
    for blocks in range(1, 300):
        for most in (2, 3, 10):
            levels, fan = lm_scoring.fanned(blocks, most)
            assert fan <= most and fan**levels >= blocks and (levels == 1 or most ** (levels - 1) < blocks)


@pytest.mark.parametrize(("chars", "most"), [(300, 6), (100, 4), (200, 2)])
def test_scores_through_levels(spark, chars, most):
    """Blocks that reach the owners of ranges in two levels and more know the same totals; a sender deals to ``most`` owners at most."""
    texts = [f"the w{i % 7} w{i % 11} the {'x ' * (i % 3)}u{i}" for i in range(150)]
    df = common.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "test-lm-levels")
    blocks = -(-sum(map(len, texts)) // chars)
    assert lm_scoring.fanned(blocks, most)[0] >= 2
    want = brute_scores(texts, 3)
    got = lm_scoring.backoff_scores(df, 3, block_chars=chars, most=most).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(150))
    for r in got:
        assert (r["n_tokens"], r["n_backoff"]) == want[r["doc_id"]][:2] and r["log_score"] == pytest.approx(want[r["doc_id"]][2])


def test_a_sender_deals_to_few_owners():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64))
    met, fan = {(5, 0): [(keys, np.ones(len(keys), np.int64))]}, 10
    for level in range(3):
        sent = {}
        for (group, _), given in met.items():
            for k, n in given:
                rows = lm_scoring._send(k, n, group, level, fan)
                assert rows.num_rows <= fan and len(set(rows.column("owner").to_pylist())) == rows.num_rows
                for owner in rows.group_by("owner").aggregate([]).column("owner").to_pylist():
                    part = rows.filter(pa.compute.equal(rows.column("owner"), owner))
                    table, at, _ = lm_scoring._met(part)
                    sent[owner, level] = [(table, lm_scoring._sums(part, at, len(table)))]
        met = sent
    assert len(met) == len({owner for owner, _ in met}) <= fan**3
    assert (np.sort(np.concatenate([k for given in met.values() for k, _ in given])) == keys).all()


def test_packing():
    x = np.array([0, 1, 2**63, 2**64 - 1, 7], np.uint64)
    assert (lm_scoring._unpacked(lm_scoring._packed(x)) == x).all()


# ---------------------------------------------------------------- quality


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    keys = np.concatenate((quality.sortable(rng.standard_normal(300) * 1e3), quality.sortable(np.array([0.0, -0.0, 5.0, 5.0, -7.5]))))
    df = spark.createDataFrame([(int(k),) for k in keys], "key bigint")
    for k in (1, 2, 150, len(keys)):
        assert quality.kth_largest(df, k) == sorted(keys.tolist(), reverse=True)[k - 1]
    x = np.array([-np.inf, -3.5, -0.0, 1e-300, 2.0])
    assert (np.diff(quality.sortable(x)) > 0).all()


def test_gumbel_top_k_samples_by_weight():
    ids = np.arange(200_000)
    g = quality.gumbel(ids, 1)
    assert abs(g.mean() - 0.5772) < 0.02 and abs(g.std() - math.pi / 6**0.5) < 0.02 and (g == quality.gumbel(ids, 1)).all() and (g != quality.gumbel(ids, 2)).all()
    a, b = g[:100_000] + math.log(3), g[100_000:]
    assert abs((a > b).mean() - 0.75) < 0.01


def test_features_in_steps(monkeypatch):
    text = "One two two, three!! " * 40
    whole = np.sort(np.concatenate(list(quality.features(text, quality._Hashes()))))
    monkeypatch.setattr(quality, "_STEP", 7)
    assert (np.sort(np.concatenate(list(quality.features(text, quality._Hashes())))) == whole).all()
    assert not len(list(quality.features("", quality._Hashes())))


def test_resampling(spark):
    good = [(i, f"the river and house {i % 17} were near the old mill, and it was warm.") for i in range(300)]
    bad = [(1000 + i, f"BUY!! NOW$$$ {i} CHEAP!! CLICK### HERE!! WIN%%%") for i in range(60)]
    df = spark.createDataFrame([(i, t, 2.0) for i, t in good + bad] + [(2000, None, 1.0), (None, "the old mill", 1.0), (3, good[3][1], 1.0)], "doc_id bigint, text string, key double")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:40]] + [(5, 0), (None, 1), (7, None), (99999, 1)], "doc_id bigint, quality int")
    got = quality.resample(df, labels).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(got) == df.count() and {i for i, _ in good} <= kept and not kept & {i for i, _ in bad[:40]}
    k = quality.resample(df, labels, k=50).where("kept").count()
    assert 50 <= k <= 51
    assert quality.resample(df, labels.limit(0)).where("kept").count() == df.count()
    assert quality.resample(df.limit(0), labels).count() == 0 and quality.resample(df, labels, k=0).where("kept").count() == 0


@pytest.mark.parametrize("sharpness", [quality.SHARPNESS, None])
def test_resampling_against_a_loop(spark, sharpness):
    """Weights, sums and decisions by dictionaries, with the noise as it is."""
    n_buckets, rng = quality.BUCKETS, np.random.default_rng(4)
    texts = [" ".join(rng.choice(["sun", "sun", "rain", "buy", "win", "!!", "now", "$$"], rng.integers(0, 30))) for _ in range(60)] + [None, "", "the " * 50_000]
    labels = {i: int("buy" not in (t or "")) for i, t in enumerate(texts) if i % 2}

    def buckets(text):
        h = [xxhash.xxh32_intdigest(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
        return [x % n_buckets for x in h], [n_buckets + (0 if a == b else (((a * 0x9E3779B1 + b) * 0xC2B2AE3D27D4EB4F) % 2**64 >> 40) % n_buckets) for a, b in zip(h, h[1:])]

    log = {}
    for half in (0, 1):
        raw, target = Counter(), Counter()
        for i, t in enumerate(texts):
            raw.update(buckets(t)[half])
            if labels.get(i):
                target.update(buckets(t)[half])
        n_raw, n_target = sum(raw.values()) + n_buckets, sum(target.values())
        for b in raw:
            p = (raw[b] + 1) / n_raw
            log[b] = math.log((target[b] + quality.PRIOR * p) / (n_target + quality.PRIOR) / p)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in quality.resample(df, spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int"), sharpness=sharpness).collect()}
    noise, sums = quality.gumbel(np.arange(len(texts)), 5), {}
    for i, t in enumerate(texts):
        own = sum(buckets(t), [])
        weight = sum(log[b] for b in own) * (1 if sharpness is None else sharpness / max(1, len(own)))
        assert got[i]["n_grams"] == len(own) and got[i]["log_weight"] == pytest.approx(weight, rel=1e-4, abs=1e-4)
        sums[i] = got[i]["log_weight"] + noise[i]
        assert got[i]["key"] == quality.sortable(np.array([sums[i]]))[0]
    k = round(len(texts) * sum(labels.values()) / len(labels))
    assert {i for i in got if got[i]["kept"]} == set(sorted(sums, key=lambda i: -sums[i])[:k])


def test_the_fitted_factor_is_a_logistic_slope(spark):
    """Labelled texts measured with the other half's counts, by dictionaries; the slope by bisection of its equations."""
    rng, n = np.random.default_rng(8), quality.BUCKETS
    texts = [" ".join(rng.choice(["sun", "rain", "mill", "buy", "win"], 12, p=[0.3, 0.3, 0.2, 0.1, 0.1] if i % 3 else [0.1, 0.2, 0.1, 0.3, 0.3])) for i in range(90)]
    labels = {i: int(i % 3 > 0) for i in range(80)}
    df, given = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")
    halves = {r["doc_id"]: r["h"] for r in given.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("h")).collect()}
    raw, targets = np.zeros(2 * n, np.int64), np.zeros((2, 2 * n), np.int64)
    held = {i: np.concatenate(list(quality.features(t, quality._Hashes()))) for i, t in enumerate(texts)}
    for i, f in held.items():
        np.add.at(raw, f, 1)
        if labels.get(i):
            np.add.at(targets[halves[i]], f, 1)
    x = np.array([quality.ratios(raw, targets[1 - halves[i]])[held[i]].mean(dtype=np.float64) for i in labels])
    y = np.array([labels[i] for i in labels], float)
    z = (x - x.mean()) / x.std()

    def bias_of(w):  # the bias at which the sum of probabilities is that of labels
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if (1 / (1 + np.exp(-(z * w + (lo + hi) / 2)))).sum() < y.sum() else (lo, (lo + hi) / 2)
        return lo

    lo, hi = 0.0, 100.0
    for _ in range(200):
        w = (lo + hi) / 2
        rest = (z * (y - 1 / (1 + np.exp(-(z * w + bias_of(w)))))).sum() - quality.FLAT * w
        lo, hi = (w, hi) if rest > 0 else (lo, w)
    got = {r["doc_id"]: r["log_weight"] for r in quality.resample(df, given).collect()}
    plain = quality.ratios(raw, targets.sum(axis=0))
    for i in (0, 1, 85):
        assert got[i] == pytest.approx(lo / x.std() * plain[held[i]].mean(dtype=np.float64), rel=1e-3)


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    got = quality.resample(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id")
    good = got.where("quality = 1")
    assert good.where("kept").count() / good.count() > 0.9
    bad = got.where("quality = 0")
    assert bad.where("kept").count() / max(1, bad.count()) < 0.5


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_plain_python(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    docs = docs.union(docs.limit(3))  # repeated rows
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or docs.columns
        docs = common.stored(stage(spark, docs, sf_dir), f"test-{k}")
        assert k == 4 or docs.columns == columns
        kept.append(docs.collect())
    judged, exact, near, mix, coded = kept
    first = {}
    for r in sorted(judged, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[ \t-\r]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(first.values())
    prints = {r["doc_id"]: brute_print(r["text"]) for r in exact}
    roots = brute_components(list(prints), list(prints.values()))
    assert sorted(r["doc_id"] for r in near) == sorted(set(roots.values()))
    decided = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(near, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    words = Counter()
    for r in mix:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == +Counter(decided)
    b = bpe.Bpe(bpe.default_path())
    want = sorted((r["doc_id"], *b.digest(b.encode(r["text"]))) for r in mix)
    assert sorted(map(tuple, coded)) == want
    assert sum(1 for _ in itertools.islice(coded, 1)) == 1


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Null ids, texts, sources and languages, empty texts, repeated rows, columns named as the stages' own, and nothing at all."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, group string, doc int, __kept string, kept string"
    some = [(1, "the river and the old mill", "en", "a", 26), (None, "the river and the old mill", None, None, 26), (2, None, "en", "a", 0), (3, "", None, "b", 0), (3, "", None, "b", 0), (None, None, None, None, None), (4, "word " * 30_000, "en", "b", 150_000)]
    docs = common.stored(spark.createDataFrame([(*r, "r", "g", 1, "k", "k") for r in some], schema), "test-odd")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, common.stored(docs.limit(0), "test-none"), sf_dir)
        got = stage(spark, docs, sf_dir)
        if k < 4:
            assert empty.columns == got.columns == docs.columns and empty.count() == 0
        rows = got.collect()
        texts = sorted((r["text"] or "" for r in rows), key=len) if k < 4 else []
        if k in (1, 2):
            assert texts == ["", some[0][1], some[6][1]] and {r["doc_id"] for r in rows} == {1, 2, 4}
        if k == 3:
            assert all(texts) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if k == 4:
            assert len(rows) == 7 and sorted(r["n_tokens"] for r in rows)[:4] == [0] * 4


def test_pipeline_keeps_one_row_of_each_group(spark):
    rows = [(5, "a b c d"), (3, "a  b c d"), (3, "e f g h"), (3, "e f g h"), (3, "i j k l"), (None, "m n o p"), (None, "m n o p"), (None, "i j k l"), (None, "q r s t"), (7, "u v w x"), (7, "a b c d")]
    docs = common.stored(spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars int").repartition(3), "test-ids")
    want = sorted([(3, "a  b c d"), (3, "e f g h"), (3, "i j k l"), (None, "m n o p"), (None, "q r s t"), (7, "u v w x")], key=repr)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        got = stage(spark, docs, "")
        if stage is corpus_pipeline.drop_near_copies:  # white space isn't part of a shingle, so the groups are the same
            prints = {brute_print(t) for _, t in rows}
            assert len(prints) == 6 and len(set(brute_components(list(range(6)), list(prints)).values())) == 6
        assert got.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == want
