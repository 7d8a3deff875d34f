import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import statistics as st
from tarnwick.operators import bootstrap as bs
from tarnwick.operators.places import placed


@pytest.mark.parametrize("n", [2, 3, 36, 1000, 10**6, 3 << 30, (1 << 32) - 1])
def test_picks_are_the_generators(n):
    want = np.random.default_rng(77).integers(0, n, 5000)
    for first, count in ((0, 12000), (1, 7), (4097, 50), (5000, 1)):
        assert bs.stream(77, first, count).tolist() == bs.stream(77, 0, 12000)[first : first + count].tolist()
    ok, pick = bs.picks(bs.stream(77, 0, bs.enough(5000, n)), n)
    assert ok.sum() >= 5000 and pick[ok][:5000].tolist() == want.tolist()


def frame(spark, groups):
    rows = [(k, i, float(v)) for k, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, ord long, value double").repartition(7)


GROUPS = {"a": np.random.default_rng(0).random(37), "b": np.round(np.random.default_rng(1).random(5), 4), "one": [0.25], None: np.arange(11) / 7, "same": [0.5] * 20, "wide": np.random.default_rng(2).random(3001)}


@pytest.mark.parametrize("length", [64, 1 << 12, bs.SLICE])
def test_intervals_equal_one_stream(spark, length):
    seeds = {k: 1000 + 7 * i for i, k in enumerate(GROUPS)}
    seed = F.coalesce(*(F.when(F.col("key").eqNullSafe(k), F.lit(s)) for k, s in seeds.items()))
    got = {r["key"]: r for r in bs.intervals(frame(spark, GROUPS), ("key",), seed, resamples=400, length=length).collect()}
    assert got.keys() == GROUPS.keys()
    for k, values in GROUPS.items():
        low, high = st.bootstrap_interval(np.asarray(values), seeds[k], 400)
        same = (lambda x: x) if len(values) <= length else (lambda x: pytest.approx(x, abs=1e-12))
        assert (got[k]["low"], got[k]["high"]) == same((low, high)), k
        assert got[k]["value"] == pytest.approx(np.mean(values), abs=1e-12)


def test_values_in_blocks(spark):
    got = bs.intervals(frame(spark, {"wide": GROUPS["wide"]}), ("key",), F.lit(5), resamples=50, length=1 << 12, block=700).first()
    assert (got["low"], got["high"]) == pytest.approx(st.bootstrap_interval(GROUPS["wide"], 5, 50), abs=1e-12)


def test_a_large_group_is_many_tasks(spark):
    values = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id").alias("ord"), (F.pmod(F.col("id") * 7919, F.lit(1009)) / 1009.0).alias("value"))
    v = (np.arange(1_000_000) * 7919 % 1009) / 1009.0
    got = bs.intervals(values, ("key",), F.lit(3), resamples=6).first()
    assert (got["low"], got["high"]) == st.bootstrap_interval(v, 3, 6)
    groups = spark.createDataFrame([(0, 3, 1_000_000, 0)], "g long, seed long, n long, first long")
    assert bs._slices(groups, 6, bs.SLICE).count() >= 3  # each slice is work of its own


@pytest.mark.parametrize("length", [64, bs.SLICE])
def test_differences_equal_one_stream(spark, length):
    rng = np.random.default_rng(4)
    sides = {"x": (rng.random(13), rng.random(29)), "y": (rng.random(1), rng.random(8)), "z": (rng.random(6), []), "w": (rng.random(30), rng.random(1))}
    rows = [(k, s == 1, 10 * i + s, float(v)) for k, both in sides.items() for s, values in enumerate(both) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, hit boolean, ord long, value double").repartition(5)
    got = {r["key"]: (r["low"], r["high"]) for r in bs.differences(df, ("key",), "hit", F.lit(99), resamples=300, length=length).collect()}
    assert got == {k: st.difference_interval(np.asarray(a), np.asarray(b), 99, 300) for k, (a, b) in sides.items()}


def test_rejections_move_the_second_side(spark):
    """A third of a million values: words are rejected, and the other side begins after them."""
    n = 3 << 20
    groups = spark.createDataFrame([(0, 12, n, 5)], "g long, seed long, n long, first long")
    end = bs.stream_ends(groups, 2).first()["end"]
    words = bs.stream(12, 5, 2 * n + 100_000)
    ok, _ = bs.picks(words, n)
    assert end == 5 + int(np.flatnonzero(ok)[2 * n - 1]) + 1 and not ok.all()


def test_no_groups(spark):
    empty = spark.createDataFrame([], "key string, hit boolean, ord long, value double")
    assert bs.intervals(empty, ("key",), F.lit(1)).count() == 0 and bs.differences(empty, ("key",), "hit", F.lit(1)).count() == 0


def test_places(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 > 0, "s").alias("n"), (F.col("id") * 7919 % 5003).alias("o"))
    want = {}
    for r in sorted(df.collect(), key=lambda r: r["o"]):
        want.setdefault((r["k"], r["n"]), []).append(r["o"])
    got = placed(df, ("k", "n"), ("o",)).collect()
    assert len(got) == 5000 and all(want[r["k"], r["n"]][r["at"]] == r["o"] for r in got)
    assert placed(df.limit(0), ("k",), ("o",)).count() == 0
    assert sorted(r["at"] for r in placed(df, (), ("o",)).collect()) == list(range(5000))
