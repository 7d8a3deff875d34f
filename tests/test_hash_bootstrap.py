import numpy as np
import pytest

from tarnwick.operators import evaluation as ev


def looped(values, resamples, modulus):
    """Means by a loop over all draws; nulls among the picks don't count."""
    n, out = len(values), []
    for b in range(resamples):
        own = [values[(b * 7919 + j * 104_729 + b * j * 31) % modulus % n] for j in range(n)]
        own = [v for v in own if v is not None]
        out.append(sum(own) / len(own) if own else None)
    return out


@pytest.mark.parametrize("modulus", [101, 1000, 1_000_003])
def test_groups_of_any_size_and_nulls(spark, modulus):
    rng = np.random.default_rng(8)
    groups = {"few": [0.5, 0.25], "some": rng.random(90).tolist(), None: rng.random(101).tolist(), "many": rng.random(5000).tolist(), "nulls": [None if k % 3 else k / 7 for k in range(250)], "none": [None] * 4}
    rows = [(k, i, v) for k, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, ord long, value double").repartition(5)
    got = {}
    for r in ev._hash_means(df, ("key",), 12, modulus, 7919, 104_729).collect():
        got.setdefault(r["key"], {})[r["__b"]] = r["mean"]
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        want = looped(values, 12, modulus)
        assert [got[k][b] for b in range(12)] == [w if w is None else pytest.approx(w, abs=1e-12) for w in want]


def test_draws_beyond_the_modulus_are_counted_not_drawn():
    """A group of 10^15 values is no more work than one of ``modulus``: in whole cycles all residues are picked alike."""
    drawn = np.arange(101, dtype=float)[:, None]
    assert ev._hash_sums(drawn, 5, 101 * 10**13, 101, 7919, 104_729)[0] == pytest.approx(5050e13)
