"""Statistics of paired evaluations: rounding, seeds, bootstrap intervals, the sign test."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Resamples, seed, confidence level, and the difference that counts as none.
RESAMPLES, SEED, LEVEL, TOLERANCE = 10_000, 20260917, 0.95, 1e-12


#: Draws held at a time.
DRAWS = 1 << 22


def derived_seed(base: int, label: str) -> int:
    """A seed of its own for each label."""
    return (base + zlib.crc32(label.encode())) % (1 << 32)


def derived_seed_column(base: int, label: Column) -> Column:
    """``derived_seed`` of a column of labels."""
    return F.pmod(F.lit(base) + F.crc32(label.cast("binary")), F.lit(1 << 32))


def round_half_even(x: Column, places: int = 4) -> Column:
    """``x`` to some decimal places, to the nearest value and on exact ties to the even one, of the exact binary value, as Python rounds.

    The product with the power of ten is taken with its rounding error: a double
    splits into halves whose products are exact (Veltkamp, Dekker), so a tie is
    told from what only looks like one. Beyond 2**39 doubles lie too far apart
    for four places to matter.
    """
    if not 0 <= places <= 4:
        raise ValueError("places must be 0 to 4")
    ten, a = F.lit(10.0**places), F.abs(x)
    spread = a * F.lit(134217729.0)  # 2**27 + 1
    high = spread - (spread - a)
    low = a - high
    product = a * ten
    error = (high * ten - product) + low * ten
    down = F.floor(product).cast("double")
    over = (product - down - F.lit(0.5)) + error
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.pmod(down, F.lit(2.0)))
    return F.when(F.isnan(x) | (a >= F.lit(float(1 << 39))), x).otherwise((down + up) / ten * F.signum(x))


def round_4(x: Column | str) -> Column:
    """Four places, as values are stored."""
    return round_half_even(F.col(x) if isinstance(x, str) else x, 4)


def _resampled_means(rng: np.random.Generator, values: np.ndarray, resamples: int) -> np.ndarray:
    """Means of resamples, some rows of draws at a time: a stream gives the same draws however it is cut."""
    n = len(values)
    step = max(1, DRAWS // n)
    return np.concatenate([values[rng.integers(0, n, (min(step, resamples - lo), n))].mean(axis=1) for lo in range(0, resamples, step)])


def bootstrap_interval(values: np.ndarray, seed: int, resamples: int = RESAMPLES, level: float = LEVEL) -> tuple[float, float]:
    """Percentile bootstrap of the mean; (0, 0) without values."""
    values = np.asarray(values, float)
    if not len(values):
        return 0.0, 0.0
    means = _resampled_means(np.random.default_rng(seed), values, resamples)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def difference_interval(a: np.ndarray, b: np.ndarray, seed: int, resamples: int = RESAMPLES, level: float = LEVEL) -> tuple[float, float]:
    """Bootstrap of the difference of two groups' means, both drawn from one stream, ``a`` first; (0, 0) if one is empty."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = [_resampled_means(rng, np.asarray(g, float), resamples) for g in (a, b)]
    low, high = np.quantile(means[0] - means[1], [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def sign_test(better: int, worse: int) -> float:
    """Exact two-sided sign test on the pairs that differ; 1 without any."""
    n, k = better + worse, min(better, worse)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def sign_test_column(better: Column, worse: Column) -> Column:
    """``sign_test`` as a Column, in doubles: the binomial tail by a running product, and beyond a thousand pairs, where its first term would vanish, as its largest term by logarithms times the sum of the terms' ratios to it."""
    n, k = (better + worse).cast("double"), F.least(better, worse).cast("int")
    upto = F.sequence(F.lit(0), k)

    def summed(first: Column, factor) -> Column:
        start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
        step = lambda s, i: F.struct((s["term"] * factor(i)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
        return F.aggregate(upto, start, step, lambda s: s["sum"])

    few = summed(F.pow(F.lit(0.5), n), lambda i: (n - i) / (i + F.lit(1.0)))
    # the term of index 0 adds nothing
    largest = F.aggregate(upto, F.lit(0.0), lambda s, i: s + F.when(i > 0, F.log((n - i + F.lit(1.0)) / i)).otherwise(F.lit(0.0)))
    many = F.exp(largest - n * F.lit(math.log(2))) * summed(F.lit(1.0), lambda i: (k - i) / (n - k + i + F.lit(1.0)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * F.when(n <= 1000, few).otherwise(many)))
