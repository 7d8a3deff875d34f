"""Percentile bootstraps over many tasks, with the draws of one generator stream for each group.

The published intervals draw all resamples of a group from one PCG64 stream. Its
state can be moved ahead by any number of steps, so tasks take slices of it. A
draw takes one 32-bit word of the stream and, where the number of values doesn't
divide the words evenly, now and then rejects one, which shifts all that follow.
So slices first count the words they accept, running sums of these counts tell
in which slice a resample begins, and then each task draws its own resamples
from there. Means of groups of up to ``BLOCK`` values are bit for bit those of
the one stream; larger groups are summed in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..session import stored
from .places import placed, small

#: Words of a stream, or draws, that a task takes at a time; values of a group that travel as one array.
SLICE, BLOCK = 1 << 21, 1 << 20


def stream(seed: int, first: int, count: int) -> np.ndarray:
    """Words ``first`` to ``first + count`` of a seeded stream: each state gives two, the lower half first."""
    bits = np.random.PCG64(seed)
    bits.advance(first // 2)
    return bits.random_raw((first % 2 + count + 1) // 2).astype("<u8").view("<u4")[first % 2 :][:count]


def picks(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word is accepted, the value from 0 to n - 1 it picks), by the high half of its product with ``n``."""
    product = words.astype(np.uint64) * np.uint64(n)
    return (product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n), (product >> np.uint64(32)).astype(np.int64)


def enough(draws: int, n: int) -> int:
    """Words that hold so many accepted ones: those expected, and ten standard deviations more."""
    reject = ((1 << 32) % n) / (1 << 32)
    return math.ceil(draws / (1 - reject) + 10 * math.sqrt(draws * reject / (1 - reject) ** 2)) + 64 * (reject > 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, slice, accepted) of slices (g, seed, n, first, words, slice, length)."""
    for b in batches:
        out = [(r["g"], r["slice"], int(picks(stream(r["seed"], r["first"] + r["slice"] * r["length"], min(r["length"], r["words"] - r["slice"] * r["length"])), r["n"])[0].sum())) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["g", "slice", "accepted"])


def _slices(groups: DataFrame, resamples: int, length: int) -> DataFrame:
    """(g, seed, n, first, slice, before, accepted): how many draws of a group its slices before this one hold, and this one; of groups (g, seed, n, first)."""
    reject = F.pmod(F.lit(1 << 32), F.col("n")) / F.lit(float(1 << 32))
    draws = F.col("n").cast("double") * resamples
    # the words of ``enough``, as a column
    words = (F.ceil(draws / (1 - reject) + 10 * F.sqrt(draws * reject) / (1 - reject)) + F.when(reject > 0, 64).otherwise(0)).cast("long")
    cut = groups.withColumn("words", words).withColumn("length", F.lit(length).cast("long"))
    cut = cut.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("words") / length) - 1)))
    counted = stored(cut.repartition("g", "slice").mapInArrow(_count, "g long, slice long, accepted long"), "bootstrap-slices")
    before = F.sum("accepted").over(Window.partitionBy("g").orderBy("slice")) - F.col("accepted")
    return counted.withColumn("before", before).join(small(groups), "g")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, end): the word after the one that a group's last draw takes, of the slices that hold it."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            ok, _ = picks(stream(r["seed"], r["first"] + r["slice"] * r["length"], r["length"]), r["n"])
            out.append((r["g"], r["first"] + r["slice"] * r["length"] + int(np.flatnonzero(ok)[r["left"] - 1]) + 1))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], names=["g", "end"])


def stream_ends(groups: DataFrame, resamples: int = st.RESAMPLES, length: int = SLICE) -> DataFrame:
    """(g, end): where in its stream the draws of each group (g, seed, n, first) end. One value is picked without a draw."""
    many = groups.where("n > 1")
    left = F.col("n") * resamples - F.col("before")
    last = _slices(many, resamples, length).withColumn("left", left).where((F.col("left") > 0) & (F.col("left") <= F.col("accepted"))).withColumn("length", F.lit(length).cast("long"))
    return last.select("g", "seed", "n", "first", "slice", "length", "left").mapInArrow(_ends, "g long, end long").unionByName(groups.where("n <= 1").select("g", F.col("first").alias("end")))


def _draw(length: int):
    """(g, b, part): for the resamples of a range the sums of the values they pick in one block."""

    def accepted(r: dict) -> Iterator[np.ndarray]:
        """The picks of a range, in pieces: whole resamples where they fit in a piece."""
        at, skip, left = r["first"] + r["slice"] * length, r["skip"], (r["to"] - r["b"]) * r["n"]
        held = np.empty(0, np.int64)
        piece = max(1, length // r["n"]) * r["n"] if r["n"] <= length else length
        while left:
            count = min(length, skip + left + 64)
            ok, pick = picks(stream(r["seed"], at, count), r["n"])
            at, own = at + count, pick[ok]
            cut = min(skip, len(own))
            skip, own = skip - cut, own[cut:][:left]
            left -= len(own)
            held = np.concatenate((held, own))
            while len(held) >= piece or not left and len(held):
                yield held[:piece]
                held = held[piece:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("values"))
            rest = batch.drop_columns(["values"])
            for k, r in enumerate(rest.to_pylist()):
                own, n = values[k].values.to_numpy(zero_copy_only=False), r["n"]
                sums, at = np.zeros(r["to"] - r["b"]), 0
                for pick in accepted(r):
                    pick = pick - r["lo"]
                    got = own[pick] if len(own) == n else np.where((pick >= 0) & (pick < len(own)), own[np.clip(pick, 0, len(own) - 1)], 0.0)
                    while len(got):
                        whole = len(got) // n if at % n == 0 else 0
                        if whole:
                            sums[at // n : at // n + whole] = got[: whole * n].reshape(whole, n).sum(axis=1)
                            at, got = at + whole * n, got[whole * n :]
                        else:
                            part = got[: n - at % n]
                            sums[at // n] += part.sum()
                            at, got = at + len(part), got[len(part) :]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), r["g"])), pa.array(np.arange(r["b"], r["to"])), pa.array(sums)], names=["g", "b", "part"])

    return run


def _blocks(values: DataFrame, block: int) -> DataFrame:
    """(g, lo, values): a group's values (g, at, value) in arrays of ``block``."""
    lo = (F.floor(F.col("at") / block) * block).cast("long")
    one = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return values.groupBy("g", lo.alias("lo")).agg(one.alias("values"))


def resampled_means(values: DataFrame, groups: DataFrame, resamples: int = st.RESAMPLES, length: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(g, b, mean): means of the resamples of each group's values (g, at, value), ``at`` from 0; ``groups`` (g, seed, n, first)."""
    slices = _slices(groups, resamples, length)
    per = F.greatest(F.lit(1), F.floor(F.lit(length) / F.col("n"))).cast("long")
    size = F.col("per") * F.col("n")
    most = F.ceil(F.lit(resamples) / F.col("per")) - 1
    begin, end = F.ceil(F.col("before") / size), F.least(F.ceil((F.col("before") + F.col("accepted")) / size) - 1, most)
    begun = slices.withColumn("per", per).withColumn("from", begin.cast("long")).withColumn("until", end.cast("long")).where("until >= from")
    ranges = begun.withColumn("k", F.explode(F.sequence("from", "until"))).select(
        "g", "seed", "n", "first", "slice", (F.col("k") * size - F.col("before")).alias("skip"), (F.col("k") * F.col("per")).alias("b"), F.least(F.lit(resamples).cast("long"), (F.col("k") + 1) * F.col("per")).alias("to")
    )
    work = ranges.join(_blocks(values, block), "g")
    sums = work.repartition("g", "b", "lo").mapInArrow(_draw(length), "g long, b long, part double")
    return sums.groupBy("g", "b").agg(F.sum("part").alias("sum")).join(small(groups.select("g", "n")), "g").select("g", "b", (F.col("sum") / F.col("n")).alias("mean"))


def quantile(ordered: Column, size: int, q: float) -> Column:
    """A quantile of an array of ``size`` sorted values, between neighbours from the nearer one."""
    at = (size - 1) * q
    lo = math.floor(at)
    a, b, t = F.element_at(ordered, lo + 1), F.element_at(ordered, min(lo + 2, size)), at - lo
    return b - (b - a) * F.lit(1 - t) if t >= 0.5 else a + (b - a) * F.lit(t)


def bounds(means: DataFrame, resamples: int = st.RESAMPLES, level: float = st.LEVEL) -> DataFrame:
    """(g, low, high) of the means (g, b, mean): one row's worth of ``resamples`` numbers a group."""
    ordered = means.groupBy("g").agg(F.array_sort(F.collect_list("mean")).alias("m"))
    return ordered.select("g", *(quantile(F.col("m"), resamples, (1 + side * level) / 2).alias(name) for side, name in ((-1, "low"), (1, "high"))))


def _numbered(values: DataFrame, keys: tuple[str, ...], order: str) -> tuple[DataFrame, DataFrame]:
    """(values (g, at, value), groups (g, n, value, keys)): groups by number; few enough of them to be told apart by one task."""
    at = placed(values.select(*keys, order, "value"), keys, (order,))
    sized = stored(at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "bootstrap-groups")
    groups = stored(sized.withColumn("g", F.monotonically_increasing_id()), "bootstrap-numbers")
    on = None
    for k in keys:
        one = F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = one if on is None else on & one
    own = stored(at.alias("v").join(small(groups).alias("s"), on).select("s.g", "v.at", "v.value"), "bootstrap-values")
    return own, groups


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.values.to_numpy(zero_copy_only=False).sum() for v in b.column(2)], pa.float64())], names=["g", "sum"])


def intervals(values: DataFrame, keys: tuple[str, ...], seed: Column, order: str = "ord", resamples: int = st.RESAMPLES, length: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(keys, value, low, high): means and percentile intervals of rows (keys, order, value), with a ``seed`` for each group's stream."""
    own, groups = _numbered(values, keys, order)
    streams = groups.select("g", seed.cast("long").alias("seed"), "n", F.lit(0).cast("long").alias("first"))
    span = bounds(resampled_means(own, streams, resamples, length, block), resamples)
    means = _blocks(own, block).mapInArrow(_sums, "g long, sum double").groupBy("g").agg(F.sum("sum").alias("sum"))
    return groups.join(means, "g").join(span, "g").select(*keys, (F.col("sum") / F.col("n")).alias("value"), "low", "high")


def differences(values: DataFrame, keys: tuple[str, ...], side: str, seed: Column, order: str = "ord", resamples: int = st.RESAMPLES, length: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(keys, low, high): intervals of the mean where ``side`` is false less the mean where it is true.

    Both sides are drawn from one stream, the first side's resamples before the
    second's, which begin where those end. A group without rows on one side has (0, 0).
    """
    first = values.select(*keys, F.col(side).cast("int").alias("__side"), order, "value")
    own, groups = _numbered(first, (*keys, "__side"), order)
    streams = groups.select("g", "__side", *keys, seed.cast("long").alias("seed"), "n")
    a = streams.where("__side = 0").withColumn("first", F.lit(0).cast("long"))
    a = stored(a.join(stream_ends(a.select("g", "seed", "n", "first"), resamples, length), "g"), "bootstrap-ends")
    b = streams.where("__side = 1").alias("b")
    on = None
    for k in keys:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = one if on is None else on & one
    pairs = stored(a.alias("a").join(b, on).select(F.col("a.g").alias("ga"), F.col("b.g").alias("gb"), F.col("a.seed").alias("seed"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), "a.end", *(F.col(f"a.{k}").alias(k) for k in keys)), "bootstrap-pairs")
    both = pairs.select(F.col("ga").alias("g"), "seed", F.col("na").alias("n"), F.lit(0).cast("long").alias("first")).unionByName(pairs.select(F.col("gb").alias("g"), "seed", F.col("nb").alias("n"), F.col("end").alias("first")))
    means = stored(resampled_means(own.join(small(both.select("g")), "g"), both, resamples, length, block), "bootstrap-means")
    sign = pairs.select(F.col("ga").alias("g"), F.col("ga").alias("of"), F.lit(1.0).alias("sign")).unionByName(pairs.select(F.col("gb").alias("g"), F.col("ga").alias("of"), F.lit(-1.0).alias("sign")))
    diff = means.join(small(sign), "g").groupBy(F.col("of").alias("g"), "b").agg(F.sum(F.col("mean") * F.col("sign")).alias("mean"))
    spans = pairs.join(bounds(diff, resamples), pairs["ga"] == F.col("g")).select(*keys, "low", "high")
    every = groups.select(*keys).distinct()
    joined = every.alias("e").join(small(spans).alias("s"), [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "left")
    return joined.select(*(F.col(f"e.{k}").alias(k) for k in keys), F.coalesce("s.low", F.lit(0.0)).alias("low"), F.coalesce("s.high", F.lit(0.0)).alias("high"))
