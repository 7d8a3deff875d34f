"""Quality selection by importance resampling.

Two generative models of hashed n-grams (words and runs of marks, alone and in
pairs) are counted: one over target texts, those of a bounded sample of labelled
rows with quality 1, one over all raw texts. A document's importance weight is
the ratio of its likelihoods under the two. Over a whole text that ratio says
more of its length than of what it is, so it is tempered: the log weight is the
mean log ratio of the n-grams times a factor, fitted to the labelled sample. With
one factor b the weights are calibrated if the log odds of quality 1 rise by b
for each unit of the mean, so b is the slope of a logistic model. Each labelled
text is measured with target counts of the other half of the sample, so none is
measured by itself. Pairs of equal words share a bucket, as a repeated word is
one thing to both models whatever the word. Resampling without replacement keeps
the k largest sums of log weight and Gumbel noise. k follows from the share of
quality 1 among the labelled sample, unless it is given.

The k-th largest sum is found exactly by four rounds of 65,536 counts on the
driver; scores stay on shared files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .logistic import logistic

#: Buckets for words, and as many for pairs; labelled rows that are read at most (those with the smallest hashes).
BUCKETS, MAX_LABELS = 1 << 16, 50_000
#: Counts added to each bucket of both models, in proportion to the raw model; the factor of the mean where no label is 0, or none is 1, so that none can be fitted.
PRIOR, SHARPNESS = 1 << 14, 100.0
#: Pull of the factor to zero: none to speak of, but an end to it where the labels part without error.
FLAT = 1e-6
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens a worker remembers; tokens of a text it holds at a time.
_REMEMBERED, _STEP = 300_000, 1 << 18


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        self[token] = h = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def features(text: str, hashes: dict) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, a bounded number at a time: words below BUCKETS, pairs above; all pairs of equal words share one."""
    tokens = map(hashes.__getitem__, _TOKEN.findall(text))
    last = np.empty(0, np.uint64)
    while len(part := np.fromiter((t for _, t in zip(range(_STEP), tokens)), np.uint64)):
        run = np.concatenate((last, part))
        pairs = (run[:-1] * np.uint64(0x9E3779B1) + run[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
        pairs[run[:-1] == run[1:]] = 0
        yield np.concatenate((part % BUCKETS, pairs % BUCKETS + BUCKETS)).astype(np.int64)
        last = part[-1:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, target0, target1): n-grams of all texts, and of good ones by half of the sample."""
    raw, hashes = np.zeros(2 * BUCKETS, np.int64), _Hashes()
    target = np.zeros((2, 2 * BUCKETS), np.int64)
    for batch in batches:
        for text, good, half in zip(*batch.columns):
            own = target[half.as_py()] if good.as_py() == 1 else None
            for f in features(text.as_py() or "", hashes):
                if len(f) > BUCKETS:
                    n = np.bincount(f, minlength=2 * BUCKETS)
                    raw += n
                    if own is not None:
                        own += n
                else:
                    np.add.at(raw, f, 1)
                    if own is not None:
                        np.add.at(own, f, 1)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in (raw, *target))], names=["bucket", "raw", "target0", "target1"])


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket, words and pairs each a distribution; the prior follows the raw model."""
    out = np.zeros(2 * BUCKETS)
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        r, t = raw[half] + 1.0, target[half].astype(float)
        p = r / r.sum()
        out[half] = np.log((t + PRIOR * p) / (t.sum() + PRIOR) / p)
    return out.astype(np.float32)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise that depends on id and seed alone."""
    x = ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _log_ratio(text: str | None, table: np.ndarray, hashes: dict) -> tuple[int, float]:
    """A text's number of n-grams and the sum of their log ratios."""
    n, total = 0, 0.0
    for f in features(text or "", hashes):
        n += len(f)
        total += table[f].sum(dtype=np.float64)
    return n, total


def _scores(table: np.ndarray, seed: int, sharpness: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                n[k], total[k] = _log_ratio(text.as_py(), table, hashes)
            weight = total if sharpness is None else sharpness * total / np.maximum(n, 1)
            ids = batch.column(0).fill_null(-1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(sortable(weight + gumbel(ids, seed)))], names=["doc_id", "n_grams", "log_weight", "key"])

    return run


def _means(tables: list[np.ndarray]):
    """(id, quality, mean): mean log ratios of labelled texts, each by the table of its half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sums = [_log_ratio(text.as_py(), tables[half.as_py()], hashes) for text, half in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([total / max(1, n) for n, total in sums], pa.float64())], names=["id", "quality", "mean"])

    return run


def fitted(labelled: DataFrame, raw: np.ndarray, targets: np.ndarray) -> float:
    """The factor of the mean log ratio that calibrates the weights: a logistic slope, 0 at least. ``labelled`` (id, quality, text, half) has some row for each id."""
    tables = [ratios(raw, targets[1]), ratios(raw, targets[0])]
    means = labelled.mapInArrow(_means(tables), "id long, quality int, mean double").groupBy("id").agg(F.max("quality").alias("quality"), F.avg("mean").alias("mean"))
    rows = np.array([(r["mean"], r["quality"] == 1) for r in means.collect()], float).reshape(-1, 2)
    if len(set(rows[:, 1])) < 2:
        return SHARPNESS
    return max(0.0, float(logistic(rows[:, :1], rows[:, 1], FLAT)[1][0]))


def kth_largest(scores: DataFrame, k: int) -> int:
    """The k-th largest ``key``, by its 16-bit digits from the first."""
    at = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift)
        rows = scores.where(F.shiftright("key", shift + 16) == at) if shift < 48 else scores
        counts = rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["d"]):
            if k <= r["n"]:
                at = r["d"]
                break
            k -= r["n"]
    return at


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS, seed: int = 5, sharpness: float | str | None = "fitted") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, key, kept.

    ``labels`` (doc_id, quality): of more than ``max_labels`` rows those with
    the smallest hashes of their ids are read; an id with several labels counts
    as good if one of them is 1. Without labels, or without good ones, all
    weights are 0 and all is kept (or k rows by noise alone). A null or empty
    text has weight 0, very long ones are read whole. ``sharpness`` is the
    factor of the mean log ratio, fitted unless a number is given; None gives
    the plain ratio, of the whole text. Rows whose sums are equal, as repeated rows' are, stand
    or fall together, so a few more than k may stay. An empty table gives no
    rows; extra columns aren't read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)).cast("int")), "quality-labels")
    good, n_labels = (x or 0 for x in sample.agg(F.sum((F.col("quality") == 1).cast("long")), F.count(F.lit(1))).first())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw, targets = np.zeros(2 * BUCKETS, np.int64), np.zeros((2, 2 * BUCKETS), np.int64)
    if good:
        counts = texts.join(F.broadcast(sample), "doc_id", "left").select("text", "quality", "half").mapInArrow(_counts, "bucket long, raw long, target0 long, target1 long")
        for r in counts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "target0", "target1"))).collect():
            raw[r["bucket"]], targets[0, r["bucket"]], targets[1, r["bucket"]] = r["raw"], r["target0"], r["target1"]
    if sharpness == "fitted":
        labelled = texts.join(F.broadcast(sample), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"), "text", "half")
        sharpness = fitted(labelled, raw, targets) if good else SHARPNESS
    scores = stored(texts.mapInArrow(_scores(ratios(raw, targets.sum(axis=0)), seed, sharpness), "doc_id long, n_grams long, log_weight double, key long"), "quality-scores")
    n = scores.count()
    if k is None:
        k = round(n * good / n_labels) if good else n
    if k >= n:
        return scores.withColumn("kept", F.lit(True))
    return scores.withColumn("kept", F.col("key") >= kth_largest(scores, k) if k > 0 else F.lit(False))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Importance resampling of the whole of ``documents`` towards the labelled good ones."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
