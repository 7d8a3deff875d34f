"""Retrieval metrics, their intervals, paired comparisons, cap selection and failure analysis.

Relevance is by file: a ranked list is a list of paths with repeats, and a file
counts once, at its first rank. Lists are cut at ``DEPTH`` before they are scored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import statistics as st
from ..functions.text import is_documentation
from ..session import stored
from ..sources.corpus import project_of
from . import bootstrap
from .places import placed, small
from .retrieval import cap

# The depth that is scored, the cuts of the metrics, the caps to choose from (largest first, none before all).
DEPTH, CUTS, CAPS = 10, (1, 3, 5, 10), (None, 3, 2, 1)

# The paired comparisons that are reported, (label, a, b, metrics).
COMPARISONS = (
    ("structural boundaries vs windows, hybrid", "structural_merged/hybrid", "window/hybrid", ("hit_rate@1", "mrr", "ndcg@10")),
    ("structural boundaries vs windows, dense", "structural_merged/dense", "window/dense", ("hit_rate@1", "mrr")),
    ("merged vs unmerged structural, hybrid", "structural_merged/hybrid", "structural/hybrid", ("hit_rate@1", "mrr")),
    ("hybrid vs dense, merged", "structural_merged/hybrid", "structural_merged/dense", ("hit_rate@1", "hit_rate@5", "mrr", "ndcg@10")),
    ("hybrid vs dense, window", "window/hybrid", "window/dense", ("hit_rate@1", "mrr")),
    ("hybrid vs bm25, merged", "structural_merged/hybrid", "structural_merged/bm25", ("hit_rate@5", "mrr")),
    ("per-file cap vs none, merged hybrid", "structural_merged/hybrid+cap", "structural_merged/hybrid", ("hit_rate@3", "hit_rate@5", "recall@5", "mrr", "ndcg@10")),
    ("reranker (text only) vs hybrid, merged", "structural_merged/hybrid+rerank", "structural_merged/hybrid", ("hit_rate@1", "mrr")),
    ("reranker (prefixed) vs hybrid, merged", "structural_merged/hybrid+rerank+prefix", "structural_merged/hybrid", ("hit_rate@1", "mrr")),
    ("reranker prefixed vs text only, merged", "structural_merged/hybrid+rerank+prefix", "structural_merged/hybrid+rerank", ("hit_rate@1", "mrr")),
    ("reranker (text only) vs hybrid, window", "window/hybrid+rerank", "window/hybrid", ("hit_rate@1", "mrr")),
    ("reranker (prefixed) vs hybrid, window", "window/hybrid+rerank+prefix", "window/hybrid", ("hit_rate@1", "mrr")),
    ("reranker prefixed vs text only, window", "window/hybrid+rerank+prefix", "window/hybrid+rerank", ("hit_rate@1", "mrr")),
)
SHIPPED = "structural_merged"


def question_metrics(ranked: DataFrame, qrels: DataFrame, questions: DataFrame, keys: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """One row for each of ``keys`` and question: first_hit_rank and the ten metrics.

    ``ranked`` (keys, qid, path, rank), ``qrels`` (qid, path), ``questions``
    (qid). A question without labels scores 0, and so does a list without hits.
    """
    wanted = qrels.select("qid", "path").distinct()
    hits = ranked.where(F.col("rank") <= depth).join(F.broadcast(wanted) if wanted.limit(100_001).count() <= 100_000 else wanted, ["qid", "path"])
    first = hits.groupBy(*keys, "qid", "path").agg(F.min("rank").alias("rank"))
    within = lambda k: F.col("rank") <= k
    gain = F.lit(1.0) / F.log2(F.col("rank").cast("double") + F.lit(1.0))
    found = first.groupBy(*keys, "qid").agg(
        F.min("rank").alias("first_hit_rank"), *(F.sum(within(k).cast("int")).alias(f"files@{k}") for k in CUTS), F.sum(F.when(within(10), gain).otherwise(F.lit(0.0))).alias("dcg")
    )
    labels = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    base = questions.select("qid").distinct().join(labels, "qid", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    if keys:
        base = base.crossJoin(F.broadcast(ranked.select(*keys).distinct()))
    rows = base.join(found, [*keys, "qid"], "left")
    n, rank = F.col("n_relevant"), F.col("first_hit_rank")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(10)).cast("int"))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i.cast("double") + F.lit(1.0)))
    zero = lambda c: F.when(n > 0, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.select(
        *keys, "qid", "first_hit_rank",
        *(F.coalesce((rank <= k).cast("double"), F.lit(0.0)).alias(f"hit_rate@{k}") for k in CUTS),
        *(zero(F.col(f"`files@{k}`") / n).alias(f"recall@{k}") for k in CUTS),
        F.coalesce(F.lit(1.0) / rank, F.lit(0.0)).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg@10"),
    )


def stored_values(metrics: DataFrame) -> DataFrame:
    """Metrics rounded as they are stored: all that follows but cap selection reads these."""
    return metrics.select(*(st.round_4(f"`{c}`").alias(c) if c in schemas.METRICS else F.col(c) for c in metrics.columns))


def long_form(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, qid, metric, value)."""
    return metrics.unpivot([*keys, "qid"], [f"`{m}`" for m in schemas.METRICS], "metric", "value").withColumn("metric", F.regexp_replace("metric", "`", ""))


#: Values of a group up to which one task draws its whole stream; larger groups are drawn in slices by many, with the same result.
GROUP = 10_000


def _few(values: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether no group has more than ``GROUP`` values."""
    return not values.groupBy(*keys).count().where(F.col("count") > GROUP).limit(1).count()


def with_intervals(values: DataFrame, keys: tuple[str, ...] = ("key", "metric"), seed: int = st.SEED, resamples: int = st.RESAMPLES, sep: str = "/") -> DataFrame:
    """(keys, value, low, high): means and bootstrap intervals of rows (keys, ord, value); the seed depends on the joined keys.

    The resamples of a large group are drawn in slices by many tasks, each from its place in the group's one stream.
    """
    if not _few(values, keys):
        return bootstrap.intervals(values, keys, st.derived_seed_column(seed, F.concat_ws(sep, *keys)), resamples=resamples)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        own = st.derived_seed(seed, sep.join(k for k in key if k is not None))
        return pd.DataFrame([(*key, float(rows["value"].mean()), *st.bootstrap_interval(rows["value"].to_numpy(), own, resamples))])

    schema = ", ".join(f"{k} string" for k in keys) + ", value double, low double, high double"
    return values.select(*keys, "ord", "value").groupBy(*keys).applyInPandas(run, schema)


#: Resamples that a task draws of a group by hashes, and draws that it lays out in a row.
HASH_RANGE, HASH_BLOCK = 256, 1 << 12


def _hash_sums(drawn: np.ndarray, b: int, n: int, modulus: int, factor: int, step: int) -> np.ndarray:
    """Sums of the columns of ``drawn`` (a row for each residue of ``modulus``) over the ``n`` draws of resample ``b``.

    Draw j is residue (b * factor + j * (step + b * 31)) mod modulus, which
    repeats after ``modulus`` draws, so those are drawn once and counted as often.
    """
    begin, by = b * factor % modulus, (step + b * 31) % modulus
    cycles, rest = divmod(n, modulus)
    own = np.arange(HASH_BLOCK, dtype=np.int64) * by % modulus
    rows = (np.arange(-(-min(n, modulus) // HASH_BLOCK), dtype=np.int64) * (HASH_BLOCK * by % modulus) + begin) % modulus
    at = rows.astype(np.uint32)[:, None] + own.astype(np.uint32)
    # below the modulus the difference wraps around and is the larger one
    at = np.minimum(at, at - np.uint32(modulus)).ravel()[: min(n, modulus)]
    out = [c[at[:rest]].sum() + (cycles * c[at].sum() if cycles else 0) for c in drawn.T]
    return np.array(out, float)


def _hash_draws(modulus: int, factor: int, step: int):
    """(keys, b, mean) of ranges of resamples (keys, n, from, to, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rest = batch.column("v"), batch.drop_columns(["v", "n", "from", "to"])
            for k, (n, begin, to) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "from", "to")))):
                own = lists[k].values
                columns = [own.fill_null(0.0).to_numpy(zero_copy_only=False)]
                if own.null_count:
                    columns.append(own.is_valid().to_numpy(zero_copy_only=False).astype(float))
                # residue r picks value r mod n
                drawn = np.asfortranarray(np.stack([np.resize(c, modulus) for c in columns], axis=1))
                sums = np.array([_hash_sums(drawn, b, n, modulus, factor, step) for b in range(begin, to)])
                counts = sums[:, 1] if own.null_count else np.full(len(sums), float(n))
                means = pa.array(sums[:, 0] / np.where(counts > 0, counts, 1), mask=counts == 0)
                keys = rest.take(pa.array(np.full(to - begin, k)))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.arange(begin, to)), means], names=[*rest.schema.names, "__b", "mean"])

    return run


def _hash_means(values: DataFrame, keys: tuple[str, ...], resamples: int, modulus: int, factor: int, step: int) -> DataFrame:
    """(keys, __b, mean): means of resamples of values (keys, ord, value); nulls among the picks don't count.

    Value k of a group of n is drawn by all draws j of resample b with
    (b * factor + j * step + b * j * 31) mod modulus mod n = k. So at most the
    ``modulus`` first values of a group can be drawn, and a resample takes so
    many draws at most however large the group is; resamples go in ranges.
    """
    if not 0 < modulus < 1 << 31:
        raise ValueError("the modulus must be positive and below 2^31")
    own = stored(placed(values.select(*keys, "ord", F.col("value").cast("double").alias("value")), keys, ("ord",)), "hash-values")
    sizes = stored(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "hash-sizes")
    one = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    lists = own.where(F.col("at") < modulus).groupBy(*keys).agg(one.alias("v"))
    work = _null_join(stored(lists, "hash-lists"), small(sizes), keys).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), F.lit(HASH_RANGE).cast("long"))))
    work = work.withColumn("to", F.least(F.col("from") + HASH_RANGE, F.lit(resamples).cast("long"))).select(*keys, "n", "from", "to", "v")
    # a task for each range, as far as hashes part them: its values are up to ``modulus`` numbers
    tasks = min(4096, max(1, sizes.count() * -(-resamples // HASH_RANGE)))
    named = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    return work.repartition(tasks, *keys, "from").mapInArrow(_hash_draws(modulus, factor, step), f"{named}, __b long, mean double")


def _null_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on keys that may be null."""
    named = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, on, how).drop(*(f"__{k}" for k in keys))


def _quantiles(means: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_hash(values: DataFrame, keys: tuple[str, ...], resamples: int = 1000, modulus: int = 1_000_003, factor: int = 7919, step: int = 104_729) -> DataFrame:
    """(keys, value, low, high) with draws from integer arithmetic, so that any engine gives the same ones.

    Draw j of resample b is row (b * factor + j * step + b * j * 31) mod modulus mod n of the group, by ``ord`` from 0.
    """
    means = values.groupBy(*keys).agg(F.avg("value").alias("value"))
    spans = _quantiles(_hash_means(values, keys, resamples, modulus, factor, step), keys)
    return _null_join(means, spans, keys).select(*keys, "value", "low", "high")


def difference_hash(values: DataFrame, keys: tuple[str, ...], side: str, resamples: int = 1000, modulus: int = 1_000_003, factor: int = 7919, step: int = 104_729) -> DataFrame:
    """(keys, low, high): intervals of the mean where ``side`` is false less the mean where it is true, each side drawn as in ``bootstrap_hash``; (0, 0) without one of them."""
    means = _hash_means(values.withColumn("__side", F.col(side)), (*keys, "__side"), resamples, modulus, factor, step)
    both = means.groupBy(*keys, "__b").agg((F.max(F.when(~F.col("__side"), F.col("mean"))) - F.max(F.when(F.col("__side"), F.col("mean")))).alias("mean"))
    spans = _quantiles(both.where("mean is not null"), keys)
    every = values.select(*keys).distinct()
    return _null_join(every, spans, keys, "left").select(*keys, F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))


def paired(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences of paired values: ``values`` (key, qid, ord, metric, value), ``pairs`` (label, a, b, metric).

    (label, a, b, metric, a_value, b_value, diff, better, worse, same,
    sign_test_p). A pair of which a side is absent is skipped; sides of unequal
    length are an error of the caller's, and only shared questions count.
    """
    a = values.select(F.col("key").alias("a"), "qid", "metric", F.col("value").alias("va"))
    b = values.select(F.col("key").alias("b"), "qid", "metric", F.col("value").alias("vb"))
    both = F.broadcast(pairs).join(a, ["a", "metric"]).join(b, ["b", "metric", "qid"])
    d = F.col("va") - F.col("vb")
    out = both.groupBy("label", "a", "b", "metric").agg(
        F.avg("va").alias("a_value"), F.avg("vb").alias("b_value"), F.avg(d).alias("diff"),
        F.sum((d > st.TOLERANCE).cast("int")).alias("better"), F.sum((d < -st.TOLERANCE).cast("int")).alias("worse"), F.sum((F.abs(d) <= st.TOLERANCE).cast("int")).alias("same"),
    )
    return out.withColumn("sign_test_p", st.sign_test_column(F.col("better"), F.col("worse")))


def paired_differences(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(label, metric, qid, ord, value = a - b), for intervals of the differences."""
    a = values.select(F.col("key").alias("a"), "qid", "ord", "metric", F.col("value").alias("va"))
    b = values.select(F.col("key").alias("b"), "qid", "metric", F.col("value").alias("vb"))
    return F.broadcast(pairs).join(a, ["a", "metric"]).join(b, ["b", "metric", "qid"]).select("label", "a", "b", "metric", "qid", "ord", (F.col("va") - F.col("vb")).alias("value"))


def capped_lists(fused: DataFrame, caps: tuple[int | None, ...] = CAPS, depth: int = DEPTH) -> DataFrame:
    """``fused`` (qid, idx, path, rank) under each cap, in one relation with ``per_file``."""
    out = None
    for c in caps:
        one = (fused if c is None else cap(fused, per_file=c)).where(F.col("rank") <= depth).withColumn("per_file", F.lit(c).cast("int"))
        out = one if out is None else out.unionByName(one)
    return out


def choose_cap(metrics: DataFrame, halves: DataFrame) -> DataFrame:
    """(per_file, half, mrr, hit_rate@5, recall@5, chosen) of the caps.

    Chosen is the cap with the best dev MRR, then dev recall@5, to six places;
    ties prefer no cap, then the larger one. ``metrics`` (per_file, qid, ...) are
    the unrounded ones, ``halves`` (qid, half).
    """
    named = metrics.join(small(halves), "qid")
    every = named.unionByName(named.withColumn("half", F.lit("all")))
    means = every.groupBy("per_file", "half").agg(*(F.avg(f"`{m}`").alias(m) for m in ("mrr", "hit_rate@5", "recall@5")))
    dev = means.where("half = 'dev'").select("per_file", F.row_number().over(Window.orderBy(F.desc(F.round("mrr", 6)), F.desc(F.round(F.col("`recall@5`"), 6)), F.col("per_file").isNull().desc(), F.desc("per_file"))).alias("place"))
    chosen = dev.where("place = 1").select(F.col("per_file").alias("best"), F.lit(True).alias("found"))
    return means.join(F.broadcast(chosen), F.col("per_file").eqNullSafe(F.col("best")), "left").select("per_file", "half", "mrr", "`hit_rate@5`", "`recall@5`", F.coalesce("found", F.lit(False)).alias("chosen"))


def failure_shares(ranked: DataFrame, qrels: DataFrame, questions: DataFrame, keys: tuple[str, ...] = ("key",), top: int = 5) -> DataFrame:
    """For each question: doc_share and wrong_project_share of the ``top`` first results (always over ``top``), and whether one is a hit."""
    rel = qrels.select("qid", "path").distinct()
    projects = rel.select("qid", project_of(F.col("path")).alias("project")).distinct().withColumn("known", F.lit(1))
    rows = ranked.where(F.col("rank") <= top).withColumn("project", project_of(F.col("path")))
    rows = rows.join(rel.withColumn("hit", F.lit(1)), ["qid", "path"], "left").join(projects, ["qid", "project"], "left")
    shares = rows.groupBy(*keys, "qid").agg(
        (F.sum(is_documentation(F.col("path")).cast("int")) / F.lit(float(top))).alias("doc_share"),
        (F.sum(F.col("known").isNull().cast("int")) / F.lit(float(top))).alias("wrong_project_share"),
        F.coalesce(F.max("hit"), F.lit(0)).cast("boolean").alias("hit"),
    )
    every = questions.select("qid").distinct().crossJoin(F.broadcast(ranked.select(*keys).distinct()))
    return every.join(shares, [*keys, "qid"], "left").select(*keys, "qid", F.coalesce("doc_share", F.lit(0.0)).alias("doc_share"), F.coalesce("wrong_project_share", F.lit(0.0)).alias("wrong_project_share"), F.coalesce("hit", F.lit(False)).alias("hit"))


def failure_summary(shares: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Means of the shares on misses, hits and all, for each of ``keys``."""
    mean = lambda c, on: F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0))
    hit = F.col("hit")
    cols = [mean(c, on).alias(f"{c}_{name}") for c in ("doc_share", "wrong_project_share") for name, on in (("misses", ~hit), ("hits", hit), ("all", F.lit(True)))]
    return shares.groupBy(*keys).agg(F.sum((~hit).cast("int")).alias("n_misses"), F.sum(hit.cast("int")).alias("n_hits"), *cols)


def difference_intervals(shares: DataFrame, names: tuple[str, ...] = ("doc_share", "wrong_project_share"), seed: int = st.SEED, resamples: int = st.RESAMPLES) -> DataFrame:
    """(key, name, low, high): intervals of the mean on misses less the mean on hits, of shares (key, ord, hit, names).

    Both sides are drawn from one stream for each key and name, misses first; those of large groups in slices, by many tasks.
    """
    values = shares.unpivot(["key", "ord", "hit"], list(names), "name", "value")
    if not _few(values, ("key", "name")):
        own = st.derived_seed_column(seed, F.concat(F.coalesce("key", F.lit("None")), F.lit("/failure"))) + F.array_position(F.array(*(F.lit(n) for n in names)), F.col("name")) - 1
        return bootstrap.differences(values, ("key", "name"), "hit", own, resamples=resamples)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        own = st.derived_seed(seed, f"{key[0]}/failure") + names.index(key[1])
        sides = (rows.loc[rows["hit"] == hit, "value"].to_numpy() for hit in (False, True))
        return pd.DataFrame([(*key, *st.difference_interval(*sides, own, resamples))])

    return values.groupBy("key", "name").applyInPandas(run, "key string, name string, low double, high double")


def make_split(ids_by_project: dict[str, list[str]], seed: int) -> dict:
    """Half of each project's questions, shuffled by one seeded stream over the projects in order; the odd one is for testing."""
    rng, dev, test = random.Random(seed), [], []
    for project in sorted(ids_by_project):
        ids = sorted(ids_by_project[project])
        rng.shuffle(ids)
        dev += ids[: len(ids) // 2]
        test += ids[len(ids) // 2 :]
    return {"method": "stratified by project", "seed": seed, "dev": sorted(dev), "test": sorted(test)}


def split_by_hash(questions: DataFrame, stratum: str, seed: int) -> DataFrame:
    """(qid, stratum, half): the same rule by a seeded digest, for any number of questions.

    A question's place in its stratum is the number of those with a lower start
    of their digest, which is counted first, and its place among those with the
    same one, so that no task sorts a stratum.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string")))
    rows = questions.select("qid", stratum, digest.alias("digest"), F.substring(digest, 1, 4).alias("start"))
    counts = rows.groupBy(F.col(stratum).alias("of"), F.col("start").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("of").orderBy("at")
    counts = counts.select("of", "at", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("of")).alias("all"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum, "start").orderBy("digest", "qid")))
    placed = placed.join(small(counts), placed[stratum].eqNullSafe(counts["of"]) & (placed["start"] == counts["at"]))
    return placed.select("qid", stratum, F.when(F.col("before") + F.col("place") <= F.floor(F.col("all") / 2), "dev").otherwise("test").alias("half"))


#: A log of labels and decisions: who said of a pair whether it is relevant, ``seq`` growing; the decision's ``who`` is ``DECISION``.
LOG, DECISION = "id string, path string, who string, relevant boolean, reason string, seq long", "decision"


def adjudicated(log: DataFrame, a: str, b: str) -> DataFrame:
    """(id, path, labeller_a, labeller_b, decision, reason, relevant): the pairs that either labeller listed, from an append-only log.

    Of several entries of one person for a pair the last by ``seq`` holds. A
    labeller who never listed a pair said no to it. ``decision`` is null until a
    disagreement is decided; ``relevant`` is what both say, or the decision, or
    null where it is still open.
    """
    last = log.groupBy("id", "path", "who").agg(F.max_by(F.struct("relevant", "reason"), "seq").alias("x"))
    said = lambda who: F.max(F.when(F.col("who") == who, F.col("x.relevant")))
    pairs = last.groupBy("id", "path").agg(
        F.coalesce(said(a), F.lit(False)).alias("labeller_a"), F.coalesce(said(b), F.lit(False)).alias("labeller_b"), said(DECISION).alias("decision"), F.max(F.when(F.col("who") == DECISION, F.col("x.reason"))).alias("reason")
    )
    agreed = F.col("labeller_a") == F.col("labeller_b")
    return pairs.withColumn("relevant", F.when(agreed, F.col("labeller_a")).otherwise(F.col("decision")))


def disagreements(log: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs that the labellers see differently and nobody has decided, to be put before them."""
    return adjudicated(log, a, b).where("labeller_a <> labeller_b AND decision IS NULL").select("id", "path", "labeller_a", "labeller_b")


def agreement(log: DataFrame, a: str, b: str) -> DataFrame:
    """(stage, n, agreement, expected, kappa): agreement over the union of listed pairs, as labelled and after decisions, which stand for both."""
    pairs = adjudicated(log, a, b).withColumn("__x", F.col("labeller_a").cast("int")).withColumn("__y", F.col("labeller_b").cast("int"))
    settled = pairs.withColumn("__x", F.coalesce(F.col("decision").cast("int"), "__x")).withColumn("__y", F.coalesce(F.col("decision").cast("int"), "__y"))
    return kappa(pairs, "__x", "__y").withColumn("stage", F.lit("labelled")).unionByName(kappa(settled, "__x", "__y").withColumn("stage", F.lit("decided"))).select("stage", "n", "agreement", "expected", "kappa")


def frozen(log: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, path): the relevant pairs once every disagreement is decided; an open one is an error."""
    pairs = stored(adjudicated(log, a, b), "adjudicated")
    if (left := pairs.where("relevant IS NULL").count()):
        raise RuntimeError(f"{left} disagreements are open")
    return pairs.where("relevant").select(F.col("id").alias("qid"), "path")


def kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters of 0 and 1: n, agreement, expected, kappa (null where only one answer occurs)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    one = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    expected = F.col("pa") * F.col("pb") + (F.lit(1.0) - F.col("pa")) * (F.lit(1.0) - F.col("pb"))
    return one.withColumn("expected", expected).select("n", "agreement", "expected", F.when(F.col("expected") < 1, (F.col("agreement") - F.col("expected")) / (F.lit(1.0) - F.col("expected"))).alias("kappa"))
