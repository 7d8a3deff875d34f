"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

Sizes, sources and shards are summed first; the driver sees one number per
source and per shard, at most ``MAX_SOURCES`` and ``MAX_SHARDS`` of them.
Blocks of equal numbers of words go to the sources, and a source's blocks to
its shards, by highest quotients size/(2s+1). A shard is a seeded random part
of one source in seeded random order, so a hot source is many shards. Its quota
is taken as whole passes over the shard and one run of blocks from a seeded
start; each document's share of that run is arithmetic on its running total,
with no row for a block.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, with_row_id

#: The driver holds a number for each; more of them is an error, never a cut.
MAX_SOURCES, MAX_SHARDS = 100_000, 200_000
#: Words in a block at most, and words in a shard at least.
BLOCK, SHARD_WORDS = 256, 1 << 18
#: Weights by rank of the source's name, repeating, and the share of all sizes to take.
WEIGHTS, SHARE, LIMIT = (3, 1, 2), Fraction(3, 2), 2


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, limit: int = LIMIT) -> list[Fraction]:
    """Words for each source: ``share`` of all sizes by weight, none above ``limit`` times its size, the excess reshared."""
    out, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / whole > limit * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(limit * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def sainte_lague(votes: list[Fraction | int], seats: int) -> list[int]:
    """Seats by highest quotients v/(2s+1); ties go to the earlier entry.

    All but a few seats are set at once: with divisor d, an entry's quotients
    above d number floor(v/d/2+1/2), and the seats those leave are dealt one by one.
    """
    if seats <= 0 or not any(v > 0 for v in votes):
        return [0] * len(votes)
    total = sum(votes)
    d = Fraction(total) / (2 * max(1, seats)) * (1 + Fraction(len(votes), seats))
    won = [int((v / d + 1) // 2) for v in map(Fraction, votes)]
    assert sum(won) <= seats + len(votes)
    queue = [(-Fraction(v) / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, won)) if v > 0]
    heapq.heapify(queue)
    left = seats - sum(won)
    while left > 0:
        _, i = heapq.heappop(queue)
        won[i] += 1
        left -= 1
        heapq.heappush(queue, (-Fraction(votes[i]) / (2 * won[i] + 1), i))
    while left < 0:  # take back the lowest winning quotients
        i = min((j for j in range(len(won)) if won[j]), key=lambda j: (Fraction(votes[j]) / (2 * won[j] - 1), -j))
        won[i] -= 1
        left += 1
    return won


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, block: int = BLOCK, shard_words: int = SHARD_WORDS, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, epochs, runs.

    ``taken`` is epochs * size plus the words in ``runs``, an array of (start,
    length) in words of the document. A null text has size 0 and is never
    taken; a null source is a source of its own, last in rank. Repeated rows
    are documents of their own. A row's place is drawn from its id and length,
    and its number breaks ties, so the order is total, and a task that runs
    again takes the same words; rows without an id are dealt to shards by their
    numbers. Those are the rows' places in a written table, or ``row_col``,
    which is then passed on. Blocks shrink below ``block`` words where the least
    target is small, so every source comes within a block or so of its target.
    Very long texts are counted whole. An empty table gives no rows; extra
    columns aren't read.
    """
    spark = docs.sparkSession
    if row_col is None:
        keyed = with_row_id(docs.select(id_col, text_col, source_col))
        docs = keyed.select(*(F.col("doc")[c].alias(c) for c in dict.fromkeys((id_col, text_col, source_col))), F.col("row").alias("__row"))
    row, carry = row_col or "__row", ("row",) if row_col else ()
    sized = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.length(text_col)).alias("draw"),
            F.col(row).alias("row"),
        ),
        "mix-sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    rows = by_source.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = [r["size"] for r in rows]
    goals = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    total = sum(sizes)
    least = min((t for t in goals if t > 0), default=Fraction(0))
    b = max(1, min(block, int(least / 400)))
    quotas = sainte_lague(goals, round(sum(goals) / b))
    per_shard = max(shard_words, total // (MAX_SHARDS // 2) + 1)
    plan = [(i, r["source"], r["size"], float(goals[i]), max(1, round(r["size"] / per_shard))) for i, r in enumerate(rows)]
    sources = spark.createDataFrame(plan, "s int, source string, source_size long, target double, shards int")
    dealt = (
        sized.alias("d")
        .join(F.broadcast(sources.alias("p")), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select(*(f"d.{c}" for c in ("doc_id", "source", "size", "draw", "row")), "p.s", "p.source_size", "p.target", F.pmod(F.when(F.col("d.doc_id").isNull(), F.xxhash64("d.draw", "d.row")).otherwise(F.col("d.draw")), F.col("p.shards")).cast("int").alias("shard"))
    )
    shards: dict[int, list] = {}
    for r in dealt.groupBy("s", "shard").agg(F.sum("size").alias("w")).where("w > 0").collect():
        shards.setdefault(r["s"], []).append((r["shard"], r["w"]))
    takes = []
    for s, own in shards.items():
        own.sort()
        for (shard, w), q in zip(own, sainte_lague([w for _, w in own], quotas[s])):
            words = min(LIMIT * w, q * b)
            takes.append((s, shard, w, words // w, words % w, b))
    quota = spark.createDataFrame(takes, "s int, shard int, w long, epochs long, part long, block long")
    run = Window.partitionBy("s", "shard").orderBy("draw", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.join(F.broadcast(quota), ["s", "shard"], "left")
        .withColumn("hi", F.sum("size").over(run))
        .withColumn("lo", F.col("hi") - F.col("size"))
        .withColumn("at", F.col("block") * F.pmod(F.xxhash64(F.lit(seed), "s", "shard"), F.ceil(F.col("w") / F.col("block"))))
    )
    end = F.col("at") + F.col("part")

    def cut(lo, hi) -> F.Column:
        start, stop = F.greatest(F.col("lo"), lo), F.least(F.col("hi"), hi)
        return F.when(stop > start, F.struct((start - F.col("lo")).alias("start"), (stop - start).alias("length")))

    pieces = F.array_compact(F.array(cut(F.lit(0).cast("long"), end - F.col("w")), cut(F.col("at"), F.least(end, F.col("w")))))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    placed = placed.withColumn("runs", F.coalesce(F.when(F.col("part") > 0, pieces), none)).withColumn("epochs", F.when(F.col("size") > 0, F.coalesce("epochs", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    part = F.aggregate("runs", F.lit(0).cast("long"), lambda x, r: x + r["length"])
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "epochs", "runs", *carry)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars", **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: each document as often as the mix passes over it, and its part of a run.

    A part holds the words of the run and the white space between them;
    ``count_col``, where there is one, counts its characters. Rows of which the
    mix takes nothing go, and so do all of those without words. Repeated rows
    and null ids are documents of their own, told apart by their places in the
    table; a null source is a source. Very long texts are cut at words like
    others. An empty table gives no rows. No column's name can clash with the operator's.
    """
    keyed = with_row_id(docs)  # what the mix decides for a row must find that row again
    doc = F.col("doc")
    given = keyed.select(doc[id_col].alias("doc_id"), doc[text_col].alias("text"), doc[source_col].alias("source"), "row")
    taken = mix(given, row_col="row", **options).where("taken > 0").select("row", "epochs", "runs")
    whole = F.array_repeat(F.lit(None).cast("struct<start:bigint,length:bigint>"), F.col("epochs").cast("int"))
    rows = keyed.join(taken, "row").withColumn("run", F.explode(F.concat(whole, "runs")))
    text = doc[text_col]
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    start, length = F.col("run.start").cast("int"), F.col("run.length").cast("int")
    pieces = F.zip_with(F.slice(words, start + 1, length), F.concat(F.slice(gaps, start + 2, length - 1), F.array(F.lit(""))), lambda w, g: F.concat(w, g))
    rows = rows.withColumn("part", F.when(F.col("run").isNotNull(), F.array_join(pieces, "")))
    part = F.col("part")
    changed = {text_col: part} | ({count_col: F.length(part).cast(docs.schema[count_col].dataType)} if count_col in docs.columns else {})
    return rows.select(*((F.when(part.isNull(), doc[c]).otherwise(changed[c]) if c in changed else doc[c]).alias(c) for c in docs.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
