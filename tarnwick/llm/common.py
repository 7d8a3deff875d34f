"""Shared pieces: words, size checks, connected components; the shared folder and written tables are the session's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, shared_path, stored  # noqa: F401  (the operators take them from here)

#: Words and white space as every operator here counts them.
WORD = r"[^\x20\x09-\x0D]+"


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def is_table(docs: DataFrame) -> bool:
    """Whether rows come straight from a Parquet table, projected or filtered at most: the same files in the same order each time."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString()


def with_row_hash(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row in ``name``, the same however often and wherever a task runs: of its file and its place there.

    Rows that don't come straight from a Parquet table are written to one first. Two rows may share a number, as hashes do.
    """
    docs = docs if is_table(docs) else stored(docs, "rows")
    at = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.xxhash64(at["file_path"], at["row_index"]))


def with_row_id(docs: DataFrame) -> DataFrame:
    """(doc, row): the columns of ``docs`` as one, and a number that no other row has, the same in every use of the result.

    Rows straight from a Parquet table come in the same files and order each time; others are written to one first.
    """
    docs = docs if is_table(docs) else stored(docs, "rows")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row"))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each entry points to itself or to a lower one of its set) with the sets of i and j joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up


def forest(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ``ids`` that join each set of ``label`` (as ``unite`` gives it): one fewer than it has members."""
    own = np.flatnonzero(label != np.arange(len(label)))
    return ids[label[own]], ids[own]


#: Nodes that a star step takes by broadcast at most: those with more than one in so many of all edges. Keys of a join likewise.
HOT_NODES = 2000


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with the row of ``right``, where there is at most one, that has its key ``on``.

    Keys with more than one in ``HOT_NODES`` of the rows, of which there can't
    be more than that, meet their rows of ``right`` by broadcast, so no task
    gets a hot key; the others meet by a shuffle. Unless the ``hot`` keys are
    given, rows of ``left`` are counted by key, so it should be a written table.
    """
    if hot is None:
        total = left.count()
        hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(1, total // HOT_NODES)).select(*on)
    hot = stored(hot, "hot-keys")
    if not hot.limit(1).count():
        return left.join(right, on, how)
    keys = F.broadcast(hot)
    own = F.broadcast(right.join(keys, on, "left_semi"))
    return left.join(keys, on, "left_semi").join(own, on, how).unionByName(left.join(keys, on, "left_anti").join(right, on, how))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    ``edges`` has two long columns, ``a`` and ``b``. Large-star and small-star
    steps alternate until no edge changes; each step's edges are written to
    the shared folder. Only a count and a checksum reach the driver. A node
    with more than one in ``HOT_NODES`` of a step's edges takes its least
    neighbour from a broadcast row, of which there can't be more than
    ``HOT_NODES``, so no task gets all edges of a hot node. An empty ``edges``
    gives no rows.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") / 1024).cast("decimal(20,0)"))).first())

    def with_least(e: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
        """Edges (u, v) with the least ``m`` of all v of u, and (u, m)."""
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = F.broadcast(least.where(F.col("n") > total // HOT_NODES).select("u", "m"))
        rest = least.where(F.col("n") <= total // HOT_NODES).select("u", "m")
        return e.join(hot, "u").unionByName(e.join(hot, "u", "left_anti").join(rest, "u")), least

    def large(e: DataFrame, n: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        linked, _ = with_least(both, 2 * n)
        return linked.where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))

    def small(e: DataFrame, n: int) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        linked, least = with_least(down, n)
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = state(now)
    for _ in range(rounds if seen[0] else 0):
        # a large star has as many edges as there were, each once
        now = stored(small(stored(large(now, seen[0]), "stars"), seen[0]), "edges")
        last, seen = seen, state(now)
        if last == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct())
