"""Embedding near-dedup by sorted projection passes.

In a pass, vectors are ordered within their label by 64 concatenated random
hashes (signs of projections), so that near vectors stand near each other, and
each is compared with its neighbours in a bounded window of that order. What is
verified in any pass is united. Each row has its own number of passes. A few
passes show how many first bits of its signature must agree before no more rows
than its window share them; from these and the widest angle at which its cell
may link follows how often a pair is missed in a pass, however vectors cluster.
Two kinds of rows are compared with all of their label instead: those of labels
that one window holds whole, and those of topics so dense that they need more
than ``PASSES`` passes and these would cost more.

Dense groups link in numbers that grow with the square of their size, so links
are counted and never listed. Before the passes vectors are gathered in cells: a
few passes of the same order let each vector join a leader near it, as long as
all of a cell lies within half the threshold's angle of its leader. All members
of a cell are then linked, by the triangle inequality for angles. The passes run
over leaders, and a window hands on a spanning forest of the leaders whose
members may link. The sets that these forests join hold every link that was met,
and all links between members of one set, met in a pass or not: within a set
vectors are compared block by block, each block hands on counts and a spanning
forest of its links, and their components are the result. Members of small cells
are compared one by one. A large cell is one unit: where all its members must
link, its size is added; where only some may, they are compared by blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_NODES, components, forest, join_unique, small_enough, stored, unite

THRESHOLD = 0.93
#: Rows in a tile (a window is the tile and those beside it), and the chance to find a pair at the widest angle that sets the number of passes.
TILE, RECALL = 64, 0.9999
#: Passes that gather cells, and the leaders a row is compared with there.
ROUNDS, RECENT = 3, 48
#: Rows of a task of a pass; members of a cell in a block, and rows of a block compared at a time.
TASK_ROWS, BLOCK, SLICE = 20_000, 1024, 256
#: Passes that show the crowding, comparisons that cost as much as a row in a pass, passes that no row is spared, and rows in a block of those compared with all.
PROBES, WORTH, PASSES, SPAN = 8, 1024, 64, 4096
#: Blocks that a set is cut into before its blocks grow beyond a tile.
SHARES = 16
#: Vectors from which a cell is one unit when links are counted.
LARGE = 256
#: Groups of more than one block that are broadcast at most.
_BROADCAST = 100_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; all rows have one length."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _runs(keys: list) -> list[tuple[int, int]]:
    """Ranges of equal consecutive keys."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
    return list(zip(cuts, cuts[1:]))


def _signatures(passes: list[int] | None, seed: int, bare: bool = False):
    """Each row once for each of ``passes`` (None: all) below its ``upto``, with the 64 signs of that pass as one sortable number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(part.schema.get_field_index("vec")))
                upto = part.column(part.schema.get_field_index("upto")).to_numpy()
                part = part.drop_columns(["upto", "vec"] if bare else ["upto"])
                for p in range(int(upto.max())) if passes is None else passes:
                    own = np.flatnonzero(upto > p)
                    if not len(own):
                        continue
                    planes = np.random.default_rng((seed, p, dim)).standard_normal((dim, 64))
                    bits = np.packbits(x[own] @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
                    sig = (bits ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), p), pa.int32()), pa.array(sig), *part.take(pa.array(own)).columns], names=["pass", "sig", *part.schema.names])

    return run


def _ordered(leaders: DataFrame, passes: list[int] | None, seed: int, rows: int) -> DataFrame:
    """Leaders (lead, grp, dim, r, vec, upto) once for each pass, ``rows`` in all, each task a range of the passes' orders."""
    vec = leaders.schema["vec"].dataType.simpleString()
    signed = leaders.select("lead", "grp", "dim", "r", "vec", "upto").mapInArrow(_signatures(passes, seed), f"pass int, sig long, lead long, grp string, dim int, r double, vec {vec}")
    return signed.repartitionByRange(max(1, rows // TASK_ROWS), "pass", "grp", "sig", "lead").sortWithinPartitions("pass", "grp", "sig", "lead").select("pass", "grp", "lead", "r", "vec")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers up to the highest that is set."""
    high = x >> np.uint64(32)
    return np.frexp(np.where(high > 0, high, x & np.uint64(0xFFFFFFFF)).astype(float))[1] + 32 * (high > 0)


def _missed(window: int):
    """(lead, missed): the log of the chance that a pass misses a row's link at its widest angle; rows come sorted by pass, group and signature.

    A row's window holds all rows that share its first d bits, d being one more
    than it shares with the nearer of the rows ``window`` before and after it.
    Where a task's range cuts the order, the other side stands for both; where
    that is cut too, the farthest row that the task holds, which shares no fewer bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = list(zip(*(rows.column(k).to_pylist() for k in range(2))))
        sig, angle = rows.column(2).to_numpy().view(np.uint64), rows.column(4).to_numpy()
        depth = np.zeros(len(sig))
        runs = _runs(keys)
        for lo, hi in runs:
            own, at = sig[lo:hi], np.arange(hi - lo)
            sides = []
            for other in (at - window, at + window):
                clipped = np.clip(other, 0, hi - lo - 1)
                sides.append((clipped == other, np.minimum(65 - _bits(own ^ own[clipped]), 64), clipped != at))
            known = [np.where(inside, depth_of, 0) for inside, depth_of, _ in sides]
            far = [np.where(apart & end, depth_of, 0) for (_, depth_of, apart), end in zip(sides, (lo == 0, hi == len(sig)))]
            neither = ~sides[0][0] & ~sides[1][0]
            depth[lo:hi] = np.where(neither, np.maximum(*far), np.maximum(*known))
        missed = np.log(np.maximum(1 - (1 - angle / math.pi) ** depth, 1e-12))
        yield pa.RecordBatch.from_arrays([rows.column(3).combine_chunks(), pa.array(missed)], names=["lead", "missed"])

    return run


def passes_needed(leaders: DataFrame, threshold: float, window: int, recall: float, seed: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(lead, upto): passes after which a leader met each that its cell may link with, with a chance of ``recall``. The order of a pass is cut into ranges, whatever its groups."""
    probed = stored(leaders.withColumn("upto", F.lit(PROBES)).select("lead", "grp", "dim", "angle", "vec", "upto").mapInArrow(_signatures(list(range(PROBES)), seed, bare=True), "pass int, sig long, lead long, grp string, dim int, angle double"), "vec-probes")
    ranges = max(1, probed.count() // task_rows)
    order = probed.repartitionByRange(ranges, "pass", "grp", "sig", "lead").sortWithinPartitions("pass", "grp", "sig", "lead").select("pass", "grp", "sig", "lead", "angle")
    missed = order.mapInArrow(_missed(window), "lead long, missed double")
    return missed.groupBy("lead").agg(F.greatest(F.lit(1), F.ceil(F.least(F.lit(1e9), PROBES * math.log(1 - recall) / F.least(F.sum("missed"), F.lit(-1e-9))))).cast("int").alias("upto"))


def _gather(limit: float):
    """Rows in order join one of the last leaders of their group if all they lead stays within ``limit`` of it: (lead, into, angle + r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, ids, radii, at = None, None, [], [], 0
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:2])))
            own, rs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[tuple] = []
            for lo, hi in _runs(keys):
                x = _matrix(batch.column(4).slice(lo, hi - lo))
                if keys[lo] != group:
                    group, heads, ids, radii, at = keys[lo], np.zeros((RECENT, x.shape[1])), [-1] * RECENT, [0.0] * RECENT, 0
                for i in range(lo, hi):
                    d = heads @ x[i - lo]
                    k = int(d.argmax())
                    far = math.acos(min(1.0, max(-1.0, d[k]))) if ids[k] >= 0 else math.inf
                    if far + rs[i] <= limit:
                        out.append((own[i], ids[k], far + rs[i]))
                    else:
                        heads[at], ids[at], radii[at] = x[i - lo], own[i], rs[i]
                        at = (at + 1) % RECENT
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["lead", "into", "reach"])

    return run


def _near(x: np.ndarray, r: np.ndarray, threshold: float, a: slice, b: slice) -> np.ndarray:
    """Whether members of the leaders in ``a`` and ``b`` may link, and the leaders' cosines."""
    c = x[a] @ x[b].T
    reach = np.minimum(math.acos(threshold) + r[a][:, None] + r[b][None, :], math.pi)
    return np.where(reach > math.acos(threshold), c >= np.cos(reach), c >= threshold), c


def _windows(threshold: float, tile: int):
    """A spanning forest of the leaders whose members may link, by windows, and the first and last rows of the task for the windows across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        task, names = TaskContext.get().partitionId(), ["a", "b", "edge", "pass", "grp", "after", "r", "vec"]
        keys = list(zip(*(rows.column(k).to_pylist() for k in range(2))))
        ids, r, vecs = rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(4).combine_chunks()
        for lo, hi in _runs(keys):
            x, own, met = _matrix(vecs.slice(lo, hi - lo)), r[lo:hi], []
            for at in range(0, hi - lo, tile):
                hit, _ = _near(x, own, threshold, slice(at, at + tile), slice(at, at + 2 * tile))
                i, j = np.nonzero(np.triu(hit, 1))
                met.append((i + at, j + at))
            a, b = forest(ids[lo:hi], unite(np.arange(hi - lo), *map(np.concatenate, zip(*met))))
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.float64()), pa.nulls(n, vecs.type)], names=names)
        for edge, lo, hi in ((task, 0, tile), (task + 1, max(0, len(ids) - tile), len(ids))):
            part = rows.slice(lo, min(hi, len(ids)) - lo)
            n, column = part.num_rows, lambda k, part=part: part.column(k).combine_chunks()
            yield pa.RecordBatch.from_arrays([column(2), pa.nulls(n, pa.int64()), pa.array(np.full(n, edge), pa.int32()), column(0), column(1), pa.array(np.full(n, edge == task)), column(3), column(4)], names=names)

    return run


def _across(threshold: float):
    """The same between the last rows of a task and the first of the next; rows come sorted by edge, pass and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            ids, after, r = rows.column(3).to_numpy(), rows.column(4).to_numpy(zero_copy_only=False).astype(bool), rows.column(5).to_numpy()
            hit, _ = _near(_matrix(rows.column(6).combine_chunks()), r, threshold, slice(None), slice(None))
            a, b = forest(ids, unite(np.arange(len(ids)), *np.nonzero(hit & ~after[:, None] & after[None, :])))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The rows of each group: those with equal first ``n`` columns, by which they come sorted."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:n])))
        for lo, hi in _runs(keys):
            if keys[lo] != at and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sides(rows: pa.Table) -> tuple[int, bool]:
    """Rows of the first block, and whether there is no other: rows are (group, ba, bb, side, ...), first blocks first."""
    return int((~rows.column(3).to_numpy(zero_copy_only=False).astype(bool)).sum()), rows.column(1)[0].as_py() == rows.column(2)[0].as_py()


def _slices(n: int, one: bool, total: int) -> Iterator[tuple[slice, slice]]:
    """The rows of the first block, some at a time, and those to compare them with."""
    for lo in range(0, n, SLICE):
        yield slice(lo, min(lo + SLICE, n)), slice(lo if one else n, total)


def _met(threshold: float):
    """A spanning forest of the leaders of two blocks (or of one, if ba = bb) whose members may link; rows come sorted by grp, ba, bb and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            x, ids, r = _matrix(rows.column(6).combine_chunks()), rows.column(4).to_numpy(), rows.column(5).to_numpy()
            n, one = _sides(rows)
            label = np.arange(len(ids))
            for here, there in _slices(n, one, len(ids)):
                hit, _ = _near(x, r, threshold, here, there)
                i, j = np.nonzero(np.triu(hit, 1) if one else hit)
                label = unite(label, i + here.start, j + there.start)
            a, b = forest(ids, label)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


LINKS, SURE, PARTLY = range(3)


def _counted(threshold: float):
    """What two blocks of one set (or one, if ba = bb) link: (LINKS, unit, how many rows it links with), (SURE, a, b) in a spanning forest, (PARTLY, a, b) where only some members of a large cell may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = math.acos(threshold)

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        for rows in _grouped(batches, 3):
            x, ids, r, size = _matrix(rows.column(7).combine_chunks()), rows.column(4).to_numpy(), rows.column(5).to_numpy(), rows.column(6).to_numpy().astype(float)
            n, one = _sides(rows)
            label, links = np.arange(len(ids)), np.zeros(len(ids))
            for here, there in _slices(n, one, len(ids)):
                hit, c = _near(x, r, threshold, here, there)
                if one:
                    hit = np.triu(hit, 1)
                sure, reach = hit, r[here][:, None] + r[there][None, :]
                if reach.any():
                    sure = hit & ((reach == 0) | (np.arccos(np.clip(c, -1, 1)) + reach <= theta - 1e-9))
                    i, j = np.nonzero(hit & ~sure)
                    yield out(PARTLY, ids[here][i], ids[there][j])
                links[here] += sure @ size[there]
                links[there] += sure.T @ size[here]
                i, j = np.nonzero(sure)
                label = unite(label, i + here.start, j + there.start)
            some = np.flatnonzero(links)
            yield out(LINKS, ids[some], links[some].astype(np.int64))
            yield out(SURE, *forest(ids, label))

    return run


def _blocks(threshold: float):
    """Members of two units, a block of each: (cls, links with the other side) and whether there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 4):
            x, side = _matrix(rows.column(7).combine_chunks()), rows.column(4).to_numpy(zero_copy_only=False).astype(bool)
            cls, n = rows.column(5).to_numpy(), rows.column(6).to_numpy().astype(float)
            hit = x[~side] @ x[side].T >= threshold
            links = np.concatenate((hit @ n[side], hit.T @ n[~side])).astype(np.int64)
            who = np.concatenate((cls[~side], cls[side]))
            some = np.flatnonzero(links)
            a, b = (np.full(len(some), rows.column(k)[0].as_py()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (a, b, who[some], links[some]))], names=["a", "b", "cls", "links"])

    return run


def _paired_blocks(rows: DataFrame, own, other, *columns: str) -> DataFrame:
    """Each row once for each block ``other`` that its block ``own`` meets, sorted for the functions above; ``columns`` start with the group."""
    met = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(other.cast("array<int>")))
    group, *rest = columns
    met = met.select(group, F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"), (F.col("own") > F.col("other")).alias("side"), *rest)
    return met.repartition(group, "ba", "bb").sortWithinPartitions(group, "ba", "bb", "side")


def _with_all(leaders: DataFrame, threshold: float, span: int) -> DataFrame:
    """A forest of leaders, at least one of each two ``crowded``, whose members may link: blocks of crowded leaders meet all blocks of their group."""
    many = leaders.groupBy("grp").agg(F.count_if("crowded").alias("nc"), F.count_if(~F.col("crowded")).alias("no")).where("nc > 0")
    many = many.select("grp", F.ceil(F.col("nc") / span).cast("int").alias("bc"), F.ceil(F.col("no") / span).cast("int").alias("bo"))
    own = F.when(F.col("crowded"), F.pmod(F.xxhash64("lead"), F.col("bc"))).otherwise(F.col("bc") + F.pmod(F.xxhash64("lead"), F.greatest("bo", F.lit(1))))
    last = F.when(F.col("crowded"), F.col("bc") + F.col("bo")).otherwise(F.col("bc")) - 1
    many = F.broadcast(many) if small_enough(many, _BROADCAST) else many
    return _paired_blocks(leaders.join(many, "grp"), own, F.sequence(F.lit(0), last), "grp", "lead", "r", "vec").mapInArrow(_met(threshold), "a long, b long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD, tile: int = TILE, recall: float = RECALL, rounds: int = ROUNDS, seed: int = 11, worth: int = WORTH, span: int = SPAN, large: int = LARGE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are compared in double precision where their labels are equal and
    not null and their lengths are equal. A vector that is null, empty or zero,
    or holds a null or non-finite component, links with nothing; nor does one
    with a null id. Repeated rows are vectors of their own and link with each
    other; they share an id and its component. An empty table gives no rows;
    extra columns aren't read. The threshold must be above 0.
    """
    limit = math.acos(threshold) / 2 - 1e-6
    x = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col).cast("string") if label_col else F.lit("")).alias("label"), F.col(vec_col).alias("vec"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    usable = rows.where("good").withColumn("dim", F.size("vec")).withColumn("grp", F.concat_ws(":", "dim", "label"))
    classes = stored(usable.groupBy("grp", "dim", "vec").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n")), "vec-classes")

    # cells
    leaders = classes.select(F.col("cls").alias("lead"), "grp", "dim", F.lit(0.0).alias("r"), "vec")
    members = classes.select("cls", F.col("cls").alias("lead"))
    n = classes.count()
    for k in range(rounds):
        joined = stored(_ordered(leaders.withColumn("upto", F.lit(k + 1)), [k], seed + 1, n).mapInArrow(_gather(limit), "lead long, into long, reach double").dropDuplicates(["lead"]), "vec-joined")
        reach = joined.groupBy(F.col("into").alias("lead")).agg(F.max("reach").alias("reach"))
        leaders = stored(leaders.join(joined, "lead", "left_anti").join(reach, "lead", "left").select("lead", "grp", "dim", F.greatest("r", F.coalesce("reach", F.lit(0.0))).alias("r"), "vec"), "vec-leaders")
        members = members.join(joined.select("lead", "into"), "lead", "left").select("cls", F.coalesce("into", "lead").alias("lead"))
    members = stored(members.join(classes, "cls").select("cls", "lead", "n", "vec"), "vec-members")
    cells = stored(members.groupBy("lead").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("cls").alias("least")), "vec-cells")

    # passes over leaders
    group = leaders.groupBy("grp").agg(F.count(F.lit(1)).alias("all"), F.max("r").alias("most"))
    leaders = leaders.join(group, "grp").withColumn("angle", F.least(math.acos(threshold) + F.col("r") + F.col("most"), F.lit(math.pi)))
    needed = passes_needed(leaders.where(F.col("all") > 3 * tile), threshold, tile, recall, seed)
    dense = (F.col("upto") > PASSES) & (F.col("upto").cast("long") * (worth + 3 * tile) >= F.col("all"))
    leaders = leaders.join(needed, "lead", "left").withColumn("upto", F.coalesce("upto", F.lit(1))).withColumn("crowded", (F.col("all") <= 3 * tile) | dense)
    leaders = stored(leaders.select("lead", "grp", "dim", "r", "vec", "upto", "crowded"), "vec-passes")
    spread = leaders.where("not crowded")
    copies = spread.agg(F.sum(F.col("upto").cast("long"))).first()[0] or 0
    vec = classes.schema["vec"].dataType.simpleString()
    pair = "a long, b long, c double, ra double, rb double"
    found = stored(_ordered(spread, None, seed, copies).mapInArrow(_windows(threshold, tile), f"a long, b long, edge int, pass int, grp string, after boolean, r double, vec {vec}"), "vec-windows")
    edges = found.where("edge is not null").select("edge", "pass", "grp", "a", "after", "r", "vec").repartition("edge", "pass", "grp").sortWithinPartitions("edge", "pass", "grp")
    near = found.where("edge is null").select("a", "b").union(edges.mapInArrow(_across(threshold), "a long, b long")).union(_with_all(leaders, threshold, span))
    sets = stored(components(near), "vec-sets")

    # links within each set: of vectors, and of large cells as wholes
    held = members.join(cells.select("lead", "rows", (F.col("rows") >= large).alias("whole")), "lead").withColumn("unit", F.when(F.col("whole"), F.col("lead")).otherwise(F.col("cls")))
    held = held.join(sets, held["lead"] == sets["node"], "left").join(leaders.select("lead", "r"), "lead")
    held = stored(held.select("cls", "n", "vec", "lead", "unit", "whole", F.when(F.col("whole"), F.col("r")).otherwise(0.0).alias("r"), F.coalesce("root", "lead").alias("set"), (F.col("root").isNotNull() | (F.col("rows") > 1)).alias("company")), "vec-units")
    sizes = stored(held.groupBy("unit").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("cls").alias("least")), "vec-sizes")
    units = stored(held.where("company AND cls = unit").join(sizes.select("unit", "size"), "unit").select("set", "unit", "r", "size", "vec"), "vec-counted")
    wide = units.groupBy("set").agg(F.count(F.lit(1)).alias("n")).select("set", F.ceil(F.col("n") / F.least(F.lit(span), F.greatest(F.lit(TILE), F.ceil(F.col("n") / SHARES)))).cast("int").alias("blocks")).where("blocks > 1")
    wide = F.broadcast(wide) if small_enough(wide, _BROADCAST) else wide
    blocks = F.coalesce("blocks", F.lit(1))
    met = _paired_blocks(units.join(wide, "set", "left"), F.pmod(F.xxhash64("unit"), blocks), F.sequence(F.lit(0), blocks - 1), "set", "unit", "r", "size", "vec")
    counted = stored(met.mapInArrow(_counted(threshold), "kind int, a long, b long"), "vec-links")
    beside = counted.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("unit")).agg(F.sum("b").alias("beside"))
    whole, partly = counted.where(F.col("kind") == SURE).select("a", "b"), counted.where(F.col("kind") == PARTLY).select("a", "b")

    # members of units of which only some may link
    sized = sizes.select("unit", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    partly = partly.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b")
    side = held.select("unit", "cls", "n", "vec")

    def half(own: str, other: str, right: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("cls"), F.col(f"n{own}")).cast("int")
        out = partly.join(side.withColumnRenamed("unit", own), own).withColumn("mine", block).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        ba, bb = ("theirs", "mine") if right else ("mine", "theirs")
        return out.select("a", "b", F.col(ba).alias("ba"), F.col(bb).alias("bb"), F.lit(right).alias("side"), "cls", "n", "vec")

    some = half("a", "b", False).unionByName(half("b", "a", True)).repartition("a", "b", "ba", "bb").sortWithinPartitions("a", "b", "ba", "bb", "side")
    some = stored(some.mapInArrow(_blocks(threshold), "a long, b long, cls long, links long"), "vec-some")

    least = sizes.select("unit", "least")
    links = whole.union(some.select("a", "b").distinct()).join(least.toDF("a", "la"), "a").join(least.toDF("b", "lb"), "b")
    roots = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    of_unit = sizes.join(beside, "unit", "left").join(roots, sizes["least"] == roots["node"], "left").select("unit", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("links"), F.coalesce("root", "least").alias("component_id"))
    partial = some.groupBy("cls").agg(F.sum("links").alias("more"))
    of_class = held.select("cls", "unit").join(of_unit, "unit").join(partial, "cls", "left").select("cls", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    keyed = classes.select("cls", "grp", "vec").join(of_class, "cls")
    copied = classes.where(F.col("n") > max(1, usable.count() // HOT_NODES)).select("grp", "vec")
    linked = join_unique(usable.select("id", "grp", "vec"), keyed.drop("cls"), ["grp", "vec"], "inner", copied).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``embeddings``."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
r AS (SELECT a AS vec_id, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN r USING (vec_id) LEFT JOIN n USING (vec_id)
"""
