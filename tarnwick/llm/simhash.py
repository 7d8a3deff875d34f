"""SimHash near-dedup: 64-bit fingerprints, linked at few differing bits by pivot distance tables.

Equal fingerprints become one row first, so copies cost nothing later. The
pivots are reference fingerprints taken from the data, far from each other. The
table holds each fingerprint's Hamming distances to them, split into the parts
of the 64 bits that they come from. Of two parts, two fingerprints at 3
differing bits or fewer differ by one bit at most in one, so there each of
their distances to the pivots differs by one at most. Rows are dealt by cells
of equal distances to all pivots over one part, widened by one: every row goes
to its own cell, and rows of odd parity also to the cells that one bit leads
to. So each pair meets in a cell, and only pairs that the pivots put there do.
A cell that holds too many rows is dealt again in the same way over the bits
that it leaves open, until few bits are left.

Within a cell the whole distances decide: by the triangle inequality two
fingerprints whose distances to some pivot differ by more than 3 are further
apart than 3 bits. Rows are sorted by the first pivot's distance, so that
coordinate bounds each row's window; the other coordinates discard almost all
of the window, and what is left is verified by popcount. A cell hands on a
spanning forest of its links, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_unique, small_enough, stored, unite

SEED, SHINGLE, BITS = 42, 3, 3
#: Rows of a cell before it is dealt again; rows a worker compares at a time.
TILE, STEP = 1024, 100_000
#: Reference fingerprints, and the fingerprints they are chosen from.
PIVOTS, REFERENCES = 16, 256
#: Open bits below which a cell isn't dealt again: no more than 2**OPEN fingerprints share the others.
OPEN = 8
_HOT_LIMIT = 100_000


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    words = (text or b"").lower().split()  # both touch ASCII only
    n = max(1, len(words) - size + 1)
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 15):
        part = words[lo : lo + (1 << 15) + size - 1]
        rows = [hashed(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(size)))] if len(words) >= size else [hashed(b" ".join(words), SEED)]
        bits = np.unpackbits(np.array(rows, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return run


def linked(group: np.ndarray, fp: np.ndarray, pivots: np.ndarray, bits: int) -> np.ndarray:
    """For each row the first row of its set; rows are sorted by cell and distance to the first pivot."""
    table = np.array([np.bitwise_count(fp ^ p) for p in pivots], np.int8)
    label, rows, offset, held, size = np.arange(len(fp)), np.arange(len(fp)), 0, [], 0
    while rows.size:
        offset += 1
        i = rows[rows + offset < len(fp)]
        j = i + offset
        near = (group[i] == group[j]) & (table[0][j] - table[0][i] <= bits)
        rows = i = i[near]
        j = j[near]
        for coordinate in table[1:]:
            if not i.size:
                break
            keep = np.abs(coordinate[i] - coordinate[j]) <= bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        held.append((i[keep], j[keep]))
        size += int(keep.sum())
        if size > 1_000_000:
            label, held, size = unite(label, *map(np.concatenate, zip(*held))), [], 0
    return unite(label, *map(np.concatenate, zip(*held))) if held else label


def _links(pivots: np.ndarray, bits: int):
    """Reads (cell, rep, fp) sorted by cell and first coordinate; yields a spanning forest of each cell's links."""

    def forest(rows: pa.Table) -> pa.RecordBatch:
        group, rep, fp = (rows.column(k).to_numpy() for k in range(3))
        label = linked(group, fp.view(np.uint64), pivots, bits)
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[label[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= STEP:
                rows = pa.Table.from_batches(held)
                group = rows.column(0).to_numpy()
                cut = int(np.flatnonzero(group == group[-1])[0])  # the last group may go on
                if cut:
                    yield forest(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if held:
            yield forest(pa.Table.from_batches(held))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _positions(path: int, parts: int) -> list[np.ndarray]:
    """The parts of the bits that are open on a path: 1 is the start, a digit more for each part that has been dealt."""
    digits = []
    while path > 1:
        path, d = divmod(path, parts)
        digits.append(d)
    cut = np.array_split(np.arange(64), parts)
    for d in reversed(digits):
        cut = np.array_split(np.concatenate([p for k, p in enumerate(cut) if k != d]), parts)
    return cut


def cells(fp: np.ndarray, mask: int, pivots: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The cell of each fingerprint: its distances to the pivots over the bits of ``mask``, as one number with ``seed``."""
    key = seed.copy()
    for p in pivots:
        key = (key ^ np.bitwise_count((fp ^ p) & np.uint64(mask)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def _dealt(pivots: np.ndarray, bits: int):
    """Reads (cell, path, rep, fp); yields each row in the cells of its open parts, widened by one."""
    parts = bits // 2 + 1

    def out(cell, path, rep, fp) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.full(len(cell), path, np.int32)), pa.array(rep), pa.array(fp.view(np.int64))], names=["cell", "path", "rep", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, path, rep, fp = (c.to_numpy() for c in batch.columns)
            cell, fp = cell.view(np.uint64), fp.view(np.uint64)
            for at in np.unique(path).tolist():
                own = np.flatnonzero(path == at)
                for k, positions in enumerate(_positions(at, parts)):
                    mask, to = sum(1 << int(p) for p in positions), at * parts + k
                    x, r, seed = fp[own], rep[own], cell[own] * np.uint64(31) + np.uint64(to)
                    yield out(cells(x, mask, pivots, seed), to, r, x)
                    odd = np.flatnonzero(np.bitwise_count(x & np.uint64(mask)) & 1)
                    x, r, seed = x[odd], r[odd], seed[odd]
                    for p in positions:
                        yield out(cells(x ^ np.uint64(1 << int(p)), mask, pivots, seed), to, r, x)

    return run


def references(prints: DataFrame, n: int = PIVOTS, among: int = REFERENCES) -> np.ndarray:
    """``n`` fingerprints of the data, each as far from those before it as any of ``among``; random ones where there are too few."""
    some = [r["fp"] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(among).collect()]
    pool = np.concatenate((np.array(some, np.int64).view(np.uint64), np.random.default_rng(7).integers(0, 1 << 64, n, dtype=np.uint64)))
    chosen, far = [0], np.bitwise_count(pool ^ pool[0]).astype(int)
    while len(chosen) < n:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.bitwise_count(pool ^ pool[chosen[-1]]))
    return pool[chosen]


def simhash_links(prints: DataFrame, bits: int = BITS, tile: int = TILE, pivots: np.ndarray | None = None) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct ``fp`` that differ in ``bits`` bits at most: a spanning forest per cell."""
    pivots = references(prints) if pivots is None else pivots
    schema, parts = "cell long, path int, rep long, fp long", bits // 2 + 1
    rows, done, left = prints.select(F.lit(0).cast("long").alias("cell"), F.lit(1).alias("path"), "rep", "fp"), None, 64
    while True:
        dealt, left = stored(rows.mapInArrow(_dealt(pivots, bits), schema), "simhash-cells"), left - left // parts
        if left <= OPEN or left < 2 * parts:
            break
        full = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("cell")
        full = stored(full, "simhash-full")
        if not full.limit(1).count():
            break
        full = F.broadcast(full) if small_enough(full, _HOT_LIMIT) else full
        fit = dealt.join(full, "cell", "left_anti")
        done, rows = fit if done is None else done.unionByName(fit), dealt.join(full, "cell", "left_semi").select("cell", "path", "rep", "fp")
    done = dealt if done is None else done.unionByName(dealt)
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(pivots[0])))))
    met = done.select("cell", "rep", "fp", first.alias("d")).repartition("cell").sortWithinPartitions("cell", "d", "fp")
    return met.select("cell", "rep", "fp").mapInArrow(_links(pivots, bits), "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, kept.

    A null text counts as empty; texts without words have fingerprint zero and
    link like any other. Repeated rows share their id's component. Rows with a
    null id get the component of their fingerprint, or null where only null ids
    have it, and name no component. An empty table gives no rows; extra columns
    aren't read.
    """
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")
    hashed = stored(hashed, "simhash")
    prints = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(simhash_links(prints.where("rep is not null"), bits, tile))
    named = prints.join(roots, prints["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return join_unique(hashed, named, ["fp"], "inner").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``documents``."""
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
