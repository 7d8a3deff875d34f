"""Labels by containment: which documents hold which passages."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .places import small

#: Whole words of a passage that its documents are looked up by.
KEY_WORDS = 4
_GAP = r"[ \t\n\x0B\f\r]+"
#: Texts whose words a task holds at a time, and keys up to which the documents' runs are tried against them before they leave it.
PART, FEW_KEYS = 1024, 100_000


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest()) for w in words.to_pylist()], np.uint64)


def _run_keys(texts: pa.Array, n: int, known: tuple[pa.Array, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, number of the run in it, key) of all runs of ``n`` words between white space; words that aren't ``known`` (words, hashes) count as one."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if known is None:
        coded = words.flatten().dictionary_encode()
        h = _hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    else:
        h = np.append(known[1], np.uint64(0))[pc.fill_null(pc.index_in(words.flatten(), value_set=known[0]), len(known[0])).to_numpy(zero_copy_only=False)]
    size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    begins = np.flatnonzero(nth <= np.repeat(size, size) - n)
    key = np.zeros(len(begins), np.uint64)
    for k in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[begins + k]
    return place[begins], nth[begins], key.view(np.int64)


def _keys(df: DataFrame, ident: str, n: int, first: bool = False, among: list | None = None) -> DataFrame:
    """(ident, key) of the runs of ``n`` words of the texts of ``df`` (ident, text): each once, only the ``first`` behind a text's first word, or only runs ``among`` some."""
    known, wanted = None, None
    if among is not None:
        words = pa.array(sorted({w for run in among for w in run}), pa.string())
        known = words, _hashes(words)
        wanted = np.unique(_run_keys(pa.array([" ".join(run) for run in among], pa.string()), n)[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                part = b.slice(lo, PART)
                place, nth, key = _run_keys(part.column(1), n, known)
                keep = nth == 1 if first else np.ones(len(key), bool) if wanted is None else np.isin(key, wanted)
                rows = np.unique(np.stack([place[keep], key[keep]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 1])], names=[ident, "key"])

    return df.select(ident, "text").mapInArrow(run, f"{ident} {df.schema[ident].dataType.simpleString()}, key long")


def containment(docs: DataFrame, passages: DataFrame, words: int = KEY_WORDS) -> DataFrame:
    """(doc_id, item_id) where the document's text holds the passage's, letter by letter.

    The first whole words inside a passage are looked up among the documents'
    word runs, and what is found is compared in full, so no document meets
    passages that it shares no words with. The runs' keys are made in batches,
    and where the passages are few, only runs with one of their keys leave a
    batch. Passages too short for a key are compared with every document, in
    one pass over them.
    """
    inner = F.slice(F.split("text", _GAP), 2, words)
    split = passages.select("item_id", "text", (F.size(F.split("text", _GAP)) - 2 >= words).alias("long"))
    long = split.where("long").select("item_id", "text")
    keyed = stored(_keys(long, "item_id", words, first=True), "passage-keys")
    some = [r["run"] for r in long.select(inner.alias("run")).distinct().limit(FEW_KEYS + 1).collect()]
    runs = _keys(docs, "doc_id", words, among=some if len(some) <= FEW_KEYS else None)
    found = stored(runs.join(small(keyed), "key").select("doc_id", "item_id").distinct(), "passages-met")
    pairs = found.join(small(long.withColumnRenamed("text", "passage")), "item_id")
    checked = docs.select("doc_id", "text").join(small(pairs), "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    short = split.where("not long").select("item_id", F.col("text").alias("passage"))
    if short.limit(1).count():
        checked = checked.unionByName(docs.join(short, F.contains(docs["text"], F.col("passage"))).select("doc_id", "item_id"))
    return checked.distinct()
