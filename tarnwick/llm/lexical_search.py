"""Ranked lexical search by sort-based accumulation.

Documents stay where they are read; the queries' terms come to them. A task
looks its documents' terms up, and concatenates for each matched term the arrays
(item, document, impact) of the items that hold it. The keys, item and document
packed into one integer, are radix sorted by 16-bit digits, and equal keys are
summed by ``reduceat``. A heap for each item keeps its best of a task. What the
tasks kept is range-partitioned by item and document, so an item with many rows
takes several tasks, and heaps select again.

Items are taken in blocks of a bounded number of (item, term) pairs, all of them
in one block as a rule; each block meets all documents twice, once to count the
documents that hold a term, once for the scores. No text is shuffled. All sums
are 64-bit integers, so results depend on no order.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 10
#: ASCII letters and digits and all that isn't ASCII, as bytes of UTF-8 and as Java's and DuckDB's pattern.
_TERM, _GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs (item, term) in a block of items, which is what a task holds of the queries; a single item may exceed it.
BLOCK_PAIRS = 1 << 20
#: Bytes of text, and impacts, that a task takes at a time.
STEP, STEP_IMPACTS = 4 << 20, 1 << 21
#: Rows of one item in a step from which its tenth best is found before rows go to the heap.
_MANY = 64


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys: passes over 16-bit digits from the least (numpy sorts 16-bit integers stably by radix)."""
    order, shift, top = None, 0, int(keys.max(initial=0))
    while not shift or top >> shift:
        digit = ((keys if order is None else keys[order]) >> np.uint64(shift)).astype(np.uint16)
        by = np.argsort(digit, kind="stable")
        order = by if order is None else order[by]
        shift += 16
    return order


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def _terms(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's terms in order, those of a few MB at a time."""
    at, text = 0, text or b""
    while at < len(text):
        gap = _GAP.search(text, at + STEP)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = end


class Queries:
    """A block of items: their ids, their distinct terms, and for each term the items (by place) that hold it."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, i or 0))
        at = {i: k for k, i in enumerate(self.ids)}
        held: dict[bytes, list[int]] = {}
        for item, term in rows:
            held.setdefault(term.encode("utf-8", "surrogatepass"), []).append(at[item])
        self.terms = sorted(held)
        sizes = [len(held[t]) for t in self.terms]
        self.first = np.cumsum([0, *sizes])
        self.items = np.array([i for t in self.terms for i in sorted(held[t])], np.int64)
        self._places: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_places": None}

    @property
    def places(self) -> dict[bytes, int]:
        if self._places is None:
            self._places = {t: k for k, t in enumerate(self.terms)}
        return self._places

    def frequencies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the queries' terms by document and term, and each document's number of terms."""
        found, doc, sizes = [np.empty(0, np.int64)], [], np.zeros(len(texts), np.int64)
        for d, text in enumerate(texts):
            for words in _terms(text):
                sizes[d] += len(words)
                at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
                found.append(at[at >= 0])
                doc.append(np.full(len(found[-1]), d))
        keys = (np.concatenate([np.empty(0, np.int64), *doc]) * max(1, len(self.terms)) + np.concatenate(found)).astype(np.uint64)
        keys = keys[radix_order(keys)]
        cuts = _starts(keys)
        one = keys[cuts].astype(np.int64)
        return one // max(1, len(self.terms)), one % max(1, len(self.terms)), np.diff(np.r_[cuts, len(keys)]), sizes


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """Ids and texts of a bounded number of bytes at a time."""
    for batch in batches:
        lo, size, texts = 0, 0, []
        for k, text in enumerate(batch.column(1)):
            texts.append(text.as_py())
            size += len(texts[-1] or b"")
            if size > STEP:
                yield batch.column(0).slice(lo, k + 1 - lo), texts
                lo, size, texts = k + 1, 0, []
        if texts:
            yield batch.column(0).slice(lo), texts


def _counts(queries: Queries):
    """(term, n): documents of a task that hold each term; -1 for those with any term, -2 for all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, every = np.zeros(len(queries.terms), np.int64), 0, 0
        for _, texts in _steps(batches):
            _, term, _, sizes = queries.frequencies(texts)
            df += np.bincount(term, minlength=len(df))
            n += int((sizes > 0).sum())
            every += int(sizes.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2]), pa.array(np.r_[df[some], n, every])], names=["term", "n"])

    return run


class Heaps:
    """The best rows of each item: highest score, then lowest document id, ids that are null last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, {}, {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        heap = self.rows.setdefault(item, [])
        for score, doc in zip(scores.tolist(), ids):
            row = (score, doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]

    def batch(self, names: list) -> pa.RecordBatch:
        out = [(names[item], -doc if known else None, score) for item, heap in self.rows.items() for score, known, doc in heap]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["item_id", "doc_id", "score"])


def accumulate(queries: Queries, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score), sorted, for some documents at a time: impacts of all matched items side by side, sorted by packed keys and summed."""
    many = queries.first[term + 1] - queries.first[term]
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    # cuts fall between documents, so that a document's impacts are summed in one place
    begin = _starts(doc)
    total = np.r_[0, np.cumsum(many)]
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(total[np.r_[begin[1:], len(doc)]], total[begin[lo]] + STEP_IMPACTS, "right")))
        rows = slice(begin[lo], begin[hi] if hi < len(begin) else len(doc))
        lo = hi
        n = many[rows]
        at = np.repeat(queries.first[term[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = int(doc[rows.start])
        span = int(doc[rows.stop - 1]) - base + 1
        keys = (queries.items[at] * span + np.repeat(doc[rows] - base, n)).astype(np.uint64)
        order = radix_order(keys)
        keys = keys[order]
        cuts = _starts(keys)
        if len(cuts):
            score = np.add.reduceat(np.repeat(impact[rows], n)[order], cuts)
            keys = keys[cuts].astype(np.int64)
            yield keys // span, keys % span + base, score


def _scores(queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The ``k`` best rows of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Heaps(k)
        for ids, texts in _steps(batches):
            doc, term, tf, sizes = queries.frequencies(texts)
            m = 100 - 90 + (90 * sizes * n_docs) // max(1, n_terms)
            for item, at, score in accumulate(queries, weights, doc, term, tf, m):
                cuts = [*_starts(item).tolist(), len(item)]
                for a, b in zip(cuts, cuts[1:]):
                    own, one = score[a:b], int(item[a])
                    least = max(1, best.least.get(one, 1))
                    if b - a > _MANY:
                        least = max(least, int(np.partition(own, -k)[-k])) if k < b - a else least
                    some = np.flatnonzero(own >= least)
                    if len(some):
                        best.add(one, own[some], ids.take(pa.array(at[a:b][some])).to_pylist())
        yield best.batch(queries.ids)

    return run


def _select(k: int):
    """The ``k`` best rows of each item in a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names, at = Heaps(k), [], {}
        for batch in batches:
            items, docs, scores = (c.to_pylist() for c in batch.columns)
            for item, doc, score in zip(items, docs, scores):
                if item not in at:
                    at[item] = len(names)
                    names.append(item)
                best.add(at[item], np.array([score]), [doc])
        yield best.batch(names)

    return run


def blocks_of(pairs: DataFrame, most: int) -> Iterator[DataFrame]:
    """``pairs`` (item_id, term) in blocks of whole items, each of at most ``most`` pairs unless it is one item."""
    total = pairs.count()
    n = max(1, -(-total // most))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        if n == 1:
            yield pairs
            return
        over = pairs.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items")).where((F.col("n") > most) & (F.col("items") > 1))
        if not over.limit(1).count():
            break
        n *= 2
    for b in range(n):
        yield pairs.where(block == b)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", most: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, best first.

    Rows of one item id, null among them, are one item with the terms of all;
    null and empty texts have no terms, and an item without terms, or whose
    terms no document holds, has no rows. A document with a null id is ranked
    after others of its score. Repeated rows of ``docs`` are documents of their
    own. Very long texts are taken whole, in steps. Empty tables give no rows;
    extra columns aren't read. Results don't depend on ``most``.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.col(query_col).cast("string"), UPPER, LOWER)
    pairs = stored(items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term")).distinct(), "search-pairs")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found: DataFrame | None = None
    for block in blocks_of(pairs, most):
        queries = Queries([tuple(r) for r in block.collect()])
        if not queries.ids:
            continue
        counted = texts.mapInArrow(_counts(queries), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        n = {r["term"]: r["n"] for r in counted}
        n_docs = n.get(-1, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n[t] + 1))) if t in n else 0 for t in range(len(queries.terms))], np.int64)
        part = texts.mapInArrow(_scores(queries, weights, n_docs, n.get(-2, 0), k), "item_id long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    ranges = stored(found, "search-found").repartitionByRange("item_id", "doc_id").mapInArrow(_select(k), "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return ranges.select("item_id", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0), c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= {TOP}
"""
