"""Stupid-backoff scores against the rest of the corpus, computed relationally.

Three relations are joined on hashed n-grams. Documents are dealt into blocks of
bounded text. A block's exploded n-grams, each distinct one once with its count,
go to the owner of their hash range (relation 1: block, key, count). An owner's
sums are the n-gram count table of its range (relation 2: key, count), joined
there to the n-grams that ask for it, and the totals go back to their blocks
(relation 3). There they meet the documents' n-grams again and are summed per
document. Rows of the relations travel packed, the keys of one block and range
as one array. As a block asks for an n-gram once, however many of its documents
hold it, the most frequent n-gram has one entry a block.

Rows must not grow as blocks times ranges. So a sender has ``FAN`` receivers at
most; where there are more blocks, owners are reached in levels: that many
senders' keys of one coarse range are merged, each distinct one once, and the
merged keys are dealt over finer ranges, until a range has all its keys in one
place. Totals come back the same way. Each level moves at most the keys of the
level before, in at most ``FAN`` rows a sender, so rows grow with the input.

A document's own counts are taken off all totals, so it is scored by what the
other documents say; n-grams found nowhere else back off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_row_hash

ORDER, ALPHA = 2, 0.4
#: Characters of text for each block, and the ranges its keys are cut into at most (64 keys or so each).
BLOCK_CHARS, FAN = 4 << 20, 1 << 14
_ASKED = "owner long, sender long, keys binary, counts binary"
_TOLD = "sender long, owner long, totals binary"
_SCORED = "doc_id long, n_tokens long, n_backoff long, log_score double"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def block_grams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document of each token, place of each token in it, the hashes of the n-grams that end there by n); a hash means nothing where place < n - 1."""
    hashes, held, sizes = _Hashes(), [], []
    for text in texts:
        own = np.fromiter(map(hashes.__getitem__, (text or b"").split()), np.uint64)
        held.append(own)
        sizes.append(len(own))
    words = np.concatenate(held) if held else np.empty(0, np.uint64)
    n = np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    grams = [words]
    for _ in range(1, order):
        grams.append(_mix(np.r_[np.zeros(1, np.uint64), grams[-1][:-1]][: len(words)], words))
    return doc, place, grams


def _packed(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, least byte first: planes of zeros all but vanish when the shuffle compresses them."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64) * parts >> 32


def _distinct(place: np.ndarray, grams: list[np.ndarray], **more) -> tuple:
    """All n-grams of a block as sorted distinct keys (so that hash ranges follow each other)."""
    return np.unique(np.concatenate([g[place >= k] for k, g in enumerate(grams)]), **more)


def fanned(blocks: int, most: int = FAN) -> tuple[int, int]:
    """(levels, fan): the fewest levels, and for them the least fan (``most`` at most, but 2 at least), with which ``fan ** levels`` reaches ``blocks``."""
    levels, most = 1, max(most, 2)
    while most**levels < blocks:
        levels += 1
    fan = max(1, round(blocks ** (1 / levels)) - 1)
    while fan**levels < blocks:
        fan += 1
    return levels, fan


def _send(keys: np.ndarray, counts: np.ndarray, sender: int, level: int, fan: int) -> pa.Table:
    """A sender's sorted keys, cut at the ranges of the next level.

    On level l a group is numbered (s, p): the blocks whose number divided by
    ``fan ** l`` is s, and the p-th of ``fan ** l`` hash ranges. On level 0 it is a block.
    """
    ranges = fan ** (level + 1)
    part = _part(keys, ranges)
    some, at = np.unique(part, return_index=True)
    cuts = [*at.tolist(), len(keys)]
    base = sender // fan**level // fan * ranges
    return pa.table(
        {"owner": pa.array(some + base, pa.int64()), "sender": pa.array([sender] * len(some), pa.int64())}
        # sorted keys travel as their differences
        | {"keys": pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cuts, cuts[1:])], pa.binary()), "counts": pa.array([_packed(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())}
    )


def _ask(order: int, fan: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, place, grams = block_grams(rows.column("text").to_pylist(), order)
        return _send(*_distinct(place, grams, return_counts=True), key[0].as_py(), 0, fan)

    return run


def _met(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The distinct keys that a group was sent, sorted; where each sent key is among them; where each row's begin."""
    keys = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
    table, at = np.unique(np.concatenate(keys), return_inverse=True)
    return table, at, np.cumsum([0, *map(len, keys)]).tolist()


def _sums(rows: pa.Table, at: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    np.add.at(total, at, np.concatenate([_unpacked(x) for x in rows.column("counts").to_pylist()]).astype(np.int64))
    return total


def _merge(level: int, fan: int):
    """A group's keys, each distinct one once with its sum, sent on to finer ranges."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        table, at, _ = _met(rows)
        return _send(table, _sums(rows, at, len(table)), key[0].as_py(), level, fan)

    return run


def _answer(rows: pa.Table, told: np.ndarray, cuts: list[int]) -> pa.Table:
    return pa.table({"sender": rows.column("sender"), "owner": rows.column("owner"), "totals": pa.array([_packed(told[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _tell(rows: pa.Table) -> pa.Table:
    """The count table of one hash range, joined to each sender's keys."""
    table, at, cuts = _met(rows)
    return _answer(rows, _sums(rows, at, len(table))[at], cuts)


def _totals(told: pa.Table) -> np.ndarray:
    """What a sender was told, in the order of its keys."""
    return np.concatenate([_unpacked(x) for x in told.sort_by("owner").column("totals").to_pylist()] or [np.empty(0, np.uint64)]).astype(np.int64)


def _pass_on(rows: pa.Table, told: pa.Table) -> pa.Table:
    """What a merged group was told, to each of its own senders."""
    _, at, cuts = _met(rows)
    return _answer(rows, _totals(told)[at], cuts)


def _own(doc: np.ndarray, index: np.ndarray) -> np.ndarray:
    """How often each token's n-gram stands in its own document."""
    _, at, n = np.unique(doc << 40 | index, return_inverse=True, return_counts=True)
    return n[at]


def _score(order: int, alpha: float, all_tokens: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        doc, place, grams = block_grams(rows.column("text").to_pylist(), order)
        _, at = _distinct(place, grams, return_inverse=True)
        totals = _totals(told)
        n_docs = rows.num_rows
        n = np.bincount(doc, minlength=n_docs)
        others = np.maximum(all_tokens - n, 1).astype(float)
        rest, lo = [others[doc]], 0
        for k in range(order):
            valid = place >= k
            index = at[lo : lo + int(valid.sum())]
            lo += len(index)
            left = np.zeros(len(doc), np.int64)
            left[valid] = totals[index] - _own(doc[valid], index)
            rest.append(left.astype(float))
        top = np.minimum(place + 1, order)
        score = top * np.log(alpha) - np.log(rest[0])  # no n-gram is known elsewhere
        found = np.zeros(len(doc), np.int64)
        for k in range(1, order + 1):
            known = rest[k] > 0
            context = rest[0] if k == 1 else np.r_[1.0, rest[k - 1][:-1]][: len(doc)]
            score[known] = (top[known] - k) * np.log(alpha) + np.log(rest[k][known] / context[known])
            found[known] = k
        total = np.bincount(doc, score, n_docs)
        backed = np.bincount(doc, found < top, n_docs).astype(np.int64)
        mean = [float(t) / int(m) if m else None for t, m in zip(total, n)]
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "n_backoff": pa.array(backed, pa.int64()), "log_score": pa.array(mean, pa.float64())})

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, most: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_backoff, log_score (the mean log score of its words).

    The score of a word is its relative frequency after the ``order - 1`` words
    before it, in all other documents; where that n-gram isn't found, ``alpha``
    times that after one word fewer, and so on; a word unknown elsewhere counts
    as one with ``alpha`` once more. A null or empty text has no words and a
    null score. Repeated rows are documents of their own and know each other's
    n-grams. An empty table gives no rows; extra columns aren't read. Results
    don't depend on ``block_chars`` and ``most``, the ranges a sender deals to.
    """
    sizes = docs.select(F.length(text_col).alias("n"), F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")).agg(F.sum("n"), F.sum("w")).first()
    chars, tokens = (int(x or 0) for x in sizes)
    blocks = max(1, -(-chars // block_chars))
    levels, fan = fanned(blocks, most)
    # both uses of the blocks must deal alike, also when a task is run again
    rows = with_row_hash(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), "row")
    dealt = rows.select("doc_id", "text", F.pmod("row", F.lit(blocks)).alias("block"))
    asked = [dealt.groupBy("block").applyInArrow(_ask(order, fan), _ASKED)]
    for level in range(1, levels):
        asked.append(asked[-1].groupBy("owner").applyInArrow(_merge(level, fan), _ASKED))
    told = asked.pop().groupBy("owner").applyInArrow(_tell, _TOLD)
    while asked:
        told = asked.pop().groupBy("owner").cogroup(told.groupBy("sender")).applyInArrow(_pass_on, _TOLD)
    return dealt.groupBy("block").cogroup(told.groupBy("sender")).applyInArrow(_score(order, alpha, tokens), _SCORED)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole of ``documents``, to six places."""
    scored = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.withColumn("log_score", F.round("log_score", 6))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
        count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS cw,
        count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS cvw FROM t),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w), o AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY doc_id, w),
s AS (SELECT c.doc_id, CASE WHEN v IS NOT NULL AND cvw > 0 THEN ln(cvw::DOUBLE / (u.n - o.n))
        ELSE (CASE WHEN v IS NULL THEN 0 ELSE 1 END + CASE WHEN cw > 0 THEN 0 ELSE 1 END) * ln(0.4::DOUBLE) + ln(greatest(cw, 1)::DOUBLE / greatest(c.n, 1)) END AS s,
        CASE WHEN v IS NULL THEN cw = 0 ELSE cvw = 0 END AS b
      FROM c LEFT JOIN u ON u.w = c.v LEFT JOIN o ON o.w = c.v AND o.doc_id = c.doc_id)
SELECT d.doc_id, count(s.s) AS n_tokens, count(*) FILTER (b) AS n_backoff, round(avg(s.s), 6) AS log_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
