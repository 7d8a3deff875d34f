"""Byte-level BPE by a pair occurrence index.

A partition's texts (a bounded step of them, so that memory doesn't follow the
partition) are cut into pieces and pre-tokens, and each distinct piece is
encoded once. They lie in one symbol array; the index maps each adjacent pair
to all its positions. The active ranks (pairs that occur and merge) leave a
heap in ascending order; a rank is applied at all its positions at once, and
the lists of the pairs that appear beside them are updated. Positions that no
longer hold their pair are skipped when their list comes up.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of byte-level BPE: the pre-token pattern, and the bytes that stand for themselves in the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Characters of text a worker encodes together.
STEP = 12 << 20
#: Bytes that no UTF-8 text holds: the first of those for special tokens, the end of a word, the end of a piece.
_SPECIAL, _WORD_END, _PIECE_END = 0xF5, 0xFE, 0xFF

#: A space before something else always starts a pre-token, so texts may be cut there.
_CUT = re.compile(r" (?=\S)")


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        shown = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
        raw = {c: b for b, c in shown.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(self.special) > _WORD_END - _SPECIAL:
            raise ValueError(f"more than {_WORD_END - _SPECIAL} special tokens")
        self.bytes_of = {i: bytes(raw[c] for c in token) for token, i in vocab.items() if all(c in raw for c in token)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.shown_id = {i: str(i) for i in self.bytes_of}
        self.at_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)

        self.first = np.full(256, -1, np.int32)
        self.first[:_SPECIAL] = [vocab[shown[b]] for b in range(_SPECIAL)]
        self.first[_SPECIAL : _SPECIAL + len(self.special)] = list(self.special.values())
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        keys = self.left.astype(np.int64) << 32 | self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where it doesn't merge or a side is no symbol."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], -1)

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        """``symbols`` after all merges: -2 where a symbol went into the one before. The array begins and ends with -1, as words do."""
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(places: np.ndarray, ranks: np.ndarray) -> None:
            """Enter places in the lists of their pairs, and pairs that are new among the active ones."""
            held = ranks >= 0
            places, ranks = places[held], ranks[held]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, own in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else (), np.split(places, cuts)):
                if rank in index:
                    index[rank].append(own)
                else:
                    index[rank] = [own]
                    heapq.heappush(active, rank)

        put(np.arange(n - 1), self.ranks(symbols[:-1], symbols[1:]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            gone = after[at]
            live = (symbols[at] == a) & (symbols[gone] == b)
            at, gone = at[live], gone[live]
            if a == b and len(at) > 1:  # of overlapping places every second one, from the left
                k = np.arange(len(at))
                starts = np.r_[True, gone[:-1] != at[1:]]
                live = (k - np.maximum.accumulate(np.where(starts, k, 0))) % 2 == 0
                at, gone = at[live], gone[live]
            if not len(at):
                continue
            symbols[at], symbols[gone] = self.made[rank], -2
            far = after[gone]
            after[at] = far
            before[far] = at
            near = before[at]
            place = np.concatenate((near, at))
            put(place, self.ranks(symbols[place], symbols[np.concatenate((at, far))]))
        return symbols

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The tokens' bytes; unknown ids have none."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, special ones included."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def pieces(self, text: str) -> Iterator[str]:
        """Pieces of a text that encode on their own; special tokens are pieces."""
        for k, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                yield part
            elif part:
                head, *rest = _CUT.split(part)
                if head:
                    yield head
                yield from map(" ".__add__, rest)

    def words(self, piece: str) -> str:
        """A piece's pre-tokens, or its special token, with their ends marked."""
        if piece in self.special:
            return chr(0xDC00 + _SPECIAL + list(self.special).index(piece))
        return chr(0xDC00 + _WORD_END).join(self.pattern.findall(piece))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text; distinct pieces are encoded once, through one pair index."""
        number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        own = [np.fromiter(map(number.__getitem__, self.pieces(t)), np.int32) for t in texts]
        end = chr(0xDC00 + _PIECE_END)
        raw = (end + end.join(map(self.words, number)) + end).encode("utf-8", "surrogateescape")
        number.clear()
        raw = np.frombuffer(raw, np.uint8)
        symbols = self.merged(self.first[raw])
        kept = symbols >= 0
        per_piece = np.add.reduceat(kept, np.flatnonzero(raw == _PIECE_END)).astype(np.int64)[:-1]
        ids = symbols[kept]
        start = np.cumsum(per_piece) - per_piece
        for pieces in own:
            n = per_piece[pieces]
            at = np.repeat(start[pieces] - (np.cumsum(n) - n), n)
            yield ids[at + np.arange(len(at))].tolist()

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return next(self.encode_all([text]))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        shown = ",".join([self.shown_id[i] for i in ids]).encode()
        return len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per worker and file."""
    return Bpe(path)


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of rows, some 12 M characters at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(*batch.columns):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size > STEP:
                yield ids, texts
                ids, texts, size = [], [], 0
    yield ids, texts


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for ids, texts in _steps(batches):
            rows = [bpe.digest(x) for x in bpe.encode_all(texts)]
            cols = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, cols, (pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the SHA-256 of nothing. Ids, null
    or repeated, pass through. A text longer than a step is a step of its own.
    An empty table gives no rows; extra columns aren't read. ``path``: the
    vocabulary file, at the same place on every executor.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for ids, texts in _steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(bpe.encode_all(texts)), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids. A null text has no ids."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return run


def bpe_decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids are an empty text."""
    return rows.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(_decode(path), "doc_id long, text string")


def default_path() -> str:
    """The vocabulary the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``documents``."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
