"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent 1- to 3-grams in order, counted
over every training text. A document's own most frequent n-grams are ranked the
same way and compared by out-of-place distance: the sum over them of how far
each stands from its place in the profile, or the profile's length where it is
absent. The nearest profile names the language.

Text is lower-cased; n-grams stay within a run of letters, with one blank at
either end. Counting is exact over whole texts. Profiles, the only thing sent
to the workers, hold ``PROFILE`` n-grams a language, ``MAX_LANGUAGES`` at most.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile; languages that may be learned (more is an error).
PROFILE, MAX_LANGUAGES = 400, 1000
#: Characters counted at a time.
SEGMENT = 1 << 20
UNKNOWN = "und"
_BLANK = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _runs(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run between blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    out = np.where(letter, points, _BLANK).astype(np.int64)
    out = out[letter | np.r_[False, letter[:-1]]]
    return np.r_[_BLANK, out, _BLANK] if len(out) and out[-1] != _BLANK else np.r_[_BLANK, out]


def grams(text: str) -> np.ndarray:
    """The 1- to 3-grams of a text as packed code points, repeats included; none without letters."""
    x = _runs(text)
    if len(x) < 2:
        return np.empty(0, np.int64)
    letter = x != _BLANK
    pairs, triples = x[:-1] << 21 | x[1:], x[:-2] << 42 | x[1:-1] << 21 | x[2:]
    return np.concatenate((x[letter], pairs[letter[:-1] | letter[1:]], triples[letter[1:-1]]))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts; very long texts are counted in segments cut between words."""
    if len(text) <= SEGMENT:
        return _distinct(grams(text))
    total: Counter = Counter()
    words = text.split()
    size, held = 0, []
    for w in [*words, None]:
        if w is None or size > SEGMENT:
            total.update(dict(zip(*(a.tolist() for a in _distinct(grams(" ".join(held)))))))
            size, held = 0, []
        if w is not None:
            held.append(w)
            size += len(w) + 1
    keys = np.array(sorted(total), np.int64)
    return keys, np.array([total[k] for k in keys.tolist()], np.int64)


def _distinct(all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    all_.sort()
    if not len(all_):
        return all_, all_
    at = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]])
    return all_[at], np.diff(np.r_[at, len(all_)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed over a bounded number of distinct words at a time: each is split once, weighted by its count."""

    def out() -> Iterator[pa.RecordBatch]:
        for lang, count in words.items():
            keys, weights = list(count), np.fromiter(count.values(), np.int64)
            for lo in range(0, len(keys), 100_000):
                got, n = _weighted(keys[lo : lo + 100_000], weights[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(got), pa.array(n)], names=["lang", "gram", "n"])
        words.clear()

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(*batch.columns):
            words.setdefault(lang.as_py(), Counter()).update(text.as_py().split())
        if sum(map(len, words.values())) > 400_000:
            yield from out()
    yield from out()


def _weighted(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of words that occur ``weights`` times each."""
    marked = " ".join(words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.cumsum(points == _BLANK)  # words hold no blank of their own: split() cut there
    low = marked.lower()
    if len(low) != len(points):  # a letter whose lower case is longer: one word at a time keeps the owners right
        each = [grams(w) for w in words]
        all_, heavy = np.concatenate(each or [np.empty(0, np.int64)]), np.repeat(weights, [len(x) for x in each])
    else:
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[points]
        x = np.where(letter, points, _BLANK).astype(np.int64)
        kept = letter | np.r_[False, letter[:-1]]
        x, own = np.r_[_BLANK, x[kept], _BLANK], np.r_[0, owner[kept], len(words) - 1]
        letter = x != _BLANK
        pairs, triples = x[:-1] << 21 | x[1:], x[:-2] << 42 | x[1:-1] << 21 | x[2:]
        two, three = letter[:-1] | letter[1:], letter[1:-1]
        all_ = np.concatenate((x[letter], pairs[two], triples[three]))
        mine = np.where(letter[:-1], own[:-1], own[1:])
        heavy = weights[np.concatenate((own[letter], mine[two], own[1:-1][three]))]
    got, at = np.unique(all_, return_inverse=True)
    return got, np.bincount(at, heavy, len(got)).astype(np.int64)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each non-null language of ``docs``: its n-grams by falling count, ties by code points."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    found = best.limit(size * MAX_LANGUAGES + 1).collect()
    if len(found) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Profiles ready for lookups."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = PROFILE) -> None:
        self.names, self.size = sorted(by_lang), size
        self.grams, self.places = [], []
        for name in self.names:
            own = np.array(by_lang[name], np.int64)
            order = np.argsort(own)
            self.grams.append(own[order])
            self.places.append(order.astype(np.int64))

    def distances(self, text: str) -> tuple[np.ndarray, int]:
        """Out-of-place distance to each profile, and the largest there could be."""
        got, n = counted(text)
        if len(got) > self.size:
            # ties at the cut go by code points, as everywhere
            edge = np.partition(n, len(n) - self.size)[len(n) - self.size]
            inside = n >= edge
            got, n = got[inside], n[inside]
        top = got[np.lexsort((got, -n))][: self.size]
        place, out = np.arange(len(top)), np.empty(len(self.names), np.int64)
        for k, (known, places) in enumerate(zip(self.grams, self.places)):
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            out[k] = np.where(known[at] == top, np.abs(places[at] - place), self.size).sum()
        return out, self.size * len(top)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: first by name) and how near it is, from 0 to 1."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        d, most = self.distances(text)
        if not most:
            return UNKNOWN, 0.0
        k = int(d.argmin())
        return self.names[k], float(max(0.0, 1 - d[k] / most))


def _predict(by_lang: dict[str, list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(by_lang, size)
        for batch in batches:
            rows = [profiles.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter, and any text where no language was
    learned, is ``und`` with score 0. Ids, null or repeated, pass through. An
    empty table gives no rows; extra columns aren't read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(_predict(profiles, size), "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``documents``: learned from the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs.where(~held_out())))


# SQL has no CRC-32 and spells out its bits; letters are \p{L}, n-grams of equal counts go by length, then code points, as packed ones do.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, text, coalesce({_CRC} % 4 = 2, false) AS held_out FROM documents),
w AS (SELECT doc_id, ' ' || w || ' ' AS p, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM d WHERE text IS NOT NULL) GROUP BY ALL),
g AS (SELECT doc_id, gram, sum(c) AS n FROM (
        SELECT doc_id, c, unnest(list_transform(range(2, length(p)), lambda i: substr(p, i, 1))) AS gram FROM w
        UNION ALL SELECT doc_id, c, unnest(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) FROM w
        UNION ALL SELECT doc_id, c, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) FROM w) GROUP BY ALL),
prof AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) AS place
         FROM (SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY place <= {PROFILE}),
top AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) AS place FROM g QUALIFY place <= {PROFILE}),
langs AS (SELECT DISTINCT lang FROM prof),
dist AS (SELECT t.doc_id, l.lang, sum(coalesce(abs(p.place - t.place), {PROFILE}))::BIGINT AS far, count(*) * {PROFILE} AS most
         FROM top t CROSS JOIN langs l LEFT JOIN prof p ON p.lang = l.lang AND p.gram = t.gram GROUP BY ALL),
best AS (SELECT doc_id, lang, greatest(0.0::DOUBLE, 1 - far::DOUBLE / most) AS score FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT d.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (doc_id)
"""
