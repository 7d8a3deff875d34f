"""Spelling variants of the corpus' words, by anagram hashing.

A word's key is the sum of its letters' fifth powers, one for all anagrams. Two
words that differ by one letter more or less have keys that differ by that
letter's value; two that differ in one letter have keys that differ by an
exchange value, so both come to the same key when each loses its letter. Each
word is therefore sent to its own key, and to its key less each of its letters,
and words meet at equal keys. There the order of the letters that are left
decides: it is the second part of the join's key, so anagrams that share a key
but no order never form pairs, and no key is hot. At one key and order stand at
most one whole word and, for each place, one word a letter of the alphabet.

A word's nearest are counted and the most frequent kept where they meet, so no
pair is listed. Forms are then followed to their roots by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, stored

#: Runs of letters once A to Z are lower-cased; letters and occurrences that make a word; occurrences by which a form must exceed a word.
_RUN, _GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: Of so many (document, run) pairs one has a letter deleted.
MODULUS = 97
#: Characters of a text taken at a time, and words a task counts before it hands them on.
STEP, HELD = 4 << 20, 300_000
#: The power of a letter's code point.
POWER = 5


def _runs(text: bytes | None) -> Iterator[list[str]]:
    """A text's runs, those of some MB at a time; only A to Z change when bytes are lower-cased."""
    whole, at = (text or b"").lower().decode("utf-8", "replace"), 0
    while at < len(whole):
        gap = _GAP.search(whole, at + STEP)
        end = gap.start() if gap else len(whole)
        yield _RUN.findall(whole, at, end)
        at = end


def _spelt(doc: str, run: str, least: int, modulus: int) -> str:
    """What stands for a run in a document: in one of ``modulus`` cases a letter is missing."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc}:".encode()))
    if h % modulus:
        return run
    at = h % len(run)
    word = run[:at] + run[at + 1 :]
    return word if len(word) >= least else ""


def _counted(least: int, modulus: int):
    """(word, n) of a task's documents, a bounded number of words at a time."""

    def batch(counts: Counter) -> pa.RecordBatch:
        counts.pop("", None)
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in batches:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                for runs in _runs(text.as_py()):
                    for word, n in Counter(runs).items():
                        if len(word) >= least:
                            counts[_spelt(doc, word, least, modulus)] += n
                    if len(counts) > HELD:
                        yield batch(counts)
                        counts = Counter()
        yield batch(counts)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """(word, n) of the words with at least ``least`` letters and ``count`` occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_counted(least, modulus), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def anagram_key(word: str) -> int:
    """The sum of the letters' powers, within 63 bits."""
    return sum(ord(c) ** POWER for c in word) & 0x7FFFFFFFFFFFFFFF


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word at its own key (place -1), and without each of its letters; ``first`` of equal neighbours is the one whose loss counts."""
    for part in batches:
        words, counts = part.column(0).to_pylist(), part.column(1).to_pylist()
        for lo in range(0, len(words), 4096):
            out = []
            for word, n in zip(words[lo : lo + 4096], counts[lo : lo + 4096]):
                key = anagram_key(word)
                out.append((key, word, -1, False, word, n))
                out += [((key - ord(c) ** POWER) & 0x7FFFFFFFFFFFFFFF, word[:k] + word[k + 1 :], k, k == 0 or word[k - 1] != c, word, n) for k, c in enumerate(word)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "rest", "at", "first", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best): of each place where a word meets others, how many those are and the first of them (less n, word)."""
    sent = words.select("word", "n").mapInArrow(_sent, "key long, rest string, at int, first boolean, word string, n long")
    met = sent.groupBy("key", "rest").agg(F.collect_list(F.struct("at", "first", (-F.col("n")).alias("less"), "word")).alias("all")).where(F.size("all") > 1)

    def beside(x):
        near = F.filter("all", lambda y: ((y["at"] == x["at"]) & (y["word"] != x["word"])) | ((x["at"] < 0) & y["first"]) | ((y["at"] < 0) & x["first"]))
        return F.struct(x["word"].alias("word"), F.size(near).cast("long").alias("near"), F.array_min(F.transform(near, lambda y: F.struct(y["less"].alias("less"), y["word"].alias("word")))).alias("best"))

    return met.select(F.explode(F.transform("all", beside)).alias("x")).select("x.*").where("near > 0")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, to) that end somewhere: targets are replaced by their own targets until none has one.

    Each round halves what is left of every chain, and is written.
    """
    now = stored(links.select("word", "to"), "spelling-links")
    while True:
        step = join_unique(now.select("word", "to"), now.select(F.col("word").alias("to"), F.col("to").alias("__to")), ["to"])
        now = stored(step.select("word", F.coalesce("__to", "to").alias("to"), F.col("__to").isNotNull().alias("moved")), "spelling-roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, count: int = LEAST_COUNT, times: int = TIMES, modulus: int = MODULUS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs``.

    ``n_near`` counts the words that differ by one letter more, less or other;
    ``form`` is the most frequent of them (of equals the first in code-point
    order) where it occurs ``times`` as often, else null; ``root`` is where the
    forms end. Null and empty texts have no words; a null id counts as an empty
    one; repeated rows count each time. Very long texts are taken whole, in
    steps. An empty table gives no rows; extra columns aren't read.
    """
    words = stored(word_counts(docs, id_col, text_col, least, count, modulus), "spelling-words")
    none = F.lit(None).cast("struct<less:bigint,word:string>")
    near = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "near", "best").unionByName(words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")))
    one = near.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= F.lit(times) * F.col("n")
    formed = stored(one.select("word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of the whole of ``documents``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# SQL has no CRC-32: the bits of each byte are spelled out. Words meet at what one lost letter leaves.
_BYTES = "list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL),
r AS (SELECT run, n, {_CRC} AS h, length(run) AS k FROM (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM d WHERE length(run) >= {LEAST_LETTERS} GROUP BY doc_id, run)),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {MODULUS} = 0 THEN left(run, (h % k)::INT) || substr(run, (h % k)::INT + 2) ELSE run END AS word, n FROM r)
      WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
g AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.rest = w.word),
b AS (SELECT word, other, n AS form_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL),
e AS (SELECT c.word, arg_max(c.at, f.n) AS root FROM c JOIN f ON c.at = f.word GROUP BY c.word)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN e USING (word)
"""
