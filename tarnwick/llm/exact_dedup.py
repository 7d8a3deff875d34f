"""Exact dedup over an extendible-hash index kept on shared files.

1. Every row's normalised text gets a SHA-256; the first bits are its index
   key. Rows of (id, key, digest), without texts, are written to the shared
   folder.
2. The directory starts with one bucket. While a bucket has more distinct keys
   than fit, it splits on its next bit; when its local depth equals the global
   depth, the directory doubles first. Only the key counts of at most
   ``2**max_depth`` prefixes reach the driver, whatever the input; beyond that
   many keys buckets hold more, so that they still fit.
3. Each map task combines its equal texts before the shuffle, so a hot text
   sends a few rows a task rather than one a copy. Owner tasks get ranges of
   the directory's buckets (consecutive buckets are consecutive keys), sorted by key, chain the texts of equal keys and
   compare their bytes, and write their buckets to shared files.
4. Rows look up their bucket in the directory, and there their key and digest.
   Groups with more than one in ``HOT_GROUPS`` of all rows are looked up by
   broadcast, of which there can't be more than that; no task gets them whole.
   Where different texts share a digest, rows are told apart by their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Same result as replacing every run, but single spaces stay untouched.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_KEY_BITS = 60
#: Groups that are looked up by broadcast at most; bytes of text for an owner task.
HOT_GROUPS, OWNER_BYTES = 2000, 64 << 20
_COMBINED = "key long, sha string, text binary, least long, n long"
_CHAINED = "bucket int, key long, chain int, sha string, keep_id long, group_size long, text binary"


def normalised(text) -> F.Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


class Directory:
    """An extendible-hash directory: ``slots[prefix]`` is the bucket of a key whose first ``depth`` bits are ``prefix``.

    A bucket of local depth d holds the keys with its first d bits, ``prefix``, so its slots stand side by side.
    """

    def __init__(self) -> None:
        self.depth, self.slots, self.local, self.prefix = 0, [0], [0], [0]

    def double(self) -> None:
        """One bit more for every slot."""
        self.slots = [b for b in self.slots for _ in (0, 1)]
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Split a bucket on its next bit, doubling the directory if it must: the new bucket takes the keys with a 1 there."""
        if self.local[bucket] == self.depth:
            self.double()
        self.local[bucket] += 1
        self.prefix[bucket] *= 2
        new = len(self.local)
        self.local.append(self.local[bucket])
        self.prefix.append(self.prefix[bucket] + 1)
        width = 1 << (self.depth - self.local[new])
        self.slots[self.prefix[new] * width : (self.prefix[new] + 1) * width] = [new] * width
        return new

    def fit(self, counts: dict[int, int], bits: int, capacity: int) -> Directory:
        """Split every bucket of more than ``capacity`` keys, down to ``bits`` bits; ``counts``: keys by prefix of ``bits`` bits."""
        below = [0] * ((1 << bits) + 1)
        for k in range(1 << bits):
            below[k + 1] = below[k] + counts.get(k, 0)

        def full(bucket: int) -> bool:
            d = self.local[bucket]
            lo, hi = self.prefix[bucket] << (bits - d), (self.prefix[bucket] + 1) << (bits - d)
            return d < bits and below[hi] - below[lo] > capacity

        todo = list(range(len(self.local)))
        while todo:
            if full(bucket := todo.pop()):
                todo += [bucket, self.split(bucket)]
        return self

    def in_order(self) -> list[tuple[int, int, int]]:
        """(slot, bucket, rank of the bucket by its keys)."""
        rank: dict[int, int] = {}
        return [(slot, b, rank.setdefault(b, len(rank))) for slot, b in enumerate(self.slots)]


def _combine(flush_bytes: int):
    """A map-side combiner: one row per distinct text for each ``flush_bytes`` of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            cols = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [k[2] for k, _ in rows], [v[0] for _, v in rows], [v[1] for _, v in rows]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["key", "sha", "text", "least", "n"])

        for batch in batches:
            for i, key, sha, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (row := held.get((key, sha, text))) is None:
                    held[key, sha, text] = [i, 1]
                    size += len(text)
                else:
                    row[1] += 1
                    if i is not None and (row[0] is None or i < row[0]):
                        row[0] = i
                if size > flush_bytes:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner task: its rows come sorted by bucket and key; equal keys are chained, equal bytes merged."""
    names = ["bucket", "key", "chain", "sha", "keep_id", "group_size", "text"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    at, chain, done = None, [], []

    def close() -> None:
        digests = [link[1] for link in chain]
        # a text stays only where its digest is another's too
        done.extend((at[0], at[1], k, sha, keep, n, text if digests.count(sha) > 1 else None) for k, (text, sha, keep, n) in enumerate(chain))

    for batch in batches:
        for bucket, key, sha, text, least, n in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (bucket, key):
                close()
                at, chain = (bucket, key), []
            for link in chain:
                if link[0] == text:
                    link[3] += n
                    if least is not None and (link[2] is None or least < link[2]):
                        link[2] = least
                    break
            else:
                chain.append([text, sha, least, n])
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1_000, max_depth: int = 18, key_bits: int = _KEY_BITS, flush_bytes: int = 32 << 20, digest=lambda norm: F.sha2(norm, 256)) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    A null text counts as empty, and empty texts are one group. Of equal texts
    the smallest id is kept; null ids are never smallest (a group of null ids
    alone has a null keep_id and keeps nothing). Repeated rows with one id and
    one text all count, and are kept or dropped together. An empty table gives
    no rows; other columns, whatever their names, aren't read. For tests:
    ``key_bits`` below 60 makes keys collide, and ``digest`` (of at least 15
    hexadecimal digits) takes the place of SHA-256.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm")).select(
        "id", F.encode("norm", "UTF-8").alias("text"), digest(F.col("norm")).alias("sha")
    )
    keyed = keyed.withColumn("key", F.shiftright(F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"), 60 - key_bits))
    entries = stored(keyed.select("id", "key", "sha", F.octet_length("text").cast("long").alias("bytes")), "dedup-entries")

    n_keys, n_rows, n_bytes = entries.agg(F.approx_count_distinct("key"), F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    capacity = max(capacity, n_keys >> (max_depth - 2))
    bits = min(max_depth, key_bits, max(1, math.ceil(math.log2(max(1, n_keys) / capacity + 1)) + 2))
    prefix = F.shiftright("key", key_bits - bits).cast("int")
    counts = entries.select("key").distinct().groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    directory = Directory().fit({r["p"]: r["n"] for r in counts}, bits, capacity)
    slots = F.broadcast(spark.createDataFrame(directory.in_order(), "slot int, bucket int, rank long"))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with the bucket that the directory has for their key."""
        return rows.withColumn("slot", F.shiftright("key", key_bits - directory.depth).cast("int")).join(slots, "slot")

    combined = keyed.select("id", "key", "sha", "text").mapInArrow(_combine(flush_bytes), _COMBINED)
    buckets = len(directory.local)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / OWNER_BYTES))
    owned = (
        placed(combined)
        .repartitionById(owners, F.floor(F.col("rank") * owners / buckets).cast("int"))
        .sortWithinPartitions("rank", "key", "sha")
        .select("bucket", "key", "sha", "text", "least", "n")
    )
    index = stored(owned.mapInArrow(_own, _CHAINED), "dedup-index")

    asked, at = placed(entries).select("id", "bucket", "key", "sha"), ["bucket", "key", "sha"]
    known = index.where("text IS NULL").drop("text")
    many = F.col("group_size") > n_rows // HOT_GROUPS
    hot, rest = F.broadcast(known.where(many)), known.where(~many)
    found = asked.join(hot, at).unionByName(asked.join(hot.select(*at), at, "left_anti").join(rest, at))
    if (doubled := index.where("text IS NOT NULL")).limit(1).count():
        found = found.unionByName(placed(keyed).join(doubled, [*at, "text"]).select(*found.columns))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
