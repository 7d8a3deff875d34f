"""A corpus pipeline: quality, exact dedup, near-dedup, mixing and tokenisation, one after the other.

Each stage reads what its predecessor kept; ``run`` writes every stage's rows
to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import bpe, exact_dedup, mixing, quality, simhash
from tarnwick.llm.common import stored, with_row_id


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps; those it rejects go.

    Rows with one id share a decision: they stay if one of them is kept, and so
    do rows with a null id. A null or empty text has weight 0. An empty table
    stays empty; extra columns are passed on.
    """
    judged = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = judged.where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def _one_each(docs: DataFrame, grouped) -> DataFrame:
    """One row of ``docs`` for each group of ``grouped(rows)``, which takes rows (doc_id, text) and gives (doc_id, group).

    The ids it sees are row keys, so rows that share an id, or have none, each
    count by their text. Of a group the row with the smallest id stays, null
    ids last; of rows with one id any.
    """
    keyed = with_row_id(docs)
    groups = grouped(keyed.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))).toDF("row", "group")
    place = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row")
    kept = keyed.select("row", place.alias("place")).join(groups, "row").groupBy("group").agg(F.min("place")["row"].alias("row"))
    return keyed.join(kept, "row", "left_semi").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Null texts count as empty, and empty texts are one group. Rows with null
    or shared ids lose no text; repeated rows become one. Of a group the
    smallest id stays. An empty table stays empty; extra columns are passed on.
    """
    return _one_each(docs, lambda rows: exact_dedup.exact_dedup(rows).select("doc_id", "keep_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints.

    Texts without words have fingerprint zero and link like any other. Rows
    with null or shared ids lose no group; repeated rows become one. Of a group
    the smallest id stays. An empty table stays empty; extra columns are passed on.
    """
    return _one_each(docs, lambda rows: simhash.simhash_dedup(rows).select("doc_id", "component_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them.

    Null or empty texts have no words and go. A null source is a source of its
    own; repeated rows and null ids are documents of their own. An empty table
    stays empty; extra columns are passed on.
    """
    return mixing.apply_mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the tokens of each row, and of the text they decode to.

    A null text counts as empty and has no tokens; every row, repeated or
    without an id, has its own. An empty table gives no rows; extra columns aren't read.
    """
    return bpe.bpe_digests(docs, bpe.default_path())


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: SQL can't express the stages; tests/llm hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
