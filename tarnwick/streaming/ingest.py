"""Keeping a chunk store up to date from a stream of files or documents (beyond what the batch engine needs).

Each micro-batch chunks what arrived and replaces those files' chunks in its own
batch folder; readers take the newest batch of a path. A batch that is repeated
after a failure writes its folder again, so no chunk is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.providers import BUDGET, TokenCounter, count_words
from ..operators import chunking as ch
from ..sources import corpus

DOCUMENTS = "doc_id bigint, text string, source string"


def stream_documents(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Documents (doc_id, text, source) from JSON files that land in ``folder``, as files of a corpus."""
    landed = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", per_batch).json(folder)
    return corpus.documents_as_files(landed)


def maintain(files: DataFrame, store: str, checkpoint: str, chunking: str = "window", count: TokenCounter = count_words, budget: int = BUDGET, **trigger) -> StreamingQuery:
    """Start keeping ``store`` up to date; ``trigger`` as for ``DataStreamWriter.trigger``, by default all that is there, once."""

    def upsert(batch: DataFrame, n: int) -> None:
        # of a path that comes twice in a batch, one version is kept: the one with the largest digest
        latest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("sha256")))
        once = batch.withColumn("__n", latest).where("__n = 1")
        ch.build_chunks(once, chunking, count, budget).write.mode("overwrite").parquet(f"{store}/batch={n}")

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of the newest version of each path."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"]).drop("batch")
