"""Reading a corpus: files below a folder, tables of documents, chunk files, questions, splits and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..session import stored

# What is indexed, what is skipped, and the first part of every logical path.
TEXT_SUFFIXES = (".md", ".txt", ".yml", ".yaml", ".sql", ".dax")
CODE_SUFFIXES = (".py", ".java", ".js", ".jsx", ".ts", ".tsx")
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv")
SKIPPED_FILES = ("package-lock.json", ".DS_Store")
PREFIX = "corpus"


def project_of(path: Column) -> Column:
    """The part after the corpus prefix; ``?`` for any other path."""
    parts = F.split(path, "/")
    return F.when((parts[0] == PREFIX) & (F.size(parts) > 1), parts[1]).otherwise(F.lit("?"))


def indexed(parts: Column) -> Column:
    """Whether a relative path, given by its parts, is one that is indexed; looks at names only, before any content is read."""
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return ~skipped & ~name.isin(*SKIPPED_FILES) & suffix.isin(*TEXT_SUFFIXES, *CODE_SUFFIXES)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per indexed file below ``root``: project, path, parts, source, lines, sha256.

    Bytes that aren't UTF-8 and blank files are left out. CRLF and CR become LF
    in ``source``; the digest is of the bytes. Parts order files as path
    components do, which path strings don't.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(base).toUri().getPath().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), "^.*?" + _literal(full) + "/", "")
    files = found.select(F.split(relative, "/").alias("parts"), "content").where(indexed(F.col("parts")))
    source = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    read = files.withColumn("source", source).where(F.col("source").isNotNull() & F.col("source").rlike(r"(?U)[^\s\x1c-\x1f]"))
    path = F.concat_ws("/", F.lit(PREFIX), "parts")
    return read.select(project_of(path).alias("project"), path.alias("path"), "parts", "source", F.size(tx.lines(F.col("source"))).alias("lines"), F.sha2("content", 256).alias("sha256"))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """A table of documents (doc_id, text, source) as files: the source is the project."""
    path = F.concat_ws("/", F.lit(PREFIX), "source", F.col("doc_id").cast("string"))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.col("source").alias("project"), path.alias("path"), F.split(path, "/").alias("parts"), text.alias("source"), F.size(tx.lines(text)).alias("lines"), F.sha2(text, 256).alias("sha256"))


def with_index(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``idx``, its position from 0 in the given order.

    Rows are ranked within ranges of the order, and each range starts where the
    one before it ends; only the ranges' sizes pass through one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = stored(ranged, "ranges")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__start"))
    return ranged.join(F.broadcast(start), "__range").withColumn("idx", F.col("__start") + F.col("__at")).drop("__range", "__at", "__start")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schemas.CHUNK).json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ord, q, relevant, difficulty) of a question file; a missing difficulty is empty. Repeated ids are an error."""
    rows = spark.read.schema(schemas.GOLDEN).option("multiLine", "true").json(path).select(F.posexplode("questions").alias("ord", "x"))
    rows = rows.select(F.col("x.id").alias("qid"), "ord", F.col("x.q").alias("q"), "x.relevant", F.coalesce("x.difficulty", F.lit("")).alias("difficulty"))
    twice = [r["qid"] for r in rows.groupBy("qid").count().where("count > 1").orderBy("qid").limit(20).collect()]
    if twice:
        raise ValueError(f"repeated question ids: {', '.join(twice)}")
    return rows


def qrels(questions: DataFrame) -> DataFrame:
    """(qid, path) of the labelled files, each once."""
    return questions.select("qid", F.explode("relevant").alias("path")).distinct()


def read_split(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """(qid, half) of a split file. An id in both halves, or a split that isn't exactly the questions, is an error."""
    row = spark.read.schema(schemas.SPLIT).option("multiLine", "true").json(path)
    halves = row.select(F.explode("dev").alias("qid"), F.lit("dev").alias("half")).union(row.select(F.explode("test").alias("qid"), F.lit("test").alias("half")))
    both = halves.where("half = 'dev'").select("qid").intersect(halves.where("half = 'test'").select("qid")).limit(20).collect()
    if both:
        raise ValueError(f"questions in both halves: {', '.join(r['qid'] for r in both)}")
    ids, known = halves.select("qid").distinct(), questions.select("qid")
    odd = ids.exceptAll(known).union(known.exceptAll(ids)).limit(20).collect()
    if odd:
        raise ValueError(f"split and questions differ in: {', '.join(r['qid'] for r in odd)}")
    return halves


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, projects) of a manifest file."""
    row = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path)
    files = row.select(F.explode("files").alias("f")).select("f.*")
    return files, row.select(F.explode("projects").alias("project", "p")).select("project", "p.*")
