"""The engine's registered queries and their DuckDB counterparts.

The tables stand in for a corpus: a document is a file of the project that is
its source, a benchmark passage (every third word of it) is a question, and the
documents that hold the passage are its labels. In embeddings the label plays
the part of the file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter
from ..functions import providers as pv
from ..functions import statistics as st
from ..functions import text as tx
from ..operators import chunking as ch
from ..operators import evaluation as ev
from ..operators import labels as lb
from ..operators import retrieval as rt
from ..operators import sections as sc
from ..operators import windows as wn
from ..session import kept, spread, stored
from ..sources import corpus, manifest
from . import oracle as sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query, with its SQL where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _files(spark, sf_dir):
    return corpus.documents_as_files(_table(spark, sf_dir, "documents"))


def _chunks(spark, sf_dir):
    """Documents as chunks: idx, path, name, text."""
    return _files(spark, sf_dir).select(F.col("doc_id").alias("idx"), "path", F.col("project").alias("name"), F.col("source").alias("text"))


def _questions(spark, sf_dir):
    third = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 3 == 0), " ")
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), third.alias("q"))


def _stamp(spark, sf_dir) -> str:
    """What tells one state of the tables that the stored indexes are made of from another: size and time of each table's file or folder.

    Where the store keeps no times for folders, nothing is shared between sessions.
    """
    jvm, at = spark._jvm, spark._jsc.hadoopConfiguration()
    stamps = [sf_dir]
    for table in ("documents", "benchmark"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        status = path.getFileSystem(at).getFileStatus(path)
        stamps.append(f"{status.getLen()}:{status.getModificationTime() or spark.sparkContext.applicationId}")
    return hashlib.sha256("|".join(stamps).encode()).hexdigest()[:16]


def _kept(spark, sf_dir, **tables: Callable[[], DataFrame]) -> list[DataFrame]:
    """Tables that several queries read: found in the shared folder, or made and written there."""
    stamp = _stamp(spark, sf_dir)
    return [kept(spark, f"{name}-{stamp}", make) for name, make in tables.items()]


def _qrels(spark, sf_dir):
    return _kept(spark, sf_dir, qrels=lambda: _labels(spark, sf_dir))[0]


def _labels(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held = lb.containment(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _table(spark, sf_dir, "benchmark"))
    paths = corpus.documents_as_files(docs).select("doc_id", "path")
    return held.join(paths, "doc_id").select(F.col("item_id").alias("qid"), "path")


def _lexical(spark, sf_dir):
    (counts,) = _kept(spark, sf_dir, counts=lambda: rt.Lexical.count(_chunks(spark, sf_dir), stem=False))
    index = rt.Lexical.of_counts(counts)
    index.terms, index.averages = _kept(spark, sf_dir, weights=lambda: index.terms, averages=lambda: index.averages)
    return index


def _bm25(spark, sf_dir, k):
    def ranked():
        return rt.bm25_rank(_lexical(spark, sf_dir), _questions(spark, sf_dir), rt.FUSION_DEPTH, stem=False, digits=6)

    return _kept(spark, sf_dir, bm25=ranked)[0].where(F.col("rank") <= k)


def _dense(spark, sf_dir, k):
    def ranked():
        vectors = pv.hashing_vectors(_chunks(spark, sf_dir), "idx", "text")
        return rt.dense_rank(vectors, pv.hashing_vectors(_questions(spark, sf_dir), "qid", "q"), rt.FUSION_DEPTH, digits=6)

    return _kept(spark, sf_dir, dense=ranked)[0].where(F.col("rank") <= k)


def _lists(spark, sf_dir):
    """(key, qid, path, rank): the first ten of every strategy that needs no model."""
    paths = _chunks(spark, sf_dir).select("idx", "path")
    bm25, dense = _bm25(spark, sf_dir, rt.FUSION_DEPTH), _dense(spark, sf_dir, rt.FUSION_DEPTH)
    fused = stored(rt.fuse([bm25, dense], rt.CAP_DEPTH).join(paths, "idx"), "fused")
    capped = rt.cap(fused.withColumn("project", corpus.project_of(F.col("path"))), path="project", k=ev.DEPTH)
    named = {"bm25": bm25.join(paths, "idx"), "dense": dense.join(paths, "idx"), "hybrid": fused, "hybrid+cap": capped}
    out = None
    for key, one in named.items():
        one = one.where(F.col("rank") <= ev.DEPTH).select(F.lit(key).alias("key"), "qid", "path", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _metrics(spark, sf_dir):
    def scored():
        return ev.question_metrics(stored(_lists(spark, sf_dir), "lists"), _qrels(spark, sf_dir), _questions(spark, sf_dir), ("key",))

    return _kept(spark, sf_dir, metrics=scored)[0]


def _six(df: DataFrame, *skip: str) -> DataFrame:
    return df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`") for c, t in df.dtypes))


# ---------------------------------------------------------------- sources


@query(sql.CORPUS_INVENTORY)
def corpus_inventory(spark, sf_dir):
    """Files and lines of each project and of all."""
    return manifest.project_totals(_files(spark, sf_dir))


@query(sql.FILE_ENTRIES)
def file_entries(spark, sf_dir):
    """Path, project, lines and digest of each file."""
    return _files(spark, sf_dir).select("path", corpus.project_of(F.col("path")).alias("project"), "lines", "sha256")


@query(sql.MANIFEST_DIFF)
def manifest_diff(spark, sf_dir):
    """How a corpus that has lost its Spanish files, gained its French ones, and changed in two projects differs from its manifest."""
    files = _files(spark, sf_dir).select("doc_id", "project", "path", "lines", "sha256").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    expected = files.where("lang is distinct from 'fr'").drop("doc_id", "lang")
    changed = F.when(F.col("project") == "src3", F.lit("changed")).otherwise(F.col("sha256"))
    longer = F.when(F.col("project") == "src5", F.col("lines") + 1).otherwise(F.col("lines"))
    actual = files.where("lang is distinct from 'es'").withColumn("sha256", changed).withColumn("lines", longer).drop("doc_id", "lang")
    return manifest.differences(expected, actual)


@query(sql.LINE_TABLE)
def line_table(spark, sf_dir):
    """Each document's lines, those with letters or digits, and the first and last of them."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", tx.lines(F.coalesce("text", F.lit(""))).alias("l"))
    worded = F.array_compact(F.transform("l", lambda x, i: F.when(x.rlike(tx.ALNUM), i + 1)))
    return rows.select("doc_id", F.size("l").alias("n_lines"), worded.alias("w")).select("doc_id", "n_lines", F.size("w").alias("n_worded"), F.array_min("w").alias("first"), F.array_max("w").alias("last"))


@query(sql.LABELS)
def containment_labels(spark, sf_dir):
    """Which documents hold which passages."""
    return lb.containment(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# ---------------------------------------------------------------- text


@query(sql.TOKENS_TOPK)
def tokens_topk(spark, sf_dir):
    """The fifty most frequent search words."""
    words = _table(spark, sf_dir, "documents").select(F.explode(tx.words(F.coalesce("text", F.lit("")))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query(sql.IDENTIFIER_PARTS)
def identifier_parts(spark, sf_dir):
    """Parts of all distinct tokens of the documents, and of identifiers of every shape that name them."""
    docs = _table(spark, sf_dir, "documents")
    named = F.array(*(F.format_string(f, F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("x")), F.col("doc_id")) for f in sql.IDENTIFIERS))
    found = docs.select(F.explode(F.concat(tx.tokens(F.coalesce("text", F.lit(""))), named)).alias("token")).distinct()
    return found.select("token", F.array_join(tx.identifier_parts(F.col("token")), ",").alias("parts"))


@query()
def stem_terms(spark, sf_dir):
    """Stems of the distinct search words, and how many words share each."""
    words = _table(spark, sf_dir, "documents").select(F.explode(tx.words(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    return words.select(porter.stem_udf("term").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n_terms"))


@query(sql.DERIVED_SEEDS)
def derived_seeds(spark, sf_dir):
    """The seeds of labels made of each source and language."""
    labels = _table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.lit("mrr")).alias("label")).distinct()
    return labels.select("label", st.derived_seed_column(st.SEED, F.col("label")).alias("seed"))


# ---------------------------------------------------------------- chunks


def _window_rows(spark, sf_dir):
    """(project, path, start_line, end_line) of the documents' windows, pieces of lines beyond the budget among them."""
    files = _files(spark, sf_dir).withColumn("parts", F.split("path", "/"))
    return stored(wn.window_bounds(files, budget=254), "windows")


@query(sql.WINDOW_CHUNKS)
def window_chunks(spark, sf_dir):
    """Windows of the documents, pieces of lines beyond the budget among them: their number and bounds."""
    rows = _window_rows(spark, sf_dir)
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_windows"), F.min("start_line").alias("first"), F.max("end_line").alias("last"))


@query(sql.MERGED)
def merge_chunks(spark, sf_dir):
    """Documents as Markdown, a heading before each line, merged within the budget."""
    files = _files(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".md"))).withColumn("source", F.regexp_replace("source", "(?m)^", "# part\n"))
    chunks = ch.build_chunks(files.withColumn("parts", F.split("path", "/")), "structural_merged", budget=254)
    return chunks.select("chunk_id", "kind", "start_line", "end_line", F.length("text").alias("n_chars"))


@query(sql.MARKDOWN_SECTIONS)
def markdown_sections(spark, sf_dir):
    """Sections of the documents as Markdown: an opening line, then each line under a heading whose level and title follow from it."""
    heading = lambda x, i: F.concat(F.repeat(F.lit("#"), F.length(x) % 6 + 1), F.format_string(" h%d\n> ", i % 9), x)
    files = _files(spark, sf_dir).select("path", F.array_join(F.concat(F.array(F.lit("intro")), F.transform(tx.lines(F.col("source")), heading)), "\n").alias("source"))
    return sc.heading_sections(files)


def _rendered(spark, sf_dir):
    """Python and Java sources that say of each document what lines it has: a class with a method a line, comments and nested types; every seventh doesn't parse."""
    docs = _files(spark, sf_dir).select("doc_id", F.transform(tx.lines(F.col("source")), lambda x: F.length(x)).alias("l"))
    joined = lambda f: F.array_join(F.transform("l", f), "")
    broken = F.col("doc_id") % 7 == 0
    python = F.concat(
        F.format_string("import re\n\n\n# about %d\nclass D%d:\n    size = %d\n", F.col("doc_id"), F.col("doc_id"), F.size("l")),
        joined(lambda x, i: F.format_string("\n    # line %d\n    def m%d(self):\n        return %d\n", i, i, x)),
        F.format_string("\n\n@traced\nasync def f%d(x):\n    def inner():\n        return x\n    return inner\n", F.col("doc_id")),
        F.when(broken, "\n\nx = (1,\n").otherwise(""),
    )
    java = F.concat(
        F.format_string("package demo;\n\n/** About %d. */\npublic class D%d {\n    int size = %d;\n", F.col("doc_id"), F.col("doc_id"), F.size("l")),
        joined(lambda x, i: F.format_string("\n    // line %d\n    public int m%d() {\n        return %d;\n    }\n", i, i, x)),
        F.lit("\n    enum Kind { ONE, TWO }\n"),
        F.when(broken, "").otherwise("}\n"),
    )
    files = [docs.select(F.format_string(f"corpus/demo/D%d.{suffix}", F.col("doc_id")).alias("path"), source.alias("source")) for suffix, source in (("py", python), ("java", java))]
    return files[0].unionByName(files[1]).select("path", F.lit("demo").alias("project"), F.split("path", "/").alias("parts"), "source")


@query(sql.CODE_UNITS)
def code_units(spark, sf_dir):
    """Declarations of sources rendered from the documents, broken ones among them."""
    return ch.build_chunks(spread(_rendered(spark, sf_dir)), "structural", budget=1_000_000).select("path", "name", "kind", "start_line", "end_line")


@query(sql.PAYLOADS)
def payload_tokens(spark, sf_dir):
    """Tokens of what an encoder reads of the documents' windows: chunks of each project, the largest, and how many exceed the budget."""
    files = _files(spark, sf_dir).withColumn("parts", F.split("path", "/"))
    sized = wn.counted(wn.window_chunks(files, budget=254), ch.payload(), wn.count_words, "tokens")
    return sized.groupBy("project").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("tokens").alias("max_tokens"), F.sum("tokens").alias("tokens"), F.sum((F.col("tokens") > 254).cast("long")).alias("over"))


@query(sql.CHUNK_SIZES)
def chunk_size_summary(spark, sf_dir):
    """Sizes of the documents' windows, by project."""
    return ch.size_summary(_window_rows(spark, sf_dir), "project")


@query(sql.CHUNK_IDS)
def chunk_id_dedupe(spark, sf_dir):
    """Ids of documents by project and language, repeats numbered."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.concat_ws("::", "source", "lang").alias("chunk_id"))
    return ch.unique_ids(rows, order="doc_id").select("doc_id", "chunk_id")


# ---------------------------------------------------------------- retrieval


@query(sql.BM25_TERMS)
def bm25_terms(spark, sf_dir):
    """Weights of all terms."""
    return _lexical(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(sql.BM25_TOPK)
def bm25_topk(spark, sf_dir):
    """The ten best documents for each question by BM25."""
    return _bm25(spark, sf_dir, 10).select("qid", "idx", "score", "rank")


@query(sql.BM25_BOUNDED)
def bm25_bounded(spark, sf_dir):
    """The ten best documents with a hit for each question, from blocks of postings: those whose bounds stay below a question's threshold are skipped."""
    best, _ = rt.Blocks.build(_lexical(spark, sf_dir)).top(_questions(spark, sf_dir), 10, stem=False, digits=6)
    return best


@query(sql.BM25_FILLERS)
def bm25_fillers(spark, sf_dir):
    """Lists that chunks without a hit fill up, by position: a question of one rare word for each document that has one, one of a frequent word, and one of no word at all."""
    index = _lexical(spark, sf_dir)
    plain = "term RLIKE '^[a-z]+$'"
    # the least, the largest and the XOR of at most three positions tell them all, so that no posting is dealt
    ends = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.bit_xor("idx").alias("all")).where(f"df <= 3 AND {plain}")
    third = F.when(F.col("df") == 3, F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(F.col("all"))).otherwise(F.col("lo"))
    rare = ends.select("term", F.explode(F.array_distinct(F.array("lo", "hi", third))).alias("qid")).groupBy("qid").agg(F.min("term").alias("q"))
    often = index.terms.where(plain).agg(F.min_by("term", F.struct(-F.col("df"), "term")).alias("q")).select(F.lit(-1).cast("long").alias("qid"), "q")
    none = often.select(F.lit(-2).cast("long").alias("qid"), F.lit("???").alias("q"))
    asked = stored(rare.unionByName(often).unionByName(none), "asked")
    return rt.bm25_rank(index, asked, 10, stem=False, digits=6).select("qid", "idx", "rank")


@query(sql.HASH_EMBED)
def hash_embed(spark, sf_dir):
    """Hashed word vectors of the documents: their largest components."""
    v = pv.hashing_vectors(_chunks(spark, sf_dir), "idx", "text")
    best = F.array_max("vector")
    return v.select("idx", F.round(best, 6).alias("largest"), (F.array_position("vector", best) - 1).alias("bucket"), F.size(F.filter("vector", lambda x: x > 0)).alias("filled"))


@query(sql.DENSE_TOPK)
def dense_topk(spark, sf_dir):
    """The ten nearest vectors of each vector whose id is divisible by 50."""
    e = _table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return rt.dense_rank(vectors, vectors.where("idx % 50 = 0").withColumnRenamed("idx", "qid"), 10, digits=6).select("qid", "idx", "score", "rank")


@query(sql.RRF_FUSION)
def rrf_fusion(spark, sf_dir):
    """The twenty best documents for each question, BM25 and hashed vectors fused."""
    return rt.fuse([_bm25(spark, sf_dir, 60), _dense(spark, sf_dir, 60)], 20).select("qid", "idx", "rank")


@query(sql.FILE_CAP)
def file_cap(spark, sf_dir):
    """Nearest vectors with at most two of a label before the others."""
    e = _table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    near = rt.dense_rank(vectors, vectors.where("idx % 50 = 0").withColumnRenamed("idx", "qid"), rt.CAP_DEPTH, digits=6)
    return rt.cap(near.join(e.select(F.col("vec_id").alias("idx"), "label"), "idx"), path="label", per_file=2, k=10).select("qid", "idx", "label", "rank")


@query(sql.RERANK_OVERLAP)
def rerank_overlap(spark, sf_dir):
    """The thirty best by BM25, ordered by the words they share with the question."""
    return rt.rerank(_bm25(spark, sf_dir, rt.RERANK_DEPTH), _questions(spark, sf_dir), _chunks(spark, sf_dir), pv.OverlapReranker(), 10).select("qid", "idx", "score", "rank")


def _searched(index, questions, vectors):
    """(strategy, qid, idx, rank) of all six strategies."""
    asked, out = stored(questions.join(vectors, "qid"), "asked"), None
    for s in rt.STRATEGIES:
        one = stored(index.search(asked, s).select(F.lit(s).alias("strategy"), "qid", "idx", "rank"), "found")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def search_strategies(spark, sf_dir):
    """All six strategies, stemmed, with the offline providers."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    index = rt.Index(chunks, rt.Lexical.build(chunks).stored(), stored(pv.embed(chunks, pv.HashingEmbedder(), "text", "idx"), "vectors"), pv.OverlapReranker())
    return _searched(index, questions, pv.embed(questions, pv.HashingEmbedder(), "q", "qid"))


@query(sql.SEARCHED)
def search_unstemmed(spark, sf_dir):
    """All six strategies, without stems; a document's file is its project, so that the cap and the prefix have something to do."""
    chunks, questions = _chunks(spark, sf_dir).withColumn("path", F.col("name")), _questions(spark, sf_dir)
    index = rt.Index(chunks, _lexical(spark, sf_dir), stored(pv.hashing_vectors(chunks, "idx", "text"), "vectors"), pv.OverlapReranker(), stem=False, digits=6)
    return _searched(index, questions, pv.hashing_vectors(questions, "qid", "q"))


@query(sql.STEMMED_TERMS)
def stemmed_terms(spark, sf_dir):
    """Terms of questions of words whose stems are published: each document asks for as many of those as it has lines, from a place of its own."""
    lines = tx.lines(F.coalesce("text", F.lit("")))
    word = F.element_at(F.array(*(F.lit(w) for w in sql.STEM_WORDS)), (F.pmod(F.col("doc_id") * 31 + F.col("i") * 7, F.lit(len(sql.STEM_WORDS))) + 1).cast("int"))
    asked = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "line")).select("doc_id", "i", word.alias("w"))
    questions = asked.groupBy(F.col("doc_id").alias("qid")).agg(F.array_join(F.collect_list("w"), " ").alias("q"))
    return rt.query_terms(questions)


# ---------------------------------------------------------------- evaluation


@query(sql.BM25_QUALITY)
def bm25_quality(spark, sf_dir):
    """Mean metrics of BM25 over the labelled questions."""
    rels = _qrels(spark, sf_dir)
    ranked = _bm25(spark, sf_dir, ev.DEPTH).join(_chunks(spark, sf_dir).select("idx", "path"), "idx")
    rows = ev.question_metrics(ranked, rels, rels.select("qid").distinct())
    return _six(rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"`{m}`").alias(m.replace("@", "_at_")) for m in ("hit_rate@1", "hit_rate@5", "recall@5", "mrr", "ndcg@10"))))


@query(sql.QUESTION_METRICS)
def question_metrics(spark, sf_dir):
    """The ten metrics of each question and strategy."""
    rows = _metrics(spark, sf_dir)
    return _six(rows.select(*(F.col(f"`{c}`").alias(c.replace("@", "_at_")) for c in rows.columns)))


@query(sql.LEADERBOARD)
def strategy_leaderboard(spark, sf_dir):
    """Mean metrics of each strategy."""
    rows = ev.long_form(_metrics(spark, sf_dir), ("key",))
    return _six(rows.groupBy("key", "metric").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))


def _long(spark, sf_dir):
    rows = ev.long_form(_metrics(spark, sf_dir), ("key",))
    return stored(rows.withColumn("ord", F.col("qid")), "values")


def _pairs(spark):
    return spark.createDataFrame([(label, a, b, m) for label, a, b, ms in sql.PAIRS for m in ms], "label string, a string, b string, metric string")


@query(sql.PAIRED)
def paired_comparison(spark, sf_dir):
    """Strategies compared question by question, with the exact sign test."""
    return _six(ev.paired(_long(spark, sf_dir), _pairs(spark)))


@query(sql.PAIRED_INTERVALS)
def paired_intervals(spark, sf_dir):
    """Intervals of the strategies' differences, from values as they are stored, and whether they hold 0; draws that any engine can repeat."""
    rows = ev.long_form(ev.stored_values(_metrics(spark, sf_dir)), ("key",)).withColumn("ord", F.col("qid"))
    diffs = ev.paired_differences(stored(rows, "values"), _pairs(spark))
    # means of values with four places have ties at six
    spans = ev.bootstrap_hash(diffs, ("label", "a", "b", "metric")).select("label", "a", "b", "metric", *(F.round(c, 9).alias(c) for c in ("value", "low", "high")))
    return spans.withColumn("within_noise", (F.col("low") <= 0) & (F.col("high") >= 0))


@query()
def paired_intervals_numpy(spark, sf_dir):
    """The same intervals with the published draws and 10,000 resamples."""
    rows = ev.long_form(ev.stored_values(_metrics(spark, sf_dir)), ("key",)).withColumn("ord", F.col("qid"))
    diffs = ev.paired_differences(stored(rows, "values"), _pairs(spark))
    return ev.with_intervals(diffs, ("a", "b", "metric"), sep="|").withColumn("within_noise", (F.col("low") <= 0) & (F.col("high") >= 0))


@query(sql.STORED_METRICS)
def stored_metrics(spark, sf_dir):
    """The metrics of each question and strategy as they are stored: four places, exact ties to even."""
    rows = ev.stored_values(_metrics(spark, sf_dir))
    return rows.select(*(F.col(f"`{c}`").alias(c.replace("@", "_at_")) for c in rows.columns))


@query(sql.SIGN_TEST)
def sign_test(spark, sf_dir):
    """The sign test of each source and language: documents that are good and not toxic against those that are toxic and not good, and the same after the first hundred ids."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    counts = rows.groupBy("source", "lang").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("better"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("worse"))
    return counts.select("source", "lang", "better", "worse", F.round(st.sign_test_column(F.col("better"), F.col("worse")), 9).alias("p"))


@query(sql.BOOTSTRAP_HASH)
def bootstrap_hash(spark, sf_dir):
    """Bootstrap intervals with draws that any engine can repeat, of quality labels by language; as many resamples as the published intervals have."""
    values = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("doc_id").alias("ord"), F.col("quality").cast("double").alias("value"))
    return _six(ev.bootstrap_hash(values, ("lang",), resamples=st.RESAMPLES))


@query()
def bootstrap_numpy(spark, sf_dir):
    """Bootstrap intervals of every strategy and metric, with the published draws."""
    return ev.with_intervals(_long(spark, sf_dir))


@query(sql.CAP_SELECTION)
def cap_selection(spark, sf_dir):
    """The caps' metrics on both halves, and the one chosen on the first."""
    questions = _questions(spark, sf_dir)
    halves = questions.select("qid", F.when(F.col("qid") % 2 == 0, "dev").otherwise("test").alias("half"))
    paths = _chunks(spark, sf_dir).select("idx", "path", F.col("name").alias("project"))
    fused = rt.fuse([_bm25(spark, sf_dir, 60), _dense(spark, sf_dir, 60)], rt.CAP_DEPTH).join(paths, "idx")
    fused, lists = stored(fused, "fused"), None
    for c in ev.CAPS:
        one = (fused if c is None else rt.cap(fused, path="project", per_file=c)).where(F.col("rank") <= ev.DEPTH).select(F.lit(c or 0).alias("cap"), "qid", "path", "rank")
        lists = one if lists is None else lists.unionByName(one)
    metrics = ev.question_metrics(stored(lists, "lists"), _qrels(spark, sf_dir), questions, ("cap",)).withColumn("per_file", F.when(F.col("cap") > 0, F.col("cap")))
    rows = ev.choose_cap(metrics, halves)
    return _six(rows.select("per_file", "half", "mrr", F.col("`hit_rate@5`").alias("hit_rate_at_5"), F.col("`recall@5`").alias("recall_at_5"), "chosen"))


@query(sql.FAILURE_SHARES)
def failure_shares(spark, sf_dir):
    """Shares of the first five results from documentation (documents whose id ends in 0, 1 or 2) and from other projects, on hits and misses."""
    return _six(ev.failure_summary(_shares(spark, sf_dir)))


def _shares(spark, sf_dir):
    lists, rels = (df.withColumn("path", F.when(F.col("path").rlike("[0-2]$"), F.concat("path", F.lit(".md"))).otherwise(F.col("path"))) for df in (stored(_lists(spark, sf_dir), "lists"), _qrels(spark, sf_dir)))
    return ev.failure_shares(lists, rels, _questions(spark, sf_dir))


@query(sql.FAILURE_DIFFERENCES)
def failure_differences(spark, sf_dir):
    """Intervals of the shares on misses less those on hits, with draws that any engine can repeat."""
    values = _shares(spark, sf_dir).withColumn("ord", F.col("qid")).unpivot(["key", "ord", "hit"], ["doc_share", "wrong_project_share"], "name", "value")
    return _six(ev.difference_hash(values, ("key", "name"), "hit"))


@query()
def failure_differences_numpy(spark, sf_dir):
    """The same intervals with the published draws, both sides from one stream."""
    return ev.difference_intervals(_shares(spark, sf_dir).withColumn("ord", F.col("qid")))


@query(sql.ADJUDICATION)
def adjudication(spark, sf_dir):
    """Agreement of two labellers before and after decisions, from a log that is made of the labels: one changes some answers later, and two of three disagreements are decided."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    entry = lambda who, said, seq, where: rows.where(where).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("path"), F.lit(who).alias("who"), said.alias("relevant"), F.lit(None).cast("string").alias("reason"), (F.col("doc_id") + seq).alias("seq"))
    log = entry("a", good, 0, "true").unionByName(entry("b", clean, 0, "true")).unionByName(entry("a", clean, 1, "doc_id % 5 = 0"))
    log = log.unionByName(entry(ev.DECISION, good, 2, "doc_id % 3 > 0 AND (quality = 1) <> (toxic = 0)"))
    return _six(ev.agreement(stored(log, "adjudication"), "a", "b"))


@query(sql.SPLIT)
def split_stratified(spark, sf_dir):
    """Documents halved within each language by a seeded digest."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "lang")
    return ev.split_by_hash(rows, "lang", 7)


@query(sql.KAPPA)
def label_agreement_kappa(spark, sf_dir):
    """Agreement of two columns of labels."""
    return _six(ev.kappa(_table(spark, sf_dir, "labels"), "quality", "toxic"))
