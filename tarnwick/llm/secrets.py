"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every document is addressed by the SHA-256 of its content.
The ledger, on shared files, says which blobs were scanned with which version
of which rule; a scan reads the texts of unseen pairs only, one row per
distinct blob, and joins the findings back to all rows that hold the blob.
Copies are merged map-side before the shuffle, so a hot blob is scanned once.

Spark has no function for the places of regex matches, so a text is split by a
rule's pattern and matched by it: gaps and matches alternate, and a running sum
of their lengths gives each match's place, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_unique, shared_path, small_enough, stored


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern; where ``group`` is set, that group must have ``least`` characters. A new ``version`` is scanned anew."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}:{self.version}"


# The base kinds in their order. Runs of a class with a least length are the same matches as all runs
# with the short ones dropped; for assignments a short value still uses up its text, so it is dropped afterwards.
BASE = (
    Rule("assign", "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Kinds beyond the base ones: private key blocks, and tokens with a telling prefix.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("prefixed", "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
_SCANNED = T.StructType([T.StructField("sha", T.BinaryType()), T.StructField("scanned", T.ArrayType(T.StringType()))])
_FOUND = T.StructType([T.StructField("sha", T.BinaryType()), T.StructField("rule", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "end"))])
_SEEN_LIMIT = 200_000


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, as Parquet under ``path``. Findings are written first, so a scan that breaks off is only repeated."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: T.StructType) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else None

    def scanned(self) -> DataFrame | None:
        """(sha, scanned): the rule versions each blob was scanned with; None before the first scan."""
        return self._read("scanned", _SCANNED)

    def findings(self) -> DataFrame:
        """(sha, rule, start, end), each once."""
        found = self._read("findings", _FOUND)
        return self.spark.createDataFrame([], _FOUND) if found is None else found.distinct()

    def add(self, findings: DataFrame, blobs: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Enter a scan of ``blobs`` (sha) with ``rules``."""
        findings.write.mode("append").parquet(f"{self.path}/findings")
        blobs.select("sha", F.array(*(F.lit(r.tag) for r in rules)).alias("scanned")).write.mode("append").parquet(f"{self.path}/scanned")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (sha, rule, start, end) in ``blobs`` (sha, text); with a column ``seen``, rule versions in it are skipped."""
    skip = [F.array_contains("seen", r.tag) if "seen" in blobs.columns else F.lit(False) for r in rules]
    none = F.array().cast("array<string>")
    matched = blobs.select("sha", "text", *(F.when(s, none).otherwise(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m{k}") for k, (r, s) in enumerate(zip(rules, skip))))

    def places(k: int, rule: Rule) -> F.Column:
        kept = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.group else (lambda m: F.lit(True))
        hits = F.transform(f"m{k}", lambda m: F.struct(F.length(m).cast("long").alias("long"), kept(m).alias("kept")))
        gaps = F.transform(F.split("text", rule.pattern, -1), lambda g: F.length(g).cast("long"))
        return F.when(F.size(f"m{k}") > 0, F.struct(F.lit(rule.tag).alias("rule"), F.arrays_zip(hits.alias("hit"), gaps.alias("gap")).alias("run")))

    by_rule = matched.select("sha", F.explode(F.array_compact(F.array(*(places(k, r) for k, r in enumerate(rules))))).alias("r")).select("sha", "r.rule", F.posexplode("r.run").alias("k", "x"))
    spans = by_rule.where("x.hit is not null").select("sha", "rule", "k", F.col("x.gap").alias("gap"), F.col("x.hit.long").alias("long"), F.col("x.hit.kept").alias("kept"))
    run = Window.partitionBy("sha", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = spans.repartition("sha").withColumn("end", F.sum(F.col("gap") + F.col("long")).over(run))
    return ended.where("kept").select("sha", "rule", (F.col("end") - F.col("long")).alias("start"), "end")


def scan(rows: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger hasn't seen; (rows with their blob, findings of those rules).

    The first has ``keep`` and ``sha`` for each row of ``rows``, the second
    (sha, rule, start, end) of every blob ever scanned, from the ledger.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = rows.select(*keep, text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    at = stored(named.select(*keep, "sha"), "secret-rows")
    tags = F.array(*(F.lit(r.tag) for r in rules))
    seen = ledger.scanned()
    blobs = at.select("sha").distinct()
    if seen is None:
        todo = named
    else:
        seen = seen.groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
        blobs = stored(blobs.join(seen, "sha", "left").where(F.col("seen").isNull() | (F.size(F.array_except(tags, "seen")) > 0)), "secret-todo")
        todo = named.join(F.broadcast(blobs.select("sha")) if small_enough(blobs, _SEEN_LIMIT) else blobs.select("sha"), "sha", "left_semi")
    once = todo.groupBy("sha", "text").agg(F.count(F.lit(1)).alias("copies"))
    if seen is not None:
        once = once.join(blobs, "sha").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    ledger.add(scan_blobs(once, rules), blobs, rules)
    return at, ledger.findings().where(F.col("rule").isin([r.tag for r in rules]))


def secret_digests(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty; a row without findings has zero counts, the
    SHA-256 of nothing and an empty ``spans``. Ids, null or repeated, pass
    through. Spans that start together go by kind, as listed in ``rules``. An
    empty table gives no rows; extra columns aren't read. Without a ledger a
    new one is begun in the shared folder.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, shared_path(spark, "ledger"))
    at, found = scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ledger, rules)
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.tag, k)))
    span = F.struct("start", order[F.col("rule")].alias("no"), "end", F.split_part("rule", F.lit(":"), F.lit(1)).alias("kind"))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    by_blob = found.groupBy("sha").agg(F.array_sort(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["no"] < len(BASE))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digests = by_blob.select("sha", *(number(r.kind) for r in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"))
    none = F.lit(0).cast("long")
    return join_unique(at, digests, ["sha"]).select(
        "doc_id", *(F.coalesce(f"n_{r.kind}", none).alias(f"n_{r.kind}") for r in BASE), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``documents``."""
    return secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = f"""
WITH rules(no, kind, re) AS (VALUES {", ".join(f"({k}, {_quoted(r.kind)}, {_quoted(r.pattern)})" for k, r in enumerate(RULES))}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, no, kind, re, string_split_regex(t, re) AS p, regexp_extract_all(t, re) AS a FROM d, rules),
s AS (SELECT doc_id, no, kind, re, p, a, unnest(range(1, len(a) + 1)) AS k FROM m WHERE len(a) > 0),
x AS (SELECT doc_id, no, kind, a[k] AS v, re,
        list_sum(list_transform(p[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(a[1:k-1], lambda g: length(g))), 0) AS st FROM s),
f AS (SELECT doc_id, no, kind, st::BIGINT AS st, (st + length(v))::BIGINT AS en FROM x WHERE no > 0 OR length(regexp_extract(v, {_quoted(BASE[0].pattern)}, 2)) >= 8),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
        coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, no) FILTER (no < {len(BASE)}), '') AS base,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, no) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
