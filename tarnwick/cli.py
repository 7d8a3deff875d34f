"""Commands: corpus fetch, manifest and verify; build-index, search, evaluate, make-split, digest, render-docs."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import functions as F

from . import __version__
from .functions import providers as pv
from .functions import statistics as st
from .operators import chunking as ch
from .operators import evaluation as ev
from .operators import retrieval as rt
from .plans import experiment, report
from .session import get_spark
from .sources import corpus, manifest

CORPUS, INDEX, RESULTS, MANIFEST, GOLDEN, SPLIT = "corpus", "index", "results", "results/corpus_manifest.json", "eval/golden.json", "eval/split.json"


def _pins(args) -> list[manifest.Pin]:
    return [manifest.Pin.parse(p) for p in args.project or []]


def corpus_fetch(args) -> int:
    for pin in _pins(args) or manifest.pins(json.loads(Path(args.manifest).read_text(encoding="utf-8"))):
        print(manifest.fetch(pin, args.corpus))
    return 0


def corpus_manifest(args) -> int:
    made = manifest.build(corpus.scan_files(get_spark(), args.corpus), args.corpus, _pins(args))
    manifest.write(made, args.out)
    print(f"{made['totals']['files']} files, {made['totals']['lines']} lines")
    return 0


def corpus_verify(args) -> int:
    spark = get_spark()
    problems = manifest.verify(spark, corpus.scan_files(spark, args.corpus), json.loads(Path(args.manifest).read_text(encoding="utf-8")), args.corpus)
    print("\n".join(problems) or "the corpus is as the manifest says")
    return int(bool(problems))


def build_index(args) -> int:
    files = corpus.scan_files(get_spark(), args.corpus).persist()
    for chunking in ch.CHUNKINGS if args.chunking == "all" else (args.chunking,):
        chunks = corpus.with_index(ch.build_chunks(files, chunking), "parts", "ord").drop("parts", "ord")
        manifest.write_chunks(chunks.orderBy("idx").drop("idx"), f"{args.index}/chunks_{chunking}.jsonl")
        print(chunking, ch.size_summary(chunks).first().asDict())
    return 0


def search(args) -> int:
    path = Path(args.index) / f"chunks_{args.chunking}.jsonl"
    if not path.exists():
        print(f"no index at {path}; run build-index first", file=sys.stderr)
        return 1
    spark = get_spark()
    read = corpus.read_chunks(spark, str(path)).withColumn("__file", corpus.F.input_file_name()).withColumn("__row", corpus.F.monotonically_increasing_id())
    chunks = corpus.with_index(read, "__file", "__row").drop("__file", "__row").persist()
    embedder = pv.HashingEmbedder()
    index = rt.Index(chunks, rt.Lexical.build(chunks), experiment.embed_chunks(chunks, embedder, args.index, args.chunking), pv.OverlapReranker())
    asked = spark.createDataFrame([("q", args.query, embedder.encode([args.query])[0].tolist())], "qid string, q string, vector array<float>")
    found = index.search(asked, args.strategy, args.k, args.per_file).select("idx", "rank").join(chunks, "idx").orderBy("rank")
    for r in found.collect():
        print(f"{r['rank']}. {r['path']}:{r['start_line']}-{r['end_line']} {r['kind']} {r['name']}")
    return 0


def evaluate(args) -> int:
    chunkings = ch.CHUNKINGS if args.chunkings == "all" else tuple(args.chunkings.split(","))
    if unknown := [c for c in chunkings if c not in ch.CHUNKINGS]:
        print(f"unknown chunking: {', '.join(unknown)}", file=sys.stderr)
        return 2
    if not Path(args.manifest).exists() and not args.allow_unverified_corpus:
        print(f"no manifest at {args.manifest}; --allow-unverified-corpus goes on without one", file=sys.stderr)
        return 2
    settings = experiment.Settings(
        args.corpus, args.golden, args.split, args.out, args.index, None if args.allow_unverified_corpus else args.manifest, chunkings,
        "auto" if args.per_file == "auto" else int(args.per_file), args.bootstrap, args.seed, reranker=None if args.no_rerank else pv.OverlapReranker(),
    )
    experiment.Experiment(get_spark(), settings).run()
    return 0


def make_split(args) -> int:
    first = F.coalesce(corpus.project_of(F.get("relevant", F.lit(0))), F.lit("?"))
    rows = corpus.read_golden(get_spark(), args.golden).select("qid", first.alias("project")).collect()
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["project"], []).append(r["qid"])
    manifest.write(ev.make_split(by, args.seed), args.out)
    return 0


def digest(args) -> int:
    found = {p.name: manifest.file_digest(p) for p in sorted(Path(args.results).glob("*.json"))} if args.raw else manifest.results_digest(args.results)
    for name, sha in found.items():
        print(sha, name)
    return 0


def render_docs(args) -> int:
    return report.render(args.results, args.readme, args.page, args.check)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnwick", description=__doc__)
    top.add_argument("--version", action="version", version=f"tarnwick {__version__}")
    top.add_argument("-v", "--verbose", action="store_true")
    sub = top.add_subparsers(required=True)

    def command(to, name, run, *options):
        p = to.add_parser(name)
        for flags, more in options:
            p.add_argument(*flags.split(), **more)
        p.set_defaults(run=run)

    opt = lambda flag, default, **more: (flag, {"default": default, **more})
    where, held, project = opt("--corpus", CORPUS), opt("--manifest", MANIFEST), ("--project", {"action": "append", "metavar": "NAME=URL@COMMIT"})
    inner = sub.add_parser("corpus").add_subparsers(required=True)
    command(inner, "fetch", corpus_fetch, where, held, project)
    command(inner, "manifest", corpus_manifest, where, opt("--out", MANIFEST), project)
    command(inner, "verify", corpus_verify, where, held)
    command(sub, "build-index", build_index, where, opt("--index", INDEX), opt("--chunking", "all", choices=("all", *ch.CHUNKINGS)))
    command(sub, "search", search, ("query", {}), opt("--index", INDEX), opt("--chunking", ev.SHIPPED, choices=ch.CHUNKINGS), opt("--strategy", "hybrid+cap", choices=rt.STRATEGIES), opt("--per-file", rt.PER_FILE, type=int), opt("-k", 5, type=int))
    flag = {"action": "store_true"}
    command(
        sub, "evaluate", evaluate, where, opt("--index", INDEX), opt("--golden", GOLDEN), opt("--split", SPLIT), opt("--out", RESULTS), held, ("--allow-unverified-corpus", flag), opt("--chunkings", "all"),
        ("--no-rerank", flag), opt("--per-file", "auto"), opt("--bootstrap", st.RESAMPLES, type=int), opt("--seed", st.SEED, type=int),
    )
    command(sub, "make-split", make_split, opt("--golden", GOLDEN), opt("--out", SPLIT), opt("--seed", st.SEED, type=int))
    command(sub, "digest", digest, opt("--results", RESULTS), ("--raw", flag))
    command(sub, "render-docs", render_docs, opt("--results", RESULTS), opt("--readme", "README.md"), opt("--page", "docs/evaluation.html"), ("--check", flag))
    return top


def main(argv: list[str] | None = None) -> int:
    """Run a command; its exit code."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return int(args.run(args))
