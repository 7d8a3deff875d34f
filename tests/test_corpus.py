import hashlib
import json
import os

import pytest

from tarnwick import cli
from tarnwick.plans import experiment, report
from tests.samples import MARKDOWN, SOURCES
from tarnwick.sources import corpus, manifest
from tarnwick.streaming import ingest

FILES = {
    "demo/jobs.py": SOURCES["corpus/demo/jobs.py"],
    "demo/src/Reports.java": SOURCES["corpus/demo/Reports.java"],
    "demo/GUIDE.md": MARKDOWN,
    "demo/config.yml": "retries: 3\r\nrelay: set_relay\r\n",
    "other/web/app.jsx": "export const App = () => render(url);\n",
    "other/a.x/b.txt": "text of b\n",
    "other/a/b.txt": "text of a\n",
}
SKIPPED = {"demo/node_modules/x.js": "x", "demo/package-lock.json": "{}", "demo/p.png": "x", "demo/blank.md": " \n\t\n", "demo/dist/y.py": "y = 1"}
QUESTIONS = [
    ("d1", "when is a job tried again", ["corpus/demo/jobs.py"]), ("d2", "where is a report", ["corpus/demo/src/Reports.java", "corpus/demo/GUIDE.md"]), ("d3", "set relay retries", ["corpus/demo/config.yml"]),
    ("o1", "render the app url", ["corpus/other/web/app.jsx"]), ("o2", "text of a", ["corpus/other/a/b.txt"]), ("o3", "zebra", ["corpus/other/a.x/b.txt"]),
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("c") / "a b+c"
    for name, text in {**FILES, **SKIPPED}.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (top / "demo/latin.txt").write_bytes(b"caf\xe9")
    return top


def test_scan(spark, root):
    got = {r["path"]: r for r in corpus.scan_files(spark, str(root)).collect()}
    assert set(got) == {f"corpus/{n}" for n in FILES}
    r = got["corpus/demo/config.yml"]
    assert r["project"] == "demo" and r["lines"] == 2 and "\r" not in r["source"]
    import hashlib

    assert r["sha256"] == hashlib.sha256(FILES["demo/config.yml"].encode()).hexdigest()


def test_paths_order_by_parts(spark, root):
    files = corpus.scan_files(spark, str(root)).where("project = 'other'")
    got = [r["path"] for r in corpus.with_index(files, "parts").orderBy("idx").collect()]
    assert got == ["corpus/other/a/b.txt", "corpus/other/a.x/b.txt", "corpus/other/web/app.jsx"]


def test_index_is_dense(spark):
    df = spark.range(0, 1000, 3).repartition(7)
    got = [(r["idx"], r["id"]) for r in corpus.with_index(df, "id").orderBy("idx").collect()]
    assert got == list(enumerate(range(0, 1000, 3)))


def test_manifest_round_trip(spark, root, tmp_path):
    files = corpus.scan_files(spark, str(root))
    made = manifest.build(files, root, [manifest.Pin("demo", "https://h/x?a=b@c", "abcdef1")])
    assert made["totals"]["files"] == len(FILES) and made["projects"]["demo"]["commit"] == "abcdef1" and made["projects"]["other"]["commit"] is None
    assert manifest.verify(spark, files, made) == []
    with pytest.raises(ValueError):
        manifest.pins(made)
    made["files"] = [f for f in made["files"] if f["path"] != "jobs.py"]
    made["files"][0]["sha256"] = "0"
    made["files"].append({"project": "demo", "path": "gone.py", "lines": 1, "sha256": "1"})
    kinds = [p.split(":")[0] for p in manifest.verify(spark, files, made)]
    assert kinds == ["missing", "not in manifest", "content differs"]
    manifest.write(made, tmp_path / "x" / "m.json")
    f, p = corpus.read_manifest(spark, str(tmp_path / "x" / "m.json"))
    assert f.count() == len(made["files"]) and {r["project"] for r in p.collect()} == {"demo", "other"}


def test_pins():
    pin = manifest.Pin.parse("n=https://u@h/p=q@abcdef1")
    assert (pin.name, pin.repository, pin.commit) == ("n", "https://u@h/p=q", "abcdef1")
    for bad in ("n", "n=url", "n=url@abc", "=u@abcdefg"):
        with pytest.raises(ValueError):
            manifest.Pin.parse(bad)


def golden(path, questions=QUESTIONS):
    path.write_text(json.dumps({"protocol": {"v": "1"}, "questions": [{"id": i, "q": q, "relevant": r} for i, q, r in questions]}))
    return str(path)


def test_questions_and_splits(spark, tmp_path):
    q = corpus.read_golden(spark, golden(tmp_path / "g.json"))
    assert [r["qid"] for r in q.orderBy("ord").collect()] == [x[0] for x in QUESTIONS] and q.first()["difficulty"] == ""
    with pytest.raises(ValueError):
        corpus.read_golden(spark, golden(tmp_path / "h.json", QUESTIONS + QUESTIONS[:1]))
    for dev, test in ((["d1"], ["d1", "d2", "d3", "o1", "o2", "o3"]), (["d1"], ["d2"])):
        (tmp_path / "s.json").write_text(json.dumps({"method": "m", "dev": dev, "test": test}))
        with pytest.raises(ValueError):
            corpus.read_split(spark, str(tmp_path / "s.json"), q)


def test_chart():
    """Each configuration has a bar and an interval for both metrics, at their figures."""
    figure = {"hit_rate@5": {"value": 0.5, "ci95": [0.25, 0.75]}, "mrr": {"value": 0.125, "ci95": [0.0, 0.25]}}
    of = {s: {"chunking": "window", "strategy": s, "metrics": figure} for s in ("bm25", "hybrid+cap")}
    made = report._chart(type("Results", (), {"by_key": of})())
    assert made.count("<rect") == made.count("<line") == 4 and "hit rate@5 and MRR of every configuration" in made
    assert made.count('width="200.0"') == made.count('width="50.0"') == 2 and made.count('x1="420.0" x2="620.0"') == 2
    assert "hit rate@5 0.50" in made and "MRR 0.125" in made and "window / hybrid + per-file cap" in made


def test_whole_evaluation(spark, root, tmp_path, capsys):
    g, split, out, idx, m = golden(tmp_path / "g.json"), str(tmp_path / "s.json"), tmp_path / "r", tmp_path / "i", str(tmp_path / "r" / "corpus_manifest.json")
    assert cli.main(["make-split", "--golden", g, "--out", split]) == 0
    assert len(json.loads((tmp_path / "s.json").read_text())["dev"]) == 2
    common = ["evaluate", "--corpus", str(root), "--golden", g, "--split", split, "--out", str(out), "--index", str(idx), "--manifest", m, "--bootstrap", "200"]
    assert cli.main(common) == 2
    assert cli.main([*common, "--chunkings", "other"]) == 2
    assert cli.main(["corpus", "manifest", "--corpus", str(root), "--out", m]) == 0
    assert cli.main(["corpus", "verify", "--corpus", str(root), "--manifest", m]) == 0
    assert cli.main([*common, "--chunkings", "structural_merged,window"]) == 0
    metrics = json.loads((out / "metrics.json").read_text())
    keys = [c["key"] for c in metrics["configurations"]]
    assert keys[:3] == ["structural_merged/bm25", "structural_merged/dense", "structural_merged/hybrid"] and len(keys) in (10, 12)
    for c in metrics["configurations"]:
        assert c["n_questions"] == 6 and all(v["ci95"][0] <= v["value"] + 1e-4 and v["value"] <= v["ci95"][1] + 1e-4 for v in c["metrics"].values())
    best = next(c for c in metrics["configurations"] if c["key"].endswith("merged/bm25"))
    assert best["metrics"]["hit_rate@5"]["value"] >= 0.8
    found = json.loads((out / "retrievals.json").read_text())["structural_merged/bm25"]
    assert any(x["hit"] for r in found if r["id"] == "d3" for x in r["retrieved"][:3])
    first = manifest.results_digest(out)
    assert cli.main([*common, "--chunkings", "structural_merged,window"]) == 0
    assert manifest.results_digest(out) == first
    assert cli.main(["digest", "--results", str(out)]) == 0

    readme = tmp_path / "README.md"
    readme.write_text("".join(f"<!-- begin:{b} -->\n<!-- end:{b} -->\n" for b in report.BLOCKS if b != "corpus") + "<!-- begin:corpus -->\nold\n<!-- end:corpus -->\n")
    docs = ["render-docs", "--results", str(out), "--readme", str(readme), "--page", str(tmp_path / "d" / "p.html")]
    assert cli.main([*docs, "--check"]) == 1 and cli.main(docs) == 0 and cli.main([*docs, "--check"]) == 0
    assert "| structural, merged |" in readme.read_text() and "<table>" in (tmp_path / "d" / "p.html").read_text()
    with pytest.raises(ValueError):
        report.render_readme("nothing", report.Results(out))
    with pytest.raises(KeyError):
        report.render_readme("<!-- begin:odd -->\n<!-- end:odd -->", report.Results(out))

    (root / "demo/jobs.py").write_text("x = 1\n")
    try:
        assert cli.main(["corpus", "verify", "--corpus", str(root), "--manifest", m]) == 1
        with pytest.raises(SystemExit):
            cli.main(common)
    finally:
        (root / "demo/jobs.py").write_text(FILES["demo/jobs.py"])

    capsys.readouterr()
    assert cli.main(["search", "set relay", "--index", str(tmp_path / "none")]) == 1
    assert cli.main(["build-index", "--corpus", str(root), "--index", str(idx), "--chunking", "window"]) == 0
    assert cli.main(["search", "set relay retries", "--index", str(idx), "--chunking", "window", "-k", "2"]) == 0
    assert "config.yml:1-2" in capsys.readouterr().out


def test_a_given_cap_without_reranker(spark, root, tmp_path):
    g = golden(tmp_path / "g.json")
    (tmp_path / "s.json").write_text(json.dumps({"method": "m", "dev": ["d1", "o1"], "test": ["d2", "d3", "o2", "o3"]}))
    s = experiment.Settings(str(root), g, str(tmp_path / "s.json"), str(tmp_path / "r"), str(tmp_path / "i"), chunkings=("structural_merged",), per_file=2, resamples=50, reranker=None)
    e = experiment.Experiment(spark, s).run()
    assert [c["strategy"] for c in e.configurations] == ["bm25", "dense", "hybrid", "hybrid+cap"] and e.cap_ablation["rows"] == []
    assert e.metadata()["models"]["reranker"] is None and e.corpus["verified"] is False


def test_embedding_key_changes(spark):
    from tarnwick.functions.providers import HashingEmbedder

    class Other(HashingEmbedder):
        revision = "2"

    df = spark.createDataFrame([(0, "p", "n", "a"), (1, "p", "n", "b")], "idx bigint, path string, name string, text string")
    swapped = df.withColumn("idx", 1 - experiment.F.col("idx"))
    renamed = df.withColumn("name", experiment.F.lit("m"))
    keys = [experiment.embedding_key(*x) for x in ((df, HashingEmbedder()), (swapped, HashingEmbedder()), (renamed, HashingEmbedder()), (df, Other()))]
    assert len(set(keys)) == 4 and keys[0] == experiment.embedding_key(df, HashingEmbedder())


def test_the_published_key(spark):
    from tarnwick.functions.providers import HashingEmbedder

    df = spark.createDataFrame([(k, f"p{k}", "n", "é" * k) for k in range(50)], "idx bigint, path string, name string, text string").repartition(4)
    want = hashlib.sha256(b"hashing-64@1\n" + b"".join(f"p{k} :: n\n{'é' * k}".encode() + b"\0" for k in range(50))).hexdigest()[:16]
    assert experiment.payload_key(df, HashingEmbedder()) == want


def test_stream_keeps_the_newest(spark, tmp_path):
    land, store, check = (str(tmp_path / d) for d in ("land", "store", "check"))
    os.mkdir(land)
    for n, rows in enumerate(([(1, "one two", "s"), (2, "three", "s")], [(1, "one changed", "s")])):
        spark.createDataFrame(rows, ingest.DOCUMENTS).coalesce(1).write.mode("append").json(land)
        q = ingest.maintain(ingest.stream_documents(spark, land), store, check)
        q.awaitTermination()
    assert sorted((r["path"], r["text"]) for r in ingest.current(spark, store).collect()) == [("corpus/s/1", "one changed"), ("corpus/s/2", "three")]
