import random

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import chunking as ch
from tarnwick.operators import windows as wn
from tarnwick.operators.places import running
from tarnwick.plans import catalog

COLUMNS = ["chunk_id", "project", "path", "kind", "name", "start_line", "end_line", "text", "parts", "ord"]


def both(files, **options):
    """(chunks by jumps, chunks by a loop over each file)."""
    jumped = wn.window_chunks(files, **options)
    looped = ch.build_chunks(files, "window", **options)
    return (sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr) for df in (jumped, looped))


def odd_files(spark):
    rng = random.Random(5)
    texts = ["", "\n", "\n\n\n", "one", "a b\n\n\nc d e\n", "- -\n- - -\n", " ".join(["w"] * 100), "x\n" * 7 + " ".join(["w"] * 61) + "\n" + "y z\n" * 5, None, " a b\x1cc　d\n e"]
    texts += ["\n".join(" ".join(rng.choice(["a", "-", "bb"]) for _ in range(rng.choice([0, 0, 1, 3, 8, 30]))) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = [(f"corpus/p{k % 3}/f {k}.txt", f"p{k % 3}", ["corpus", f"p{k % 3}", f"f {k}.txt"], t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, project string, parts array<string>, source string").repartition(4)


@pytest.mark.parametrize("budget", [10, 20, 60])
def test_windows_of_odd_files(spark, budget):
    jumped, looped = both(odd_files(spark), budget=budget)
    assert jumped == looped and jumped


def test_windows_by_any_counter(spark):
    jumped, looped = both(odd_files(spark), count=len, budget=120)
    assert jumped == looped and any("/" in r[4] for r in jumped)


def test_windows_of_all_documents(spark, sf_dir):
    files = catalog._files(spark, sf_dir).withColumn("parts", F.split("path", "/"))
    jumped, looped = both(files, budget=254)
    assert jumped == looped


def test_a_million_lines(spark):
    """One file of 10^6 lines, whose lines are dealt to many tasks, against sums and a loop of its own."""
    n, room = 1_000_000, 60 - 4
    sizes = [(k * 7919) % 13 for k in range(n - 1)] + [2]
    text = "\n".join(" ".join(["w"] * c) for c in sizes)
    files = spark.createDataFrame([("corpus/p/big.txt", "p", ["corpus", "p", "big.txt"], text)], "path string, project string, parts array<string>, source string")
    lines = wn.file_lines(files, wn.count_words, 60)
    got = sorted((r["first"], r["last"]) for r in wn.windows(lines).collect())
    want, lo = [], 0
    while lo < n:
        hi, held = lo, sizes[lo]
        while hi + 1 < n and held + sizes[hi + 1] <= room:
            hi += 1
            held += sizes[hi]
        if held:
            want.append((lo, hi))
        lo = n if hi == n - 1 else max(lo + 1, hi + 1 - (hi - lo + 1) // 4)
    assert got == want and len(want) > 100_000
    assert wn.window_steps(lines).rdd.getNumPartitions() > 1


def test_no_python_in_the_plan_of_the_steps(spark, sf_dir):
    lines = wn.file_lines(catalog._files(spark, sf_dir).withColumn("parts", F.split("path", "/")), wn.count_words, 254)
    plan = wn.windows(lines)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_running(spark):
    df = spark.range(3000).select((F.col("id") % 4).alias("k"), (F.col("id") * 7919 % 3001).alias("o"), (F.col("id") % 17).alias("v"))
    want, total, top = {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: r["o"]):
        total[r["k"]] = total.get(r["k"], 0) + r["v"]
        top[r["k"]] = max(top.get(r["k"], -1), r["v"])
        want[r["k"], r["o"]] = (total[r["k"]], top[r["k"]])
    got = running(df, ["k"], ["o"], sums={"s": F.col("v")}, maxes={"m": F.col("v")}).collect()
    assert {(r["k"], r["o"]): (r["s"], r["m"]) for r in got} == want and len(got) == 3000
