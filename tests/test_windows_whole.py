import pytest
from pyspark.sql import functions as F

from tarnwick.operators import windows as wn
from tarnwick.plans import catalog

from .test_windows import COLUMNS, odd_files


@pytest.mark.parametrize("count", [wn.count_words, len])
def test_whole_files_and_jumps_agree(spark, monkeypatch, count):
    """Every file by jumps, every file whole, and some of each."""
    files, seen = odd_files(spark), set()
    for limit in (-1, 80, 1 << 17):
        monkeypatch.setattr(wn, "WHOLE", limit)
        chunks = sorted(map(tuple, wn.window_chunks(files, count=count, budget=60).select(*COLUMNS).collect()), key=repr)
        bounds = sorted(map(tuple, wn.window_bounds(files, count, 60).select("project", "path", "start_line", "end_line").collect()))
        assert bounds == sorted((c[1], c[2], c[5], c[6]) for c in chunks)
        seen.add(repr(chunks))
    assert len(seen) == 1


def test_small_files_shuffle_no_lines(spark, sf_dir):
    files = catalog._files(spark, sf_dir).withColumn("parts", F.split("path", "/"))
    spread = files._jdf.queryExecution().toString().count("Exchange")
    assert wn.window_bounds(files, budget=254)._jdf.queryExecution().toString().count("Exchange") == spread
    assert wn.window_chunks(files, budget=254)._jdf.queryExecution().toString().count("Exchange") == spread
