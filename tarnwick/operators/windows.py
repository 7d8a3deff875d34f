"""Overlapping windows of lines, found for all lines at once.

Every line gets the window that would begin with it: running sums of tokens put
its last line where the budget ends, which a running maximum over the sorted sums
reads off, and its length says where the next window begins. That makes a table
of jumps from line to line. Which windows there are follows by doubling: after k
rounds all lines are known that the first line reaches in less than 2^k jumps,
and the jumps are 2^k long. A file is rows of lines all the way, so one huge file
is work for many tasks. Files of up to ``WHOLE`` characters, whose lines needn't be
shuffled, run through the same table within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.providers import BUDGET, TokenCounter, count_words
from ..session import stored
from . import chunking as ch
from .places import placed, running, small

#: Words as Python parts them: runs of what isn't white space.
WORD = "[^\\t-\\r\\x1c- \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

#: Characters of a file up to which one task takes it whole.
WHOLE = 1 << 17


def counted(df: DataFrame, text: Column, count: TokenCounter, name: str) -> DataFrame:
    """``df`` with the number of tokens of ``text``: words by an expression, tokens of any other counter in batches."""
    if count is count_words:
        return df.withColumn(name, F.regexp_count(text, F.lit(WORD)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())], names=[*b.schema.names[:-1], name])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("__text", text).mapInArrow(run, f"{kept}, {name} long")


def file_lines(files: DataFrame, count: TokenCounter, budget: int) -> DataFrame:
    """(f, path, project, parts, n, room, i, line, c, worded) of files (path, project, parts, source), each numbered ``f``; ``i`` from 0."""
    parted = files.select("path", "project", "parts", F.coalesce("source", F.lit("")).alias("source")).withColumn("lines", tx.lines(F.col("source")))
    numbered = parted.where(F.size("lines") > 0).select(F.monotonically_increasing_id().alias("f"), "path", "project", "parts", F.size("lines").cast("long").alias("n"), "lines")
    sized = counted(numbered, F.concat(F.col("path"), F.lit(" :: lines "), F.col("n"), F.lit("-"), F.col("n"), F.lit("\n")), count, "head")
    rows = sized.select("f", "path", "project", "parts", "n", (F.lit(budget) - F.col("head")).alias("room"), F.posexplode("lines").alias("i", "line"))
    rows = counted(rows.withColumn("i", F.col("i").cast("long")), F.col("line"), count, "c")
    return stored(rows.withColumn("worded", F.col("line").rlike(tx.ALNUM)), "window-lines")


def window_steps(lines: DataFrame) -> DataFrame:
    """(f, i, last, big, worded, to): the window that begins with each line, whether the line alone exceeds it, whether it has a letter or digit, and the line where the next begins."""
    summed = running(lines.select("f", "n", "room", "i", "c", F.col("worded").cast("long").alias("w")), ["f"], ["i"], sums={"upto": F.col("c"), "seen": F.col("w")})
    summed = stored(summed, "window-sums")
    ends = summed.select("f", F.col("upto").alias("v"), F.lit(0).alias("kind"), "i", "seen", "n", "room", "c", "w")
    asked = summed.select("f", (F.col("upto") - F.col("c") + F.col("room")).alias("v"), F.lit(1).alias("kind"), "i", "seen", "n", "room", "c", "w")
    is_end = F.col("kind") == 0
    met = running(ends.unionByName(asked), ["f"], ["v", "kind", "i"], maxes={"reach": F.when(is_end, F.col("i")), "reached": F.when(is_end, F.col("seen"))}).where("kind = 1")
    big = F.col("c") > F.col("room")
    last = F.when(big, F.col("i")).otherwise(F.col("reach"))
    worded = F.when(big, F.col("w") > 0).otherwise(F.col("reached") - F.col("seen") + F.col("w") > 0)
    rows = met.select("f", "i", "n", "room", last.alias("last"), big.alias("big"), worded.alias("worded"))
    beyond = F.greatest(F.col("last") + 1 - F.floor((F.col("last") - F.col("i") + 1) * F.lit(ch.OVERLAP)), F.col("i") + 1)
    to = F.when(F.col("big"), F.col("i") + 1).when(F.col("last") < F.col("n") - 1, beyond)
    return stored(rows.withColumn("to", F.when(to < F.col("n"), to).cast("long")), "window-steps")


def reached(steps: DataFrame) -> DataFrame:
    """(f, i): the lines that line 0 of each file comes to by its steps (f, i, to), itself included."""
    jumps = steps.where("to IS NOT NULL").select("f", "i", "to")
    found = steps.where("i = 0").select("f", "i")
    while True:
        more = stored(found.join(jumps, ["f", "i"]).select("f", F.col("to").alias("i")), "window-reached")
        if not more.limit(1).count():
            return found
        found = found.unionByName(more)
        ahead = jumps.select("f", F.col("i").alias("to"), F.col("to").alias("__to"))
        jumps = stored(jumps.join(ahead, ["f", "to"]).select("f", "i", F.col("__to").alias("to")), "window-jumps")


def _pieces(lines: DataFrame, count: TokenCounter) -> DataFrame:
    """(f, i, k, pieces, piece) of lines (f, i, line, room) that exceed a window: numbered parts of their words."""
    room = F.greatest(F.col("room") - ch.PART_RESERVE, F.lit(ch.LEAST_PART))
    if count is count_words:
        words = F.regexp_extract_all("line", F.lit(WORD), F.lit(0))
        cut = lines.withColumn("room", room.cast("int")).withColumn("words", words)
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / F.col("room")).cast("int"), F.lit(1)) - 1), lambda k: F.array_join(F.slice("words", k * F.col("room") + 1, F.col("room")), " "))
        cut = cut.select("f", "i", parts.alias("all"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [ch.Budgeted("", [], count).pieces(line, room) for line, room in zip(*(c.to_pylist() for c in b.columns[2:]))]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.list_(pa.string()))], names=["f", "i", "all"])

        cut = lines.select("f", "i", "line", room.cast("long").alias("room")).mapInArrow(run, "f long, i long, all array<string>")
    return cut.select("f", "i", F.size("all").alias("pieces"), F.posexplode("all").alias("k", "piece"))


def windows(lines: DataFrame, count: TokenCounter = count_words) -> DataFrame:
    """(f, first, last, k, pieces, piece): the windows of ``lines``, ``k`` and the rest null but for pieces of one line. Windows without letter or digit are left out."""
    steps = window_steps(lines)
    met = stored(steps.join(reached(steps), ["f", "i"]), "windows")
    plain = met.where("NOT big AND worded").select("f", F.col("i").alias("first"), "last", F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("pieces"), F.lit(None).cast("string").alias("piece"))
    long = lines.select("f", "i", "line").join(met.where("big").select("f", "i", "room"), ["f", "i"]).select("f", "i", "line", "room")
    return plain.unionByName(_pieces(long, count).select("f", F.col("i").alias("first"), F.col("i").alias("last"), "k", "pieces", "piece"))


def _parted(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(files that a task takes whole, larger ones; None if there are none)."""
    size = F.coalesce(F.length("source"), F.lit(0))
    large = files.where(size > WHOLE)
    return files.where(size <= WHOLE), large if large.limit(1).count() else None


def window_bounds(files: DataFrame, count: TokenCounter = count_words, budget: int = BUDGET) -> DataFrame:
    """(project, path, start_line, end_line) of the windows of files (path, project, parts, source), without their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, first, last = [], [], []
            for k, (path, source) in enumerate(zip(b.column(1), b.column(2))):
                path = path.as_py()
                for s in ch.window_spans(ch.Budgeted(path, tx.split_lines(source.as_py() or ""), count, budget)):
                    own.append(k)
                    first.append(s.first + 1)
                    last.append(s.last + 1)
            kept = pa.RecordBatch.from_arrays(b.columns[:2], names=["project", "path"]).take(pa.array(own, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["project", "path", "start_line", "end_line"])

    small_files, large = _parted(files)
    out = small_files.select("project", "path", "source").mapInArrow(run, "project string, path string, start_line int, end_line int")
    if large is None:
        return out
    lines = file_lines(large, count, budget)
    heads = lines.where("i = 0").select("f", "project", "path")
    return out.unionByName(windows(lines, count).join(heads, "f").select("project", "path", (F.col("first") + 1).cast("int").alias("start_line"), (F.col("last") + 1).cast("int").alias("end_line")))


def window_chunks(files: DataFrame, count: TokenCounter = count_words, budget: int = BUDGET) -> DataFrame:
    """Window chunks of files, with ``parts`` and ``ord``, as ``chunking.build_chunks`` gives them."""
    small_files, large = _parted(files)
    whole = ch.build_chunks(small_files, "window", count, budget)
    return whole if large is None else whole.unionByName(_jumped_chunks(large, count, budget))


def _jumped_chunks(files: DataFrame, count: TokenCounter, budget: int) -> DataFrame:
    """Window chunks of files of any size, by the table of jumps over all their lines."""
    lines = file_lines(files, count, budget)
    found = stored(windows(lines, count), "windows")
    spread = found.where("k IS NULL").select("f", "first", F.explode(F.sequence("first", "last")).alias("i"))
    bodies = spread.join(lines.select("f", "i", "line"), ["f", "i"]).groupBy("f", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("body"))
    number = lambda c: (F.col(c) + 1).cast("string")
    plain = F.concat(F.lit("lines "), number("first"), F.lit("-"), number("last"))
    name = F.when(F.col("k").isNull(), plain).otherwise(F.concat(plain, F.lit(" ("), number("k"), F.lit("/"), F.col("pieces"), F.lit(")")))
    texts = found.join(bodies, ["f", "first"], "left").select("f", "first", "last", F.coalesce("k", F.lit(0)).alias("k"), name.alias("name"), F.coalesce("piece", "body").alias("text"))
    heads = lines.where("i = 0").select("f", "path", "project", "parts")
    rows = placed(texts, ["f"], ["first", "k"], "ord").join(small(heads), "f")
    ident = F.concat_ws("::", F.col("path"), F.lit("window"), F.col("name"), number("first"))
    return rows.select(ident.alias("chunk_id"), "project", "path", F.lit("window").alias("kind"), "name", (F.col("first") + 1).cast("int").alias("start_line"), (F.col("last") + 1).cast("int").alias("end_line"), "text", "parts", F.col("ord").cast("int").alias("ord"))
