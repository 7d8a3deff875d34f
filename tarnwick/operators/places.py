"""Places of rows in an order, without a task that holds a group whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows beside which a side is broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has few rows; any other is joined by a shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` sorted by ranges of keys and order and written, with each row's range and place in it."""
    sort = [F.col(c) for c in (*keys, *order)]
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return stored(rows.withColumn("__range", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "placed")


def _with_starts(rows: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` joined with the numbers of their range and keys."""
    of = starts.select(F.col("__range").alias("__of"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in starts.columns if c not in ("__range", *keys)))
    on = F.col("__range") == F.col("__of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(small(of), on)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "at") -> DataFrame:
    """``df`` with each row's place, from 0, among the rows of its ``keys`` by ``order``, as a long.

    Rows are sorted by ranges of keys and order and written, so a key with many
    rows is many ranges; how many rows of a key the ranges before a row's own
    hold is summed from one number for each range and key. Keys may be null.
    Rows that are equal in keys and order come in any order.
    """
    rows = _ranged(df, keys, order)
    starts = rows.groupBy("__range", *keys).agg(F.min("__seq").alias("__least"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__n")
    starts = starts.select("__range", *keys, (before - F.col("__least")).alias("__shift"))
    return _with_starts(rows, starts, keys).select(*df.columns, (F.col("__seq") + F.col("__shift")).alias(name))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running sums and maxima of columns over the rows of its ``keys`` up to each by ``order``.

    Ranges as in ``placed``: a window runs within a range, and what the ranges
    before add is one row for each range and key.
    """
    sums, maxes = sums or {}, maxes or {}
    rows = _ranged(df.select("*", *(c.alias(f"__v_{n}") for n, c in (sums | maxes).items())), keys, order)
    whole = rows.groupBy("__range", *keys).agg(*(F.sum(f"__v_{n}").alias(n) for n in sums), *(F.max(f"__v_{n}").alias(n) for n in maxes))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("__range", *keys, *((F.sum if n in sums else F.max)(n).over(earlier).alias(f"__b_{n}") for n in (*sums, *maxes)))
    upto = Window.partitionBy("__range", *keys).orderBy("__seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select("*", *((F.sum if n in sums else F.max)(f"__v_{n}").over(upto).alias(f"__o_{n}") for n in (*sums, *maxes)))
    out = [(F.coalesce(F.col(f"__b_{n}"), F.lit(0)) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in sums]
    return _with_starts(own, starts, keys).select(*df.columns, *out, *(F.greatest(f"__b_{n}", f"__o_{n}").alias(n) for n in maxes))
