"""Places and quantiles within groups without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Counts per partition are broadcast up to this many rows.
BROADCAST_ROWS = 200_000


def _ranged(df: DataFrame, order: Sequence[str | Column], by: Sequence[str]) -> DataFrame:
    """``df`` sorted by ranges over all executors, with its place in a partition and the partition as __m and __p."""
    return checkpoint(df.orderBy(*by, *order)).withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))


def _joined(d: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """``d`` with the columns of ``sums``, which has a row per group and partition."""
    keys = [*by, "__p"]
    sums = sums.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[c for c in sums.columns if c not in keys])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return d.join(F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums, same)


def places(df: DataFrame, order: Sequence[str | Column], *by: str, out: str = "place") -> DataFrame:
    """``df`` with ``out``: the place from 1 of a row within ``by`` in the given order, which has to settle ties.

    Rows are sorted by ranges over all executors. A row's place is its place in its partition's part of the group, plus
    what the partitions before hold of the group, so there is a count per group and partition and nothing larger.
    """
    d = _ranged(df, order, by)
    sums = d.groupBy(*by, "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__f"))
    # by partition there are few rows of one group, but for one that many partitions share
    up = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = checkpoint(sums.withColumn("__b", F.coalesce(F.sum("__n").over(up), F.lit(0)) - F.col("__f") + 1).drop("__n", "__f"))
    return _joined(d, sums, by).withColumn(out, F.col("__m") + F.col("__b")).select(*df.columns, out)


def prefix_sums(df: DataFrame, order: Sequence[str | Column], values: Sequence[str], *by: str) -> DataFrame:
    """``df`` with ``<value>_before`` of each of ``values``: its sum over the rows of ``by`` before in the given order, which has to settle ties.

    As ``places``: within a partition's part of a group sums run over its rows, and the parts before count with their totals.
    Ranges follow the rows, so values that crowd in one corner of the order are spread like any others.
    """
    d = _ranged(df, order, by)
    up = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, "__p").agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(values)])
    sums = checkpoint(sums.select(*by, "__p", *[F.coalesce(F.sum(f"__s{i}").over(up), F.lit(0)).alias(f"__b{i}") for i in range(len(values))]))
    inside = Window.partitionBy(*by, "__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"__i{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, v in enumerate(values)})
    return _joined(d, sums, by).select(*df.columns, *[(F.col(f"__b{i}") + F.col(f"__i{i}")).alias(f"{v}_before") for i, v in enumerate(values)])


def quantiles(df: DataFrame, value: str, probs: Sequence[float], *by: str) -> DataFrame:
    """(by, q): the quantiles of a column, interpolated between neighbours, as an array in the order of ``probs``; nulls are passed over."""
    d = places(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), ["__v"], *by)
    n = d.groupBy(*by).agg(F.max("place").alias("__n"))
    want = F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("__i", "__q")
    spots = n.select(*by, "__n", want).withColumn("__at", (F.col("__n") - 1) * F.col("__q"))
    ends = F.array(F.floor("__at") + 1, F.least(F.floor("__at") + 2, F.col("__n")))
    spots = spots.select(*by, "__i", "__at", F.posexplode(ends).alias("__side", "place"))
    same = F.col("x.place") == F.col("y.place")
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    hit = spots.alias("x").join(d.alias("y"), same).select(*[F.col(f"x.{c}").alias(c) for c in by], "__i", "__at", "__side", "__v")
    side = lambda s: F.max(F.when(F.col("__side") == s, F.col("__v")))
    each = hit.groupBy(*by, "__i", "__at").agg(side(0).alias("lo"), side(1).alias("hi"))
    share = F.col("__at") - F.floor("__at")
    each = each.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * share)
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "v"))), lambda x: x["v"]).alias("q"))
