"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Edges that a task of a round takes at least: rounds over few edges are few tasks, however many partitions shuffles have.
TASK_EDGES = 100_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for every node of an edge the least node it is connected to.

    Alternating star contractions: every node's larger neighbours are linked to the least node near it, then
    its smaller ones are. Each round is two aggregates with map-side partials, each checkpointed and joined back
    to the edges, so that the join has two exchanges and Spark can split the edges of a hot node. The loop ends
    when a round changes nothing, which takes about log(n) rounds. Tasks grow with the edges that are left, as the driver
    keeps a record of each. Loops and edges with a null end are ignored.
    """
    pairs = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
    pairs = checkpoint(pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("hi") != F.col("lo"))).distinct())

    def state(p: DataFrame) -> tuple:
        # sums of two hashes stand for the set of edges; decimals keep long sums exact
        return tuple(p.agg(F.count("*"), *[F.sum(F.xxhash64("hi", "lo", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]).first())

    before = state(pairs)
    while before[0]:
        parts = -(-before[0] // TASK_EDGES)
        pairs = pairs.coalesce(parts)
        both = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # hi: the node, lo: its neighbour
        least = checkpoint(both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m")).coalesce(parts))
        large = both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = checkpoint(large.where("hi <> lo").coalesce(parts).distinct().coalesce(parts))
        least = checkpoint(large.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(parts))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        pairs = checkpoint(small.where("hi <> lo").coalesce(parts).distinct().coalesce(parts))
        after = state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
