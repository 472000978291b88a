"""Bootstrap, paired tests and intervals with draws that any engine can repeat.

Metrics that count draw how often each cell comes up (``bootstrap_counts``), at a cost that doesn't grow with the rows. Where
sums over the rows drawn are wanted, rows are drawn inside of blocks (``bootstrap_sums``), or from all rows, as other engines
do (``drawn_sums``). Where the rows themselves are, draw
``pos`` of replicate ``rep`` is the first 32 bits of md5(seed|rep|pos) modulo n, an index into rows numbered from 0
(``bootstrap``, replicates x rows, for small tables).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.distributions import binomial_quantile, clopper_pearson, let, ln_gamma
from ..session import stored
from .ranks import places

#: Numbered rows are broadcast to their draws up to this many.
BROADCAST_ROWS = 200_000
#: Draws that a task makes.
TASK_DRAWS = 4_000_000

__all__ = ["binomial_two_sided", "block_counts", "bootstrap", "bootstrap_counts", "bootstrap_sums", "clopper_pearson", "drawn_sums", "draws", "interval", "mcnemar", "numbered", "uniform", "verdict"]


def draws(spark, reps: int, n: int, seed: str) -> DataFrame:
    """(rep, pos, idx) of all replicates."""
    d = spark.range(reps * n).select(F.expr(f"id div {n}").alias("rep"), F.expr(f"id % {n}").alias("pos"))
    h = F.md5(F.concat_ws("|", F.lit(seed), "rep", "pos").cast("binary"))
    return d.withColumn("idx", F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n)


def numbered(df: DataFrame, id: str) -> DataFrame:
    """``df`` with ``idx``: its place from 0 in the order of ``id``."""
    return places(df, [id], out="idx").withColumn("idx", F.col("idx") - 1)


def bootstrap(df: DataFrame, id: str, reps: int, seed: str) -> DataFrame:
    """Rows of ``df`` (narrow: keep only what the metric needs) once per draw, with ``rep``."""
    rows = numbered(df, id)
    n = rows.count()
    return draws(df.sparkSession, reps, n, seed).join(rows, "idx").drop("idx", "pos")


def uniform(seed: str, *key: Column) -> Column:
    """A number between 0 and 1, both excluded, that follows from the key: 32 bits of its md5."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]).cast("binary"))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 2**32


def bootstrap_counts(df: DataFrame, reps: int, seed: str, *by: str) -> DataFrame:
    """(rep, by, n): how often a replicate draws from each combination of the columns ``by``; no row is drawn.

    A metric that only counts needs no rows: the counts of a replicate are multinomial. They are drawn cell by cell, in the
    order of ``by``, as binomial quantiles of what is left, each from its own number, so a replicate costs a step per cell
    however many rows there are. What the driver sees is a row per combination; ``by`` has to be few columns of few values.
    """
    table = df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by).collect()
    reps_ = df.sparkSession.range(reps).select(F.col("id").alias("rep"))
    if not table:
        return reps_.limit(0).crossJoin(df.select(*by).limit(0)).withColumn("n", F.lit(0).cast("long"))
    sizes = F.array(*[F.lit(int(r.n)) for r in table]).cast("array<bigint>")
    every = F.lit(sum(int(r.n) for r in table)).cast("long")
    start = F.struct(every.alias("left"), every.alias("pool"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        own = sizes[i]
        drawn = binomial_quantile(uniform(seed, F.col("rep"), i), acc["left"], own / acc["pool"])
        return let(drawn, lambda k: F.struct((acc["left"] - k).alias("left"), (acc["pool"] - own).alias("pool"), F.concat(acc["out"], F.array(k)).alias("out")))

    counts = F.aggregate(F.sequence(F.lit(0), F.lit(len(table) - 1)), start, step, lambda acc: acc["out"])
    schema = df.select(*by).schema
    cells = df.sparkSession.createDataFrame([(i, *[r[c] for c in by]) for i, r in enumerate(table)], StructType([StructField("cell", IntegerType()), *schema.fields]))
    drawn = reps_.select("rep", F.posexplode(counts).alias("cell", "n"))
    return drawn.join(F.broadcast(cells), "cell").select("rep", *by, "n")


def block_counts(spark, n: int, reps: int, seed: str, block: int) -> DataFrame:
    """(rep, block, draws): how many of a replicate's ``n`` draws fall in each block of ``block`` numbered rows.

    Draws are split in halves of the blocks, and these again, by binomial quantiles; each round is cut off by writing it.
    """
    d = spark.range(reps).select(F.col("id").alias("rep"), F.lit(0).cast("long").alias("lo"), F.lit(-(-n // block)).cast("long").alias("hi"), F.lit(n).cast("long").alias("draws"))
    width = -(-n // block)
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2)
        share = (mid - F.col("lo")) * block / (F.least(F.col("hi") * block, F.lit(n)) - F.col("lo") * block)
        left = F.when(F.col("hi") - F.col("lo") > 1, binomial_quantile(uniform(seed, F.lit("blocks"), F.col("rep"), F.col("lo"), F.col("hi")), F.col("draws"), share)).otherwise(F.col("draws"))
        parts = let(left, lambda k: F.array(F.struct(F.col("lo").alias("lo"), F.when(F.col("hi") - F.col("lo") > 1, mid).otherwise(F.col("hi")).alias("hi"), k.alias("draws")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"), (F.col("draws") - k).alias("draws"))))
        d = stored(d.select("rep", F.explode(parts).alias("x")).select("rep", "x.*").where("draws > 0"), "block-draws")
        width = -(-width // 2)
    return d.select("rep", F.col("lo").alias("block"), "draws").where("draws > 0")


def bootstrap_sums(df: DataFrame, id: str, reps: int, seed: str, *values: str, block: int = 65_536) -> DataFrame:
    """(rep, n, values): of each replicate the number of draws and the sums of the columns over the rows drawn.

    A block's rows lie in one array, and its draws, the first 32 bits of md5(seed|rep|block|pos) modulo its size, are looked up
    and summed there: rows are shuffled once and draws never, and a task holds a block. Nulls add nothing.
    """
    rows = numbered(df.select(id, *[v for v in values if v != id]), id)
    n = rows.count()
    entry = F.struct(F.col("idx"), *[F.coalesce(F.col(v), F.lit(0)).alias(f"v{i}") for i, v in enumerate(values)])
    packed = rows.groupBy(F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    counts = block_counts(df.sparkSession, n, reps, seed, block).groupBy("block").agg(F.collect_list(F.struct("rep", "draws")).alias("counts"))  # as many as replicates
    zero = [F.lit(0).cast("decimal(38,6)") if t.startswith("decimal") else F.lit(0).cast("double" if t in ("double", "float") else "long") for t in (dict(df.dtypes)[v] for v in values)]

    def drawn(c: Column) -> Column:
        def step(acc: Column, pos: Column) -> Column:
            h = F.md5(F.concat_ws("|", F.lit(seed), c["rep"].cast("string"), F.col("block").cast("string"), pos.cast("string")).cast("binary"))
            at = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.size("rows")).cast("int")
            return let(F.get("rows", at), lambda r: F.struct(*[(acc[f"s{i}"] + r[f"v{i}"]).alias(f"s{i}") for i in range(len(values))]))

        start = F.struct(*[z.alias(f"s{i}") for i, z in enumerate(zero)])
        sums = F.aggregate(F.sequence(F.lit(0).cast("long"), c["draws"] - 1), start, step)
        return let(sums, lambda s: F.struct(c["rep"].alias("rep"), c["draws"].alias("n"), *[s[f"s{i}"].alias(f"s{i}") for i in range(len(values))]))

    out = packed.join(counts, "block").select(F.explode(F.transform("counts", drawn)).alias("x")).select("x.*")
    return out.groupBy("rep").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(v) for i, v in enumerate(values)])


def drawn_sums(df: DataFrame, id: str, reps: int, seed: str, *values: str) -> DataFrame:
    """(rep, n, values): as ``bootstrap_sums``, but each draw is one of all rows: the first 32 bits of md5(seed|rep|0|pos) modulo their number.

    Draws are made where they are summed if the rows, which are counted first, are few enough to be broadcast. Beyond that they
    are dealt by row, as (rep, idx), and a task sums its own by replicate before these sums move. Nulls add nothing.
    """
    rows = stored(numbered(df.select(id, *[v for v in values if v != id]), id).select("idx", *[F.coalesce(F.col(v), F.lit(0)).alias(f"v{i}") for i, v in enumerate(values)]), "drawn-rows")
    n = rows.count()
    spark, size = df.sparkSession, max(n, 1)
    d = spark.range(0, reps * n, 1, max(spark.sparkContext.defaultParallelism, -(-reps * n // TASK_DRAWS))).select(F.expr(f"id div {size}").alias("rep"), F.expr(f"id % {size}").alias("pos"))
    h = F.md5(F.concat_ws("|", F.lit(seed), "rep", F.lit("0"), "pos").cast("binary"))
    d = d.select(F.col("rep").cast("int").alias("rep"), (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size).alias("idx"))
    known = F.broadcast(rows) if n <= BROADCAST_ROWS else rows.hint("shuffle_hash")
    out = d.join(known, "idx").groupBy("rep").agg(F.count("*").alias("n"), *[F.sum(f"v{i}").alias(v) for i, v in enumerate(values)])
    return out.withColumn("rep", F.col("rep").cast("long"))


def interval(df: DataFrame, *values: str) -> DataFrame:
    """(metric, low, median, high): 95 % percentile interval of the columns over replicates, nulls skipped."""
    q = [F.percentile(v, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias(v) for v in values]
    one = df.agg(*q)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("q")) for v in values])).alias("x")
    return one.select(rows).select("x.metric", F.col("x.q")[0].alias("low"), F.col("x.q")[1].alias("median"), F.col("x.q")[2].alias("high"))


def verdict(low: str, high: str) -> Column:
    """Whether an interval leaves out zero."""
    return F.when((F.col(low) > 0) | (F.col(high) < 0), "Supported").otherwise("Interval includes zero")


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c at one half: twice the smaller tail, 1 at most; 1 if both are 0.

    The tail's largest term comes from logarithms and the others from it, downwards, so nothing underflows before the
    whole tail does. Terms more than 12 sqrt(n) + 64 places down are less than 1e-100 of it and left out.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    top = F.exp(ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1) - n * math.log(2))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("tail"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i) / (n - k + i + 1)
        return F.struct(term.alias("term"), (a["tail"] + term).alias("tail"))

    places = F.least(k, F.floor(12 * F.sqrt(n)) + 64).cast("long")
    down = F.when(places > 0, F.sequence(F.lit(0).cast("long"), places - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * F.aggregate(down, start, step)["tail"]))


def mcnemar(df: DataFrame, first: str, second: str) -> DataFrame:
    """(b, c, p): rows only the first gets right, rows only the second does, and the exact test."""
    d = df.agg(F.count_if(F.col(first) & ~F.col(second)).alias("b"), F.count_if(~F.col(first) & F.col(second)).alias("c"))
    return d.select("b", "c", binomial_two_sided(F.col("b"), F.col("c")).alias("p"))
