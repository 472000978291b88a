"""Exact and near duplicates, conflicts between labels, canonical rows, and splits that keep groups whole."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .graph import components
from .ranks import BROADCAST_ROWS, places


def exact_groups(df: DataFrame, content: str, id: str) -> DataFrame:
    """(hash, n, first_id) of the contents that occur more than once."""
    d = df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("hash")).agg(F.count("*").alias("n"), F.min(id).alias("first_id"))
    return d.where("n > 1")


def conflicts(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, labels) of the groups with more than one label."""
    d = df.groupBy(group).agg(F.count("*").alias("n"), F.collect_set(label).alias("labels"))
    return d.where(F.size("labels") > 1).withColumn("labels", F.array_sort("labels"))


def without_conflicts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows whose group has one label; the groups that have more are dropped whole."""
    bad = df.groupBy(group).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select(group)
    return df.join(checkpoint(bad), group, "left_anti")  # with an exchange of its own the join can split a hot group


def canonical(df: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """One row per group: the first by ``order``, with the given columns."""
    row = F.struct(*columns)
    return df.groupBy(group).agg(F.min_by(row, order).alias("r")).select(group, "r.*")


def sign_hash(vector: str, bits: int = 60) -> Column:
    """A number whose bit i is set where component i is above 0."""
    v = F.slice(vector, 1, bits)
    return F.aggregate(v, F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("b")), lambda a, x: F.struct((a["h"] + F.when(x > 0, a["b"]).otherwise(F.lit(0).cast("long"))).alias("h"), (a["b"] * 2).alias("b")), lambda a: a["h"])


def finer(mask: int, radius: int, bits: int) -> list[int]:
    """``mask`` with one more of radius + 1 parts of the bits that it leaves open, each."""
    free = [1 << i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(free[i :: radius + 1]) for i in range(radius + 1)]


def near_kinds(hashes: DataFrame, radius: int, bits: int = 60, most: int = 1000) -> DataFrame:
    """(h, h2, distance) of distinct hashes (h) that differ in at most ``radius`` bits, h < h2.

    Of radius + 2 bands of bits such hashes agree in two at least, so candidates come from an equi-join on pairs of bands. Where
    more than ``most`` hashes agree in a pair, what differs lies in the other bits, so of radius + 1 parts of these two near
    hashes agree in one at least: such a bucket is dealt to finer ones by its parts, and these likewise, until none is large.
    """
    most = max(most, 1 << radius)  # hashes that agree in all but ``radius`` bits are no more than that
    edges = [round(i * bits / (radius + 2)) for i in range(radius + 3)]
    bands = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    masks = [a | b for a, b in combinations(bands, 2)]
    keyed = hashes.select("h", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).withColumn("v", F.col("h").bitwiseAND(F.col("mask")))
    distance = F.bit_count(F.col("h").bitwiseXOR(F.col("h2")))
    out = None
    while True:
        hot = checkpoint(keyed.groupBy("mask", "v").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "v"))
        last = hot.isEmpty()
        cold = keyed if last else keyed.join(hot, ["mask", "v"], "left_anti")
        near = cold.join(cold.withColumnRenamed("h", "h2"), ["mask", "v"]).where((F.col("h") < F.col("h2")) & (distance <= radius))
        near = near.select("h", "h2", distance.cast("int").alias("distance"))
        out = near if out is None else out.unionByName(near)
        if last:
            return out.distinct()
        children = {m: finer(m, radius, bits) for m in masks}
        masks = sorted({c for own in children.values() for c in own})
        table = hashes.sparkSession.createDataFrame(sorted(children.items()), "mask long, finer array<long>")
        split = keyed.join(hot, ["mask", "v"], "left_semi").join(F.broadcast(table), "mask")
        keyed = checkpoint(split.select("h", F.explode("finer").alias("mask")).withColumn("v", F.col("h").bitwiseAND(F.col("mask"))))


def kinds(df: DataFrame, id: str, hash: str) -> DataFrame:
    """(h, id, n): the distinct hashes, with the least id and the number of their rows."""
    return checkpoint(df.where(F.col(hash).isNotNull()).groupBy(F.col(hash).alias("h")).agg(F.min(id).alias("id"), F.count("*").alias("n")))


def near_links(df: DataFrame, id: str, hash: str, radius: int, bits: int = 60) -> DataFrame:
    """(a, b, distance): what links rows whose hashes differ in at most ``radius`` bits. Rows of one hash hang on its least id (distance 0), and of two near hashes the least ids are linked, so no group is spelled out."""
    least = kinds(df, id, hash)
    rows = df.select(F.col(id).alias("a"), F.col(hash).alias("h"))
    star = rows.join(least.select("h", F.col("id").alias("b")), "h").where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("distance"))
    side = lambda h, i: least.select(F.col("h").alias(h), F.col("id").alias(i))
    near = near_kinds(least.select("h"), radius, bits).join(side("h", "x"), "h").join(side("h2", "y"), "h2")
    return star.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance"))


def near_counts(df: DataFrame, id: str, hash: str, radius: int, bits: int = 60) -> DataFrame:
    """(distance, pairs): how many pairs of rows differ in so many bits of their hashes, from the sizes of equal ones."""
    least = kinds(df, id, hash)
    side = lambda h, n: least.select(F.col("h").alias(h), F.col("n").alias(n))
    near = near_kinds(least.select("h"), radius, bits).join(side("h", "n1"), "h").join(side("h2", "n2"), "h2")
    pairs = near.select("distance", (F.col("n1") * F.col("n2")).alias("pairs")).unionByName(least.where("n > 1").select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("pairs")))
    return pairs.groupBy("distance").agg(F.sum("pairs").alias("pairs"))


def groups(df: DataFrame, links: DataFrame, id: str) -> DataFrame:
    """``df`` with ``component``: the least id that a row is connected to, its own if it has no link."""
    c = components(links, "a", "b").withColumnRenamed("node", id)
    return df.join(c, id, "left").withColumn("component", F.coalesce("component", id))


def group_sizes(df: DataFrame, *by: str, group: str = "component") -> DataFrame:
    """(by, rows, groups, singletons, largest) of grouped rows."""
    g = df.groupBy(*by, group).agg(F.count("*").alias("n"))
    return g.groupBy(*by).agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


def size_distribution(df: DataFrame, group: str = "component") -> DataFrame:
    """(size, groups): how many groups have each size."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def conflict_components(df: DataFrame, label: str, name: str, most: int = 20, group: str = "component") -> DataFrame:
    """(component, size, classes, names): components with more than one label; label counts as ``k:v``, the first names in order."""
    each = df.groupBy(group, label).agg(F.count("*").alias("n"))
    c = each.groupBy(group).agg(F.sum("n").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("k"), "n"))), lambda x: F.concat_ws(":", x["k"], x["n"])), " | ").alias("classes"), F.count("*").alias("kinds")).where("kinds > 1")
    place = F.row_number().over(Window.partitionBy(group).orderBy(name))
    names = df.join(c.select(group), group).withColumn("place", place).where(F.col("place") <= most)
    names = names.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(name).cast("string").alias("v")))), lambda x: x["v"]), " | ").alias("names"))
    return c.join(names, group).select(group, "size", "classes", "names")


def choose_sizes(sizes: Sequence[tuple[int, int]], target: int, seed: str) -> dict[int, int]:
    """How many groups of each size to take of (size, how many there are), so that they sum to ``target`` or, if no choice does, to the most that stays below it.

    Groups of one size are alike here, so the work follows from the sizes and the target, not from the groups. A size goes in
    as one, two, four, ... groups at a time; sizes are tried in an order that follows from ``seed``.
    """
    items = []
    for size, count in sizes:
        count, step = min(count, target // size if size else 0), 1
        while count > 0:
            items.append((size, min(step, count)))
            count, step = count - step, 2 * step
    items.sort(key=lambda x: hashlib.md5(f"{seed}|{x[0]}|{x[1]}".encode()).hexdigest())
    reach, last = np.zeros(target + 1, bool), np.full(target + 1, -1)
    reach[0] = True
    for n, (size, times) in enumerate(items):
        w = size * times
        fresh = np.flatnonzero(reach[:-w] & ~reach[w:]) + w if w <= target else []
        reach[fresh], last[fresh] = True, n
        if reach[target]:
            break
    out: dict[int, int] = {}
    at = int(np.flatnonzero(reach)[-1])
    while at:
        size, times = items[last[at]]
        out[size] = out.get(size, 0) + times
        at -= size * times
    return out


def target_size(total: int, wanted: int) -> int:
    """``wanted``, or 15 % of ``total`` (half to even, 1 at least) where that is under three times as much."""
    return wanted if total >= 3 * wanted else max(1, round(0.15 * total))


def split_groups(df: DataFrame, by: str, group: str, test: int, val: int, seed: str = "42") -> DataFrame:
    """(by, group, size, split): groups of each class dealt whole to test, then validation, then train.

    A class is seen as its counts of group sizes, up to the target; which groups of a size go where is settled by their places
    in the order of md5(seed|class|group), so no task holds the groups of a class. A null class is one of its own.
    """
    g = checkpoint(df.groupBy(by, group).agg(F.count("*").alias("size")))
    total = g.groupBy(F.col(by).alias("__by")).agg(F.sum("size").alias("rows"))
    counts = g.where(F.col("size") <= max(test, val, 1)).groupBy(F.col(by).alias("__by"), F.col("size").alias("__size")).agg(F.count("*").alias("groups"))
    counts = counts.join(F.broadcast(total.withColumnRenamed("__by", "__b")), F.col("__by").eqNullSafe(F.col("__b"))).drop("__b")  # a row per class

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, have = int(pdf["rows"].iloc[0]), dict(zip(pdf["__size"].tolist(), pdf["groups"].tolist(), strict=True))
        first = choose_sizes(sorted(have.items()), target_size(rows, test), f"{seed}|{pdf['__by'].iloc[0]}|test")
        left = sorted((s, n - first.get(s, 0)) for s, n in have.items())
        second = choose_sizes(left, target_size(rows, val), f"{seed}|{pdf['__by'].iloc[0]}|val")
        return pdf.assign(test=[first.get(s, 0) for s in pdf["__size"]], val=[second.get(s, 0) for s in pdf["__size"]])[["__by", "__size", "test", "val"]]

    kind = {f.name: f.dataType.simpleString() for f in g.schema.fields}
    takes = checkpoint(counts.groupBy("__by").applyInPandas(deal, f"__by {kind[by]}, __size long, test long, val long"))
    takes = F.broadcast(takes) if takes.count() <= BROADCAST_ROWS else takes
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col(group).cast("string")).cast("binary"))
    placed = places(g.withColumn("__key", key), ["__key", group], by, "size", out="__place")
    d = placed.join(takes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("size") == F.col("__size")), "left")
    split = F.when(F.col("__place") <= F.col("test"), "test").when(F.col("__place") <= F.col("test") + F.col("val"), "val").otherwise("train")
    return d.select(by, group, "size", split.alias("split"))


def leaks(df: DataFrame, group: str = "component", split: str = "split") -> DataFrame:
    """Groups that are in more than one split; empty if all is well."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def stratified(df: DataFrame, label: str, id: str, seed: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """``df`` with ``split``: within each label, rows in the order of md5(seed|id) are cut at the cumulative shares."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(id).cast("string")).cast("binary"))
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    d = places(df.withColumn("__key", key), ["__key", id], label, out="__place").drop("__key").join(n, label)
    out, upto = F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for name, share in reversed(shares[:-1]):
        out = F.when(F.col("__place") <= F.bround(F.col("__n") * F.lit(round(upto, 9))), name).otherwise(out)
        upto -= share
    return d.withColumn("split", out).drop("__place", "__n")
