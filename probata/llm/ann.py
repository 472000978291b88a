"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast Hadamard transform, and assigns each to its two
nearest signed axes. A query probes in every table the pairs of axes that its own rotated vector is nearest to; what it
collects is ranked by the exact inner product. Several tables and probes make up for near vectors that fall to different
axes. With near-random vectors, as in the test tables, 32 tables with 96 probes collect a quarter of the rows.

Equal vectors are one candidate with its k + 1 least ids, which are all that can be among the k nearest. Candidates are
dealt to shards and queries to blocks of bounded size; each shard is indexed and searched for each block, and of a
shard's results only the best k + 1 go on. So the stated query set meets all rows block by block, and no task holds more
than a shard and a block, however many rows are equal or near.

Nearness is the largest inner product of the vectors as given, in double precision; ties go to the smaller id. Hashing
uses directions only. Where a query's probes collect fewer than ``least`` (1,000) vectors of a shard, too few to hold the
nearest of near-random ones, or fewer than k ids, it searches the whole shard; so small tables are searched exactly.
Defined results: vectors that are null, zero, hold a null or non-finite component or have another length than most, and
rows with a null id, take no part; rows that repeat count once; an id with several vectors is a candidate with each, and
a query with each; a query never finds its own id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


class CrossPolytope:
    """Tables of pseudo-random rotations for vectors of ``dims`` components."""

    def __init__(self, dims: int, tables: int, seed: int = 11) -> None:
        self.width = 1 << max(0, dims - 1).bit_length()
        self.signs = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (tables, 3, self.width)) * 2.0 - 1

    def rotated(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((self.width, len(x)))  # a row per component, so that sums and differences are of whole rows
        y[: x.shape[1]] = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        for signs in self.signs[table]:
            y = self._hadamard(y * signs[:, None])
        return y.T

    def _hadamard(self, y: np.ndarray) -> np.ndarray:
        h = 1
        while h < self.width:
            y = y.reshape(-1, 2, h, y.shape[-1])
            y = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(self.width, -1)
            h *= 2
        return y / math.sqrt(self.width)

    def signed(self, y: np.ndarray) -> np.ndarray:
        """The product with every signed axis: twice its number, plus one if it is the negative one."""
        out = np.empty((len(y), 2 * self.width))
        out[:, 0::2], out[:, 1::2] = y, -y
        return out

    def codes(self, y: np.ndarray) -> np.ndarray:
        """The two nearest signed axes of each row as one number."""
        if self.width == 1:
            return np.zeros(len(y), np.int64)
        size, rows = np.abs(y), np.arange(len(y))
        near = np.empty((len(y), 2), np.int64)
        for i in range(2):
            axis = size.argmax(axis=1)
            near[:, i] = 2 * axis + (y[rows, axis] < 0)
            size[rows, axis] = -1
        return near.min(axis=1) * 2 * self.width + near.max(axis=1)

    def probes(self, y: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest pairs of signed axes of each row."""
        if self.width == 1:
            return np.zeros((len(y), 1), np.int64)
        near = self.signed(y)
        # the best pairs are of the best axes: (i + 1) * (j - i / 2) pairs are no worse than that at places (i, j), and of
        # all pairs ``width`` are no pairs, as they have one axis with both signs
        axes = np.argsort(-near, axis=1, kind="stable")[:, : min(near.shape[1], most + 1)]
        i, j = np.triu_indices(axes.shape[1], 1)
        few = (i + 1) * (j - i / 2) <= most + self.width
        i, j = i[few], j[few]
        value = np.take_along_axis(near, axes, 1)
        both = np.where(axes[:, i] // 2 == axes[:, j] // 2, -np.inf, value[:, i] + value[:, j])
        best = np.argpartition(-both, most - 1, axis=1)[:, :most] if both.shape[1] > most else np.arange(both.shape[1])[None, :].repeat(len(both), 0)
        a, b = np.take_along_axis(axes[:, i], best, 1), np.take_along_axis(axes[:, j], best, 1)
        return np.minimum(a, b) * 2 * self.width + np.maximum(a, b)


def unpack(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def search_shard(queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int, tables: int, probes: int, least: int) -> list[list[tuple[float, int]]]:
    """For each query the best (score, id), most first, of what its probes find among ``vectors``."""
    index = CrossPolytope(queries.shape[1], tables)
    keep = k + 1
    orders, lows, sizes = [], [], []
    for t in range(tables):
        code = np.concatenate([index.codes(index.rotated(vectors[at : at + 4096], t)) for at in range(0, len(vectors), 4096)])
        orders.append(np.argsort(code, kind="stable").astype(np.int32))
        code = code[orders[t]]
        asked = np.concatenate([index.probes(index.rotated(queries[at : at + 512], t), probes) for at in range(0, len(queries), 512)])
        lows.append(np.searchsorted(code, asked, side="left").astype(np.int32))
        sizes.append(np.searchsorted(code, asked, side="right").astype(np.int32) - lows[t])
    total = len({i for own in ids for i in own}) if sum(map(len, ids)) <= 4 * keep else keep
    out, found = [], np.zeros(len(vectors), bool)
    for q in range(len(queries)):
        found[:] = False
        for t in range(tables):
            size = sizes[t][q]
            place = np.arange(size.sum()) + np.repeat(lows[t][q] - np.cumsum(size) + size, size)
            found[orders[t][place]] = True
        members = np.flatnonzero(found)
        best = _ranked(queries[q], vectors, members, ids, keep) if len(members) >= least else []
        if len(best) < min(keep, total):
            best = _ranked(queries[q], vectors, np.arange(len(vectors)), ids, keep)
        out.append(best)
    return out


def _ranked(query: np.ndarray, vectors: np.ndarray, members: np.ndarray, ids: list[list[int]], keep: int) -> list[tuple[float, int]]:
    scores = (vectors[members] * query).sum(axis=1)
    if len(members) > keep:
        last = np.partition(-scores, keep - 1)[keep - 1]
        at = np.flatnonzero(-scores <= last)
        members, scores = members[at], scores[at]
    best: dict[int, float] = {}
    for s, i in sorted((-float(s), i) for m, s in zip(members, scores, strict=True) for i in ids[m]):
        best.setdefault(i, -s)
        if len(best) == keep:
            break
    return [(s, i) for i, s in best.items()]


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 32, probes: int = 96, least: int = 1000, shard_rows: int = 32_768, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found of every row where ``is_query`` holds."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("id"), v.alias("v"), is_query.alias("q"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, keep = lengths.n, k + 1
    rows = rows.where(F.size("v") == dims)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per vector its least ids so far; goes on with an empty table when it has many vectors."""
        least: dict[bytes, list[int]] = {}
        asks: dict[bytes, bool] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(least), pa.binary()), pa.array(list(least.values()), pa.list_(pa.int64())), pa.array([asks[x] for x in least], pa.bool_())], ["v", "ids", "q"])

        for batch in batches:
            data = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) + 0.0
            for i, x, q in zip(batch.column(0).to_pylist(), data, batch.column(2).to_pylist(), strict=True):
                x = x.tobytes()
                own = least.setdefault(x, [])
                asks[x] = asks.get(x, False) or bool(q)
                if i not in own:
                    own.append(i)
                    if len(own) > 2 * keep:
                        least[x] = sorted(own)[:keep]
            if len(least) > 20_000:
                yield flush()
                least, asks = {}, {}
        yield flush()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in data], pa.binary())], ["id", "v"])

    parts = stored(rows.mapInArrow(distinct, "v binary, ids array<long>, q boolean"), "ann-parts")
    # the least ids by place and not in a list of all: each side of the shuffle keeps no more than go on
    first = parts.select("v", F.explode("ids").alias("id")).distinct()
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= keep)
    first = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kinds = first.join(parts.groupBy("v").agg(F.max("q").alias("q")), "v")
    kinds = stored(kinds.select("v", "ids", "q"), "ann")
    sizes = kinds.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    shards, blocks = -(-sizes.n // shard_rows) or 1, -(-sizes.q // block_rows) or 1

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            asked = left.column("v").to_pylist()
            hits = search_shard(unpack(left.column("v"), dims), unpack(right.column("v"), dims), right.column("ids").to_pylist(), k, tables, probes, least)
            for x, own in zip(asked, hits, strict=True):
                out[0].extend([x] * len(own))
                out[1].extend(i for _, i in own)
                out[2].extend(s for s, _ in own)
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["v", "id", "score"])

    own = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    queries = kinds.where("q").select("v", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    others = kinds.select("v", "ids", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    hits = queries.groupBy("block", "shard").cogroup(others.groupBy("block", "shard")).applyInArrow(search, "v binary, id long, score double")
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "id"))).where(F.col("r") <= keep)
    best = best.groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("list"))
    asking = rows.where("q").select("id", "v").mapInArrow(packed, "id long, v binary").distinct()
    lists = asking.join(best, "v").select(F.col("id").alias("query_id"), F.slice(F.filter("list", lambda x: x["id"] != F.col("id")), 1, k).alias("list"))
    found = lists.select("query_id", F.posexplode("list").alias("at", "x"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
