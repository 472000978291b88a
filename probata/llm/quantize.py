"""Product codes of vectors by Lloyd's rounds with Hamerly's bounds, in integers.

A component c becomes floor(4096 * c). Vectors are cut into equal consecutive parts; each part position has a codebook of
its own, which starts as that part of the vectors with the smallest ids. A round assigns every part to the nearest entry
(squared Euclidean distance, ties to the lower index) and replaces an entry by the floored mean of its parts; an entry
without parts stays. After the rounds the parts are assigned once more.

Per part two bounds are kept with the rows: an upper one of the distance to its entry, and a lower one of the distance to
the second nearest. When entries have moved, the upper bound grows by the move of its own entry and the lower one falls by
the largest move of any other. As long as upper < lower, or upper < half the way to the entry that is nearest to its own,
the assignment can't change, and no tie can have come up. Where that fails, the upper bound is made exact; where it fails
still, all entries are scanned in integers. Bounds are rounded away from each other, so they are never too tight.

Every round is two passes: rows with new codes and bounds are written to the shared folder (the ones before are deleted
then), and the sums of the parts of each entry are added up in the tasks and then over them. The driver sees the codebooks
only. No row is moved by its content, so equal vectors are no hot key.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do those of another length
than most (of the lengths that the parts divide) or with a component of 32,768 or more in size, whose squares don't add up
in longs; rows that repeat count each; a null id comes last among the ids, equal ids go by their vectors; with fewer rows
than entries there are as many entries as rows; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, removed, scratch
from .vectors import integers, matrix, summed

#: A table with a row per label is broadcast up to this many labels.
BROADCAST_ROWS = 100_000
SLACK = 1e-9


def nearest_two(x: np.ndarray, entries: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, squared distance, squared distance of the second nearest) of the nearest entry, all in integers."""
    best, own, second = (np.empty(len(x), np.int64) for _ in range(3))
    for at in range(0, len(x), rows):
        d = ((x[at : at + rows, None, :] - entries[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)  # the first of equal ones
        each = np.arange(len(d))
        best[at : at + rows], own[at : at + rows] = near, d[each, near]
        d[each, near] = np.iinfo(np.int64).max
        second[at : at + rows] = d.min(axis=1)
    return best, own, second


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


@dataclass
class Move:
    """From the entries of one part before a round to those after it."""

    entries: np.ndarray
    own: np.ndarray = field(init=False)
    others: np.ndarray = field(init=False)
    half: np.ndarray = field(init=False)
    before: np.ndarray | None = None

    def __post_init__(self) -> None:
        n = len(self.entries)
        self.own = np.zeros(n) if self.before is None else np.sqrt(((self.entries - self.before) ** 2).sum(axis=1).astype(float))
        self.others = np.array([np.delete(self.own, i).max(initial=0.0) for i in range(n)])
        apart = np.sqrt(((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2).astype(float))
        self.half = np.array([np.delete(apart[i], i).min(initial=np.inf) / 2 for i in range(n)])

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New (code, upper, lower) and how many parts were scanned."""
        code, upper, lower = code.copy(), up(upper + self.own[code]), down(lower - self.others[code])
        safe = np.maximum(lower, down(self.half)[code])
        open_ = np.flatnonzero(upper >= safe)
        upper[open_] = up(np.sqrt(((x[open_] - self.entries[code[open_]]) ** 2).sum(axis=1).astype(float)))
        open_ = open_[upper[open_] >= safe[open_]]
        if len(open_):
            code[open_], own, second = nearest_two(x[open_], self.entries)
            upper[open_], lower[open_] = up(np.sqrt(own.astype(float))), down(np.sqrt(second.astype(float)))
        return code, upper, lower, len(open_)


@dataclass
class Coded:
    """Rows with their codes, the final codebooks (part, entry, position), and the parts scanned in each assignment."""

    rows: DataFrame
    codebooks: np.ndarray
    scanned: list[int]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def _sums(parts: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        scanned = 0
        for batch in batches:
            if not len(batch):
                continue
            x, code = matrix(batch.column(0)), matrix(batch.column(1))
            x = x.reshape(len(x), parts, -1)
            total = np.zeros((parts, entries, 1 + x.shape[2]), np.int64) if total is None else total
            for p in range(parts):
                for e in np.unique(code[:, p]):
                    of = x[code[:, p] == e, p]
                    total[p, e, 0] += len(of)
                    total[p, e, 1:] += of.sum(axis=0)
            scanned += int(batch.column(2).to_numpy().sum())
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, total.size), pa.int64()), pa.array([scanned, *total.ravel().tolist()], pa.int64())], ["at", "value"])

    return run


def lloyd(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Coded | None:
    """The rows with (id, label, code, error) after ``rounds`` rounds and a last assignment; None if no row takes part."""
    spark = vectors.sparkSession
    rows = integers(vectors, [F.col(key).cast("long").alias("id"), F.col(label).alias("label")], vector, scale, 0, 32_768, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return None
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    entries, width = books.shape[1], books.shape[2]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = f"id long, label {kinds['label']}, x array<bigint>, code array<tinyint>, upper array<float>, lower array<float>, scanned int"

    def assigner(moves: list[Move], begin: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                ints = matrix(batch.column(2))
                x = ints.reshape(len(ints), parts, -1)
                if begin:  # no bounds yet: parts next to the first entry are told by the way to its neighbours, all others are scanned
                    code, upper, lower = np.zeros((len(x), parts), np.int64), np.full((len(x), parts), np.float32(np.inf)), np.zeros((len(x), parts), np.float32)
                else:
                    code, upper, lower = matrix(batch.column(3)), matrix(batch.column(4), np.float32), matrix(batch.column(5), np.float32)
                got = [m.assign(x[:, p], code[:, p], upper[:, p], lower[:, p]) for p, m in enumerate(moves)]
                code = np.stack([g[0] for g in got], axis=1)
                scanned = np.full(len(x), 0, np.int32)
                scanned[0] = sum(g[3] for g in got)
                if last:
                    error = sum(((x[:, p] - m.entries[code[:, p]]) ** 2).sum(axis=1) for p, m in enumerate(moves))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes().hex() for c in code.astype(np.uint8)]), pa.array(error), pa.array(scanned)], ["id", "label", "code", "error", "scanned"])
                else:
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), parts).cast(pa.list_(kind)) for a, kind in ((code.astype(np.int8), pa.int8()), (np.stack([g[1] for g in got], axis=1), pa.float32()), (np.stack([g[2] for g in got], axis=1), pa.float32()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, pa.array(scanned)], ["id", "label", "x", "code", "upper", "lower", "scanned"])

        return run

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        df.write.parquet(path := scratch(spark, "codes"))
        return spark.read.parquet(path), path

    moves, folder, scanned = [Move(b) for b in books], None, []
    for no in range(rounds):
        state, path = written(rows.mapInArrow(assigner(moves, no == 0, False), kept))
        if folder:
            removed(spark, folder)
        total = summed(state.select("x", "code", "scanned").mapInArrow(_sums(parts, entries), "at long, value long"), "decimal(38,0)")
        scanned.append(int(total[-1]))
        sums = [[[int(total[(p * entries + e) * (1 + width) + i]) for i in range(1 + width)] for e in range(entries)] for p in range(parts)]
        after = np.array([[[s // own[0] for s in own[1:]] if own[0] else books[p, e].tolist() for e, own in enumerate(of)] for p, of in enumerate(sums)], np.int64)
        moves, books, rows, folder = [Move(a, before=b) for a, b in zip(after, books, strict=True)], after, state, path
    done, _ = written(rows.mapInArrow(assigner(moves, not rounds, True), f"id long, label {kinds['label']}, code string, error long, scanned int"))
    if folder:
        removed(spark, folder)
    scanned.append(int(done.agg(F.sum("scanned")).first()[0]))
    return Coded(done.drop("scanned"), books, scanned)


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256); label_error is null if it is no long."""
    coded = lloyd(vectors, key, vector, label, parts, entries, rounds, scale)
    if coded is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` long, code string, error long, label_error long, codebooks_sha256 string")
    sums = checkpoint(coded.rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))  # with an exchange of its own the join can split a hot label
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    out = coded.rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))
