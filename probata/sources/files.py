"""Readers with schemas, report writers, file manifests and their reconciliation."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import places

#: Bytes of a file in a piece, at least, but for the last of a split.
PIECE_BYTES = 1 << 20
PIECES = pa.schema({"key": pa.string(), "size": pa.int64(), "start": pa.int64(), "i": pa.int64(), "n": pa.int64(), "body": pa.binary()})
BOM = codecs.BOM_UTF8
#: Numbers of files are broadcast up to this many.
BROADCAST_ROWS = 100_000


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and the given types; a row that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds a JSON list of records."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table as one CSV or JSON file."""
    out = df.coalesce(1).write.mode("overwrite")
    out.csv(path, header=True) if kind == "csv" else out.json(path, ignoreNullFields=False)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, size, start, i, n, body) of lines (key, size, start, value) of files, in their order: ``body`` has n bytes, compressed."""
    i, at, lines, held = 0, None, [], 0

    def piece() -> pa.RecordBatch:
        body = b"\n".join(lines) + b"\n"
        return pa.RecordBatch.from_pylist([{"key": at[0], "size": at[1], "start": at[2], "i": i, "n": len(body), "body": pa.compress(body, codec="zstd", asbytes=True)}], PIECES)

    for batch in batches:
        for *of, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if lines and (of != at or held >= PIECE_BYTES):
                yield piece()
                i, lines, held = i + 1, [], 0
            at = of
            lines.append(value)
            held += len(value) + 1
    if lines:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256) of files from their pieces in order. A reader of lines doesn't tell whether the last one ends with a break, nor a byte order mark ahead of the first: the size of the file does."""
    at, size, total, last, both = None, 0, 0, b"", ()

    def done() -> pa.RecordBatch:
        marked, open_end = {0: (0, 0), 1: (0, 1), -len(BOM): (1, 0), 1 - len(BOM): (1, 1)}[total - size]
        both[marked].update(last[: len(last) - open_end])
        return pa.RecordBatch.from_pylist([{"key": at, "sha256": both[marked].hexdigest()}])

    for batch in batches:
        for key, own, n, body in zip(*[c.to_pylist() for c in batch.select(["key", "size", "n", "body"]).columns], strict=True):
            if key != at:
                if at is not None:
                    yield done()
                at, size, total, last, both = key, own, 0, b"", (hashlib.sha256(), hashlib.sha256(BOM))
            for h in both:
                h.update(last)
            last, total = pa.decompress(body, n, codec="zstd", asbytes=True), total + n
    if at is not None:
        yield done()


def dealt(df: DataFrame, sizes: DataFrame, key: Sequence[str], size: str) -> DataFrame:
    """``df`` with the rows of a key in one partition, keys with the largest ``size`` in ``sizes`` (a row per key) in partitions of their own. No key is null."""
    n = sizes.count()
    parts = max(1, min(n, max(64, 4 * df.sparkSession.sparkContext.defaultParallelism)))
    own = places(sizes.select(*key, size), [F.desc(size), *key], out="__place").select(*key, ((F.col("__place") - 1) % parts).cast("int").alias("__part"))
    return df.join(F.broadcast(own) if n <= BROADCAST_ROWS else own, list(key)).repartitionById(parts, F.col("__part")).drop("__part")


def labelled_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, label, bytes, sha256) of the files in the folders under ``root``; the label is the folder's name.

    Files are read in splits and packed into compressed pieces. A hash goes byte by byte, so one task takes those of a file, in
    order and one at a time: no task holds a file or reads one as it is. Spark's readers pass over empty files.
    """
    own = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    key = F.col("_metadata.file_path").alias("key")
    files = spark.read.format("binaryFile").options(**own).load(root).select("path", "length", key)
    lines = spark.read.options(**own, lineSep="\n").text(root).select(key, F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    pieces = lines.mapInArrow(_packed, "key string, size long, start long, i long, n long, body binary")
    hashes = dealt(pieces, files, ["key"], "length").sortWithinPartitions("key", "start", "i").mapInArrow(_hashed, "key string, sha256 string")
    found = files.join(hashes, "key", "left")
    return found.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), F.col("length").alias("bytes"), F.coalesce("sha256", F.lit(hashlib.sha256(BOM).hexdigest())).alias("sha256"))  # no line but a size: a mark alone


def sums(files: DataFrame) -> DataFrame:
    """(line): the lines of a SHA256SUMS file, by name."""
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.select(F.concat_ws("  ", "sha256", name).alias("line"))


def reconcile(listed: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): ok, mismatch, missing (listed only) or extra (found only) of two tables of hashes."""
    a, b = listed.select(key, F.col(value).alias("__a")), found.select(key, F.col(value).alias("__b"))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a") == F.col("__b"), "ok").otherwise("mismatch")
    return a.join(b, key, "full").select(key, status.alias("status"))


def safe_path(path: str | Column) -> Column:
    """Whether a path is relative and has no step up."""
    p = F.col(path) if isinstance(path, str) else path
    return p.isNotNull() & (p != "") & ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")
