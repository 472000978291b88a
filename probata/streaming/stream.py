"""Structured Streaming forms: the lake's expressions on a file stream, run until what is there is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


Transform = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, path: str, files: int = 2) -> DataFrame:
    """The Parquet files under ``path`` as a stream, ``files`` a trigger."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(df: DataFrame, mode: str = "append", what: str = "stream") -> DataFrame:
    """Run the stream over all that is there and read what it wrote to a Parquet sink."""
    spark, out, state = df.sparkSession, scratch(df.sparkSession, what), scratch(df.sparkSession, f"{what}-state")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    else:
        # every trigger's rows, with its number: the last per key is the result
        by_number(df, mode, out, state)
    return spark.read.parquet(out)


def by_number(df: DataFrame, mode: str, out: str, state: str) -> None:
    """Run the stream over what is new since ``state``, each trigger's rows in a folder with its number, so a repeated trigger replaces its own."""
    df.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def fed(pieces: list[DataFrame], transform: Transform, mode: str = "append", what: str = "fed") -> DataFrame:
    """Let ``pieces`` arrive one after the other, and start the stream anew from its checkpoint after each; all it wrote, with ``batch``."""
    spark = pieces[0].sparkSession
    path, out, state = (scratch(spark, f"{what}-{part}") for part in ("in", "out", "state"))
    for piece in pieces:
        piece.write.mode("append").parquet(path)
        by_number(transform(spark.readStream.schema(piece.schema).parquet(path)), mode, out, state)
    return spark.read.parquet(out)


def route(df: DataFrame, silver: str, quarantine: str, record: Callable[[DataFrame], DataFrame] = lambda bad: bad) -> None:
    """Rows with ``reason`` null to ``silver``, ``record`` of the others to ``quarantine``, each trigger written once per sink and batch number."""
    state = scratch(df.sparkSession, "route-state")

    def write(batch: DataFrame, i: int) -> None:
        batch = batch.persist()
        batch.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{silver}/batch={i}")
        record(batch.where("reason is not null")).write.mode("overwrite").parquet(f"{quarantine}/batch={i}")
        batch.unpersist()

    df.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def deduplicated(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def freshness(df: DataFrame, ts: str, *by: str) -> DataFrame:
    """(by, last) per trigger: the newest event time so far, from which the lag follows."""
    return df.groupBy(*by).agg(F.max(ts).alias("last"))


def tumbling(df: DataFrame, ts: str, width: str, delay: str, *by: str) -> DataFrame:
    """(start, by, n, total) per window of event time; late rows beyond the watermark are dropped by Spark."""
    d = df.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("start"), *by, "n", "total")


def checked_transitions(df: DataFrame, key: str, order: str, state: str, legal: set[tuple[str, str]]) -> DataFrame:
    """(key, steps, illegal) so far, per trigger: the last state of each key is kept, rows of a trigger are taken in order.

    Files have to arrive in the order of ``order``: a row that comes in a later trigger than its successor is judged as the step after what the key has last.
    """

    def step(k: tuple, rows: Iterator[pd.DataFrame], own: GroupState) -> Iterator[pd.DataFrame]:
        last, steps, bad = own.get if own.exists else ("", 0, 0)
        for s in pd.concat(list(rows)).sort_values(order)[state]:
            steps, bad, last = steps + 1, bad + ((last, s) not in legal), s
        own.update((last, steps, bad))
        yield pd.DataFrame({key: [k[0]], "steps": [steps], "illegal": [bad]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} long, steps long, illegal long", "last string, steps long, bad long", "update", GroupStateTimeout.NoTimeout)


def parity(spark: SparkSession, path: str, transform: Transform) -> tuple[DataFrame, DataFrame]:
    """The same row-wise transform over a folder as a batch and as a stream."""
    return transform(spark.read.parquet(path)), drain(transform(file_stream(spark, path)), what="parity")
