"""Operators that keep state of their own across triggers: late counts and bookings, in RocksDB.

Rows of a trigger are taken in the order of a column; across triggers they are taken as they come. What a task holds of a key
is one trigger's rows in the few columns that are needed, so a trigger's size bounds it however many rows a key has in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class LateCounts(StatefulProcessor):
    """Per key the newest time so far (microseconds), the rows and how many of them came too far behind it."""

    def __init__(self, by: str, allowed: int) -> None:
        self.by, self.allowed = by, allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "newest long, n long, late long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, n, late = self.seen.get() if self.seen.exists() else (None, 0, 0)
        own = pd.concat(list(rows))
        n += len(own)
        times = own.sort_values("place", kind="stable")["micros"].dropna().astype("int64")
        if len(times):
            before = times.cummax().shift(1)
            if newest is not None:
                before = before.fillna(newest).clip(lower=newest)
            late += int((times < before - self.allowed).sum())
            newest = max(int(times.max()), newest) if newest is not None else int(times.max())
        self.seen.update((newest, n, late))
        yield pd.DataFrame({self.by: [key[0]], "n": [n], "late": [late]})


def late_counts(df: DataFrame, by: str, ts: str, order: str, allowed_seconds: int) -> DataFrame:
    """(by, n, late) so far, per trigger: rows that come more than ``allowed_seconds`` behind the newest of their key before them.

    Keys are strings, a null key is one of its own; rows without a time count and are never late. Needs RocksDB.
    """
    rows = df.select(F.col(by).cast("string").alias(by), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(order).alias("place"))
    return rows.groupBy(by).transformWithStateInPandas(LateCounts(by, allowed_seconds * 1_000_000), f"`{by}` string, n long, late long", "update", "none")


class Bookings(StatefulProcessor):
    """Per resource and day: which booking holds each slot. The first one that comes is accepted, all later ones are rejected."""

    def __init__(self, horizon_ms: int) -> None:
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot long", "booking long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values("booking", kind="stable")
        held = {slot[0]: holder[0] for slot, holder in self.held.iterator()}
        fresh = not held
        holders, accepted = [], []
        for slot, booking in zip(own["slot_ms"].tolist(), own["booking"].tolist(), strict=True):
            if slot not in held:
                held[slot] = booking
                self.held.updateValue((slot,), (booking,))
                accepted.append(True)
            else:
                accepted.append(False)
            holders.append(held[slot])
        if fresh:  # all slots of the key are of one day
            self.handle.registerTimer(int(own["day_ms"].iloc[0]) + self.horizon_ms)
        yield own.assign(accepted=accepted, holder=holders)[["resource", "slot", "booking", "accepted", "holder"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame({"resource": pd.Series(dtype="int64"), "slot": pd.Series(dtype="datetime64[us]"), "booking": pd.Series(dtype="int64"), "accepted": pd.Series(dtype=bool), "holder": pd.Series(dtype="int64")})


def bookings(df: DataFrame, resource: str, slot: str, booking: str, delay: str = "7 days", horizon_hours: int = 48) -> DataFrame:
    """(resource, slot, booking, accepted, holder) of every booking once: the first of a slot holds it, the others are rejected.

    Of those of one trigger the least booking number comes first. The state of a resource's day ends when the watermark
    (the newest slot less ``delay``) is ``horizon_hours`` past the day's beginning; bookings of slots behind the watermark are
    dropped by Spark, so none can be accepted anew. Bookings without a resource, slot or number are left out. Needs RocksDB.
    """
    rows = df.select(F.col(resource).cast("long").alias("resource"), F.col(slot).cast("timestamp").alias("slot"), F.col(booking).cast("long").alias("booking")).where("resource IS NOT NULL AND slot IS NOT NULL AND booking IS NOT NULL")
    rows = rows.withWatermark("slot", delay).withColumns({"slot_ms": F.unix_millis("slot"), "day_ms": F.unix_millis(F.date_trunc("day", "slot"))})
    return rows.groupBy("resource", "day_ms").transformWithStateInPandas(Bookings(horizon_hours * 3_600_000), "resource long, slot timestamp, booking long, accepted boolean, holder long", "append", "eventTime")
