"""Queries on streams that keep state: monitoring of predictions, late counts, bookings that are accepted or rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probs as P
from ..streaming import monitor as MO
from ..streaming import stateful as SF
from ..streaming import stream as ST
from .adapters import K, PREDS, predictions
from .lakehouse import BRONZE, bronze
from .registry import query, table

BINS, PIECES = 10, 3


def arriving(df: DataFrame, order: str, pieces: int = PIECES) -> list[DataFrame]:
    """``df`` cut into as many ranges of ``order``, in that order."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = ((ends.hi or 0) - (ends.lo or 0)) // pieces + 1
    piece = F.floor((F.col(order) - (ends.lo or 0)) / width)
    return [df.where(piece == i) for i in range(pieces)]


#: Every vector is a prediction, one each 15 minutes, and every third day comes from the other branch. One in four has no
#: confirmed class yet, and the 8th of each 50 arrives two days late.
TIMED = f"timed AS (SELECT id, TIMESTAMP '2024-01-01' + to_minutes(15 * id) AS ts, CASE WHEN id // 96 % 3 < 2 THEN pred_a ELSE pred_b END AS class, CASE WHEN id // 96 % 3 < 2 THEN conf_a ELSE conf_b END AS c, CASE WHEN id % 4 <> 3 THEN y END AS y FROM preds)"


def timed(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d)
    p = F.when(F.floor(F.col("id") / 96) % 3 < 2, F.col("pa")).otherwise(F.col("pb"))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 900)
    x = x.select("id", ts.alias("ts"), p.alias("p"), F.when(F.col("id") % 4 != 3, F.col("y")).alias("y"))
    return x.withColumns({"review": P.top("p") < 0.6, "arrival": F.col("id") + F.when(F.col("id") % 50 == 7, 192).otherwise(0)})


MONITOR = f"""
WITH {PREDS}, {TIMED},
t AS (SELECT *, date_trunc('day', ts) AS start, CAST(least(floor(c * {BINS}), {BINS - 1}) AS INTEGER) AS bin FROM timed),
g AS (SELECT start, bin, abs(sum(CASE WHEN y IS NOT NULL THEN c - CASE WHEN y = class THEN 1 ELSE 0 END ELSE 0 END)) AS gap FROM t GROUP BY start, bin),
e AS (SELECT start, sum(gap) AS gap FROM g GROUP BY start),
f AS (SELECT start, CAST(count(*) AS BIGINT) AS n, avg(c) AS confidence, avg(CASE WHEN c < 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS review_share, CAST(count(y) AS BIGINT) AS known,
    {", ".join(f"count(CASE WHEN class = {i} THEN 1 END) / count(*)::DOUBLE AS s{i}" for i in range(K))}, {", ".join(f"count(CASE WHEN bin = {i} THEN 1 END) / count(*)::DOUBLE AS b{i}" for i in range(BINS))}
    FROM t GROUP BY start),
a AS (SELECT f.*, CASE WHEN known > 0 THEN gap / known END AS ece FROM f JOIN e USING (start)),
z AS (SELECT * FROM a ORDER BY start LIMIT 1)
SELECT strftime(a.start, '%Y-%m-%d') AS day, a.n, a.known, round(a.confidence, 9) AS confidence, round(a.review_share, 9) AS review_share, round(a.ece, 9) AS ece, {", ".join(f"round(a.s{i}, 9) AS share_{i}" for i in range(K))},
    round({" + ".join(f"(greatest(a.s{i}, 1e-6) - greatest(z.s{i}, 1e-6)) * ln(greatest(a.s{i}, 1e-6) / greatest(z.s{i}, 1e-6))" for i in range(K))}, 9) AS class_psi,
    round({" + ".join(f"(greatest(a.b{i}, 1e-6) - greatest(z.b{i}, 1e-6)) * ln(greatest(a.b{i}, 1e-6) / greatest(z.b{i}, 1e-6))" for i in range(BINS))}, 9) AS confidence_psi,
    round(a.confidence - z.confidence, 9) AS confidence_change, round(a.review_share - z.review_share, 9) AS review_change, round(a.ece - z.ece, 9) AS ece_change
FROM a, z WHERE a.start + INTERVAL 1 DAY <= (SELECT max(ts) FROM timed) - INTERVAL 3 DAY
"""


@query("st_monitor", MONITOR)
def st_monitor(spark, d):
    """Daily figures of the predictions of a stream and their drift against the first day, for the days that the watermark has closed."""
    x = timed(spark, d)
    cells = ST.fed(arriving(x, "arrival"), lambda s: MO.cells(s, "ts", "p", "y", "review", K, "1 day", "3 days", BINS), what="monitor")
    m = MO.monitored(cells, K, BINS)
    figures = ["confidence", "review_share", "ece", "class_psi", "confidence_psi", "confidence_change", "review_change", "ece_change"]
    return m.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "known", *[F.round(c, 9).alias(c) for c in figures], *[F.round(F.col("class_shares")[i], 9).alias(f"share_{i}") for i in range(K)])


@query("st_late_stream", f"WITH {BRONZE}, o AS (SELECT event_type, ts, max(ts) OVER (PARTITION BY event_type ORDER BY event_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM bronze) SELECT event_type, count(*) AS n, count_if(ts < seen - INTERVAL 1 HOUR) AS late FROM o GROUP BY event_type")
def st_late_stream(spark, d):
    """Rows of each type that come over an hour behind the newest of it, counted across the triggers of a stream."""
    b = bronze(spark, d).withColumn("place", 2 * F.col("event_id") + F.col("copy"))
    with SF.rocksdb(spark):
        s = ST.fed(arriving(b, "place"), lambda x: SF.late_counts(x, "event_type", "ts", "place", 3600), "update", "late")
    return s.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("late", "batch").alias("late"))


@query("st_slot_booking", "WITH s AS (SELECT user_id % 20 AS resource, date_trunc('hour', ts) AS slot, event_id FROM events WHERE hour(ts) BETWEEN 9 AND 22), w AS (SELECT *, min(event_id) OVER (PARTITION BY resource, slot) AS holder FROM s) SELECT resource, strftime(slot, '%Y-%m-%d %H') AS slot, event_id AS booking, event_id = holder AS accepted, holder FROM w")
def st_slot_booking(spark, d):
    """The first booking of each resource's hour is accepted, later ones are rejected, as they come in by a stream."""
    e = table(spark, d, "events").where(F.hour("ts").between(9, 22))
    e = e.select((F.col("user_id") % 20).alias("resource"), F.date_trunc("hour", "ts").alias("slot"), "event_id")
    with SF.rocksdb(spark):
        s = ST.fed(arriving(e, "event_id"), lambda x: SF.bookings(x, "resource", "slot", "event_id"), what="bookings")
    return s.select("resource", F.date_format("slot", "yyyy-MM-dd HH").alias("slot"), "booking", "accepted", "holder")
