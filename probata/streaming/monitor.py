"""Monitoring of a model by event-time windows: what it predicts, how sure it is, what it sends to review, how well it is calibrated.

The stream keeps, per window, a histogram over predicted class and confidence bin with sums in its cells. Histograms
merge by adding, so partial ones are made before the shuffle and kept as state until the watermark closes the window;
state is windows that are open x classes x bins, however many rows there are. Figures of a closed window follow from its
cells, and drift from a comparison with those of a reference window.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P


def cells(df: DataFrame, ts: str, p: str, y: str, review: str, classes: int, width: str, delay: str, bins: int = 10) -> DataFrame:
    """(start, class, bin, n, confidence, reviewed, known, hits, known_confidence) per window, class and confidence bin.

    ``y`` is the confirmed class or null where there is none yet, ``review`` whether a person saw the row. Rows without a time
    or a valid vector are left out (they are the quarantine's); a null ``review`` counts as none. Of a stream, rows behind the
    watermark are dropped by Spark; of a table, all windows are there.
    """
    d = df.where(F.col(ts).isNotNull() & P.invalid_reason(p, classes).isNull())
    d = d.withWatermark(ts, delay) if df.isStreaming else d
    d = d.select(F.col(ts).alias("ts"), P.argmax(p).alias("class"), P.top(p).alias("c"), F.col(y).alias("y"), F.coalesce(F.col(review), F.lit(False)).cast("int").alias("r"))
    d = d.withColumns({"bin": F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).cast("int"), "k": F.col("y").isNotNull().cast("int")})
    d = d.groupBy(F.window("ts", width).alias("w"), "class", "bin").agg(
        F.count("*").alias("n"), F.sum("c").alias("confidence"), F.sum("r").alias("reviewed"), F.sum("k").alias("known"),
        F.sum((F.col("y") == F.col("class")).cast("int")).alias("hits"), F.sum(F.col("c") * F.col("k")).alias("known_confidence"),
    )
    return d.select(F.col("w.start").alias("start"), *[c for c in d.columns if c != "w"])


def shares(column: str, key: str, size: int) -> Column:
    """Sums of ``column`` by ``key`` (0 to size - 1) over that of all, as an array."""
    return F.array(*[F.sum(F.when(F.col(key) == i, F.col(column)).otherwise(0)) / F.sum(column) for i in range(size)])


def stability(a: str, b: str, guard: float = 1e-6) -> Column:
    """Population stability index of two arrays of shares."""
    at = lambda x: F.greatest(x, F.lit(guard))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (at(x) - at(y)) * F.ln(at(x) / at(y))), F.lit(0.0), lambda s, v: s + v)


def figures(histograms: DataFrame, classes: int, bins: int = 10) -> DataFrame:
    """(start, n, class_shares, bin_shares, confidence, review_share, known, ece) per window; ece is null without confirmed rows."""
    gap = F.array(*[F.abs(F.sum(F.when(F.col("bin") == i, F.coalesce("known_confidence", F.lit(0.0)) - F.coalesce("hits", F.lit(0))).otherwise(0.0))) for i in range(bins)])
    g = histograms.groupBy("start").agg(
        F.sum("n").alias("n"), shares("n", "class", classes).alias("class_shares"), shares("n", "bin", bins).alias("bin_shares"), F.sum("confidence").alias("c"),
        F.sum("reviewed").alias("r"), F.sum("known").alias("known"), gap.alias("gap"),
    )
    ece = F.when(F.col("known") > 0, F.aggregate("gap", F.lit(0.0), lambda s, v: s + v) / F.col("known"))
    return g.select("start", "n", "class_shares", "bin_shares", (F.col("c") / F.col("n")).alias("confidence"), (F.col("r") / F.col("n")).alias("review_share"), "known", ece.alias("ece"))


def monitored(histograms: DataFrame, classes: int, bins: int = 10, reference: datetime | None = None) -> DataFrame:
    """``figures`` with class_psi, confidence_psi, confidence_change, review_change and ece_change against the window that starts at
    ``reference`` (the first one if None). Empty if there is no such window."""
    f = figures(histograms, classes, bins)
    first = f.orderBy("start").limit(1) if reference is None else f.where(F.col("start") == F.lit(reference))
    first = first.select(*[F.col(c).alias(f"{c}_0") for c in ("class_shares", "bin_shares", "confidence", "review_share", "ece")])
    m = f.crossJoin(F.broadcast(first))  # one row
    changes = [(F.col(c) - F.col(f"{c}_0")).alias(f"{n}_change") for c, n in (("confidence", "confidence"), ("review_share", "review"), ("ece", "ece"))]
    return m.select(*f.columns, stability("class_shares", "class_shares_0").alias("class_psi"), stability("bin_shares", "bin_shares_0").alias("confidence_psi"), *changes)
