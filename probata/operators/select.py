"""Model selection: temperature, ensemble weights, mixtures, lexicographic choice, candidates by distance, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probs import argmax, mixture, temperature
from .ranks import places


def fit_temperature(df: DataFrame, y: str, p: str, low: float = 0.25, high: float = 4.0, points: int = 33, rounds: int = 4) -> float:
    """The temperature with the least mean log loss, on a grid that zooms in around the best point; one job a round."""
    a, b = low, high
    for _ in range(rounds):
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        t = df.select(F.explode(F.array(*map(F.lit, grid))).alias("t"), F.col(y).alias("y"), F.col(p).alias("p"))
        loss = t.select("t", (-F.ln(F.greatest(F.element_at(temperature("p", F.col("t")), F.col("y").cast("int") + 1), F.lit(1e-300)))).alias("l"))
        best = loss.groupBy("t").agg(F.round(F.avg("l"), 12).alias("l")).agg(F.min_by("t", F.struct("l", "t"))).first()[0]
        if best is None:
            return 1.0
        step = (b - a) / (points - 1)
        a, b = max(low, best - step), min(high, best + step)
    return best


def weights(df: DataFrame, score: str, power: float = 1.0, floor: float = 0.01) -> Column:
    """greatest(score, floor) ** power over its sum over all rows (a row per model)."""
    w = F.pow(F.greatest(F.col(score), F.lit(floor)), F.lit(power))
    return w / F.sum(w).over(Window.partitionBy())


def best(df: DataFrame, keys: Sequence[Column], *by: str) -> DataFrame:
    """The row (per ``by``) that is first in the order of ``keys``: sort expressions, the last of which settles ties."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("__r = 1").drop("__r")


def mixture_sweep(df: DataFrame, steps: int = 21) -> DataFrame:
    """(w, n, hits, loss) of pa * w + pb * (1 - w) over a grid of weights, in one scan of rows (y, pa, pb)."""
    d = df.select("y", "pa", "pb", F.explode(F.array(*[F.lit(i / (steps - 1)) for i in range(steps)])).alias("w"))
    d = d.withColumn("p", mixture([(F.col("w"), "pa"), (F.lit(1.0) - F.col("w"), "pb")]))
    loss = -F.ln(F.greatest(F.element_at("p", F.col("y").cast("int") + 1), F.lit(1e-12)))
    return d.groupBy("w").agg(F.count("*").alias("n"), F.count_if(argmax("p") == F.col("y")).alias("hits"), F.avg(loss).alias("loss"))


def nearest_share(df: DataFrame, label: str, distance: str, id: str, share: float) -> DataFrame:
    """Per label the round(n * share) rows (half to even) of least distance."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    d = places(df, [distance, id], label, out="__r").join(n, label)
    return d.where(F.col("__r") <= F.bround(F.col("__n") * F.lit(share))).drop("__r", "__n")


def standard_distance(vector: str, mean: str, std: str, guard: float = 1e-3) -> Column:
    """Mean squared distance to a centre in units of std + guard."""
    z = F.transform(F.arrays_zip(F.col(vector).alias("v"), F.col(mean).alias("m"), F.col(std).alias("s")), lambda x: (x["v"].cast("double") - x["m"]) / (x["s"] + guard))
    return F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x) / F.size(vector)


def early_stop(history: DataFrame, run: str, epoch: str, score: str, patience: int = 6, least: int = 10, delta: float = 1e-6) -> DataFrame:
    """(run, best_epoch, best, stop_epoch): the last improvement by more than ``delta``, and where training stops.

    Training stops at the first epoch from ``least`` on that lies ``patience`` epochs after the last improvement.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("up", before.isNull() | (F.col(score) > before + delta))
    h = h.withColumn("last", F.max(F.when(F.col("up"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when((F.col(epoch) >= least) & (F.col(epoch) - F.col("last") >= patience), F.col(epoch)))
    s = h.groupBy(run).agg(F.coalesce(stop, F.max(epoch)).alias("stop_epoch"))
    done = h.join(s, run).where((F.col(epoch) <= F.col("stop_epoch")) & F.col("up"))
    return done.groupBy(run, "stop_epoch").agg(F.max(epoch).alias("best_epoch"), F.max_by(score, epoch).alias("best")).select(run, "best_epoch", "best", "stop_epoch")


def accepted(pool: DataFrame, train: DataFrame, id: str, content: str, holds: Column) -> DataFrame:
    """The rows of ``pool`` that may get a pseudo label: ``holds`` is true, the content is readable (not null, nor with a null or
    non-finite part), no row of ``train`` has the same content, and of equal contents that are accepted the least id is taken.

    Contents are compared as they are. Each side is reduced to one row a content before it is joined.
    """
    v = F.col(content).cast("array<double>")
    readable = F.col(content).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = pool.where(F.coalesce(holds, F.lit(False)) & F.coalesce(readable, F.lit(False)))
    known = train.where(F.col(content).isNotNull()).select(F.col(content).alias("__known")).distinct()
    rows = rows.groupBy(content).agg(F.min_by(F.struct(*[F.col(c) for c in pool.columns if c != content]), id).alias("__row"))
    return rows.join(known, F.col(content) == F.col("__known"), "left_anti").select("__row.*", content).select(*pool.columns)
