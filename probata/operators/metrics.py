"""Metrics of classifiers as aggregates: confusion, report, ranks, calibration, decision curves.

Inputs have a true class ``y`` (0 to k - 1), and a vector ``p`` or a prediction ``pred``. Undefined ratios are null, but
for precision, recall and F1, which are 0. Running sums over scores are those of ranges of the sorted rows, so a metric
over all rows needs no single partition, wherever the scores crowd.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probs import argmax, clipped, onehot, top, total
from .ranks import prefix_sums, quantiles

#: Bounds of the log loss: the machine epsilon.
EPS = 2.220446049250313e-16


def confusion(df: DataFrame, k: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """(y, pred, n) for all k * k cells."""
    grid = df.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("y"), (F.col("id") % k).cast("int").alias("pred"))
    cells = df.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(cells, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def row_percent(cells: DataFrame) -> DataFrame:
    """(y, pred, percent): cells over their row's sum, which counts as 1 at least."""
    row = F.sum("n").over(Window.partitionBy("y"))
    return cells.select("y", "pred", (F.col("n") * 100.0 / F.greatest(row, F.lit(1))).alias("percent"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """(y, support, predicted, hits, precision, recall, f1) from a confusion table."""
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), "n", F.lit(0).cast("long").alias("m"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m"), F.lit(0).cast("long").alias("h")))).alias("s")).select("s.*")
    s = sides.groupBy(F.col("c").alias("y")).agg(F.sum("n").alias("support"), F.sum("m").alias("predicted"), F.sum("h").alias("hits"))
    s = s.withColumn("precision", _ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", _ratio(F.col("hits"), F.col("support")))
    return s.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): a row per class, then accuracy, macro avg and weighted avg."""
    c = per_class(cells)
    n = F.sum("support")
    rows = c.select(F.col("y").cast("string").alias("label"), "precision", "recall", "f1", "support")
    acc = c.agg((F.sum("hits") / n).alias("a"), n.alias("n")).select(F.lit("accuracy").alias("label"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), F.col("n").alias("support"))
    macro = c.agg(F.avg("precision"), F.avg("recall"), F.avg("f1"), n).toDF("precision", "recall", "f1", "support").select(F.lit("macro avg").alias("label"), "*")
    w = lambda x: F.sum(F.col(x) * F.col("support")) / n
    weighted = c.agg(w("precision"), w("recall"), w("f1"), n).toDF("precision", "recall", "f1", "support").select(F.lit("weighted avg").alias("label"), "*")
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def summary(cells: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy, macro_precision, macro_recall, macro_f1 and mcc, in one row."""
    s = per_class(cells).agg(
        F.sum("support").cast("double").alias("n"),
        F.sum("hits").cast("double").alias("c"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
    )
    below = F.sqrt(F.col("n") * F.col("n") - F.col("pp")) * F.sqrt(F.col("n") * F.col("n") - F.col("tt"))
    mcc = F.coalesce(F.try_divide(F.col("c") * F.col("n") - F.col("tp"), below), F.lit(0.0))
    return s.select(F.try_divide("c", "n").alias("accuracy"), "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", mcc.alias("mcc"))


def log_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    own = F.element_at(p, F.col(y).cast("int") + 1)
    return df.agg(F.avg(-F.ln(F.least(clipped(own, EPS), F.lit(1 - EPS)))).alias("log_loss"))


def scored(df: DataFrame, k: int, y: str = "y", p: str = "p") -> DataFrame:
    """(c, score, hit): every row once per class."""
    return df.select(F.posexplode(p).alias("c", "score"), F.col(y).alias("y")).where(F.col("c") < k).select("c", "score", (F.col("c") == F.col("y")).cast("int").alias("hit"))


def running(points: DataFrame, group: str = "c", score: str = "score") -> DataFrame:
    """(group, score, pos, neg) of distinct scores, with pos_above and neg_above: what scores higher."""
    d = points.groupBy(group, score).agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    d = prefix_sums(d, [F.desc(score)], ["pos", "neg"], group)
    return d.select(group, score, "pos", "neg", F.col("pos_before").alias("pos_above"), F.col("neg_before").alias("neg_above"))


def auc(points: DataFrame, group: str = "c", score: str = "score") -> DataFrame:
    """(group, auc): share of (hit, miss) pairs that the scores order rightly, ties counting half."""
    r = running(points, group, score)
    won = F.sum(F.col("neg").cast("double") * F.col("pos_above") + F.col("neg").cast("double") * F.col("pos") / 2)
    return r.groupBy(group).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def average_precision(points: DataFrame, group: str = "c", score: str = "score") -> DataFrame:
    """(group, ap): sum of recall steps times precision, tied scores as one step."""
    r = running(points, group, score)
    at = F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg"))
    return r.groupBy(group).agg(F.try_divide(F.sum(at), F.sum("pos")).alias("ap"))


def roc(points: DataFrame, group: str = "c", score: str = "score") -> DataFrame:
    """(group, score, fpr, tpr) at every distinct score."""
    r = running(points, group, score)
    total = points.groupBy(F.col(group).alias("__g")).agg(F.sum("hit").alias("__pos"), F.sum(1 - F.col("hit")).alias("__neg"))
    r = r.join(F.broadcast(total), F.col(group).eqNullSafe(F.col("__g")))  # a row per class
    return r.select(group, score, F.try_divide(F.col("neg_above") + F.col("neg"), F.col("__neg")).alias("fpr"), F.try_divide(F.col("pos_above") + F.col("pos"), F.col("__pos")).alias("tpr"))


def brier(df: DataFrame, k: int, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.avg(total(F.zip_with(p, onehot(y, k), lambda a, b: (a - b) * (a - b)))).alias("brier"))


def calibration(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(bin, lower, upper, n, accuracy, mean_confidence) of the bins with rows; bins are equally wide, the last one is closed."""
    width = 1.0 / bins
    conf = top(p)
    guess = F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")
    # an edge is i * width in doubles, which the product above can miss by one bin
    place = F.when(conf < guess * F.lit(width), guess - 1).when((guess < bins - 1) & (conf >= (guess + 1) * F.lit(width)), guess + 1).otherwise(guess)
    d = df.select(place.alias("bin"), conf.alias("conf"), (argmax(p) == F.col(y)).cast("double").alias("ok"))
    d = d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"), F.avg("conf").alias("mean_confidence"))
    return d.select("bin", (F.col("bin") * F.lit(width)).alias("lower"), ((F.col("bin") + 1) * F.lit(width)).alias("upper"), "n", "accuracy", "mean_confidence")


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error from a calibration table."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def quantile_calibration(points: DataFrame, bins: int, group: str = "c") -> DataFrame:
    """(group, bin, n, mean_score, share) with edges at the quantiles of the scores; bins are open above, but the last."""
    edges = quantiles(points, "score", [i / bins for i in range(1, bins)], group).withColumnRenamed("q", "edges")
    d = points.join(F.broadcast(edges), group).withColumn("bin", F.size(F.filter("edges", lambda e: F.col("score") >= e)))
    return d.groupBy(group, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("hit").alias("share"))


def binary_sweep(df: DataFrame, thresholds: Sequence[float], score: str = "score", truth: str = "truth") -> DataFrame:
    """(threshold, tp, fn, tn, fp, accuracy, sensitivity, specificity, precision, f1), one scan for all thresholds."""
    d = df.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), (F.col(truth) == 1).alias("t"), F.col(score).alias("s"))
    d = d.withColumn("on", F.col("s") >= F.col("threshold"))
    count = lambda c: F.count_if(c).cast("long")
    d = d.groupBy("threshold").agg(count(F.col("t") & F.col("on")).alias("tp"), count(F.col("t") & ~F.col("on")).alias("fn"), count(~F.col("t") & ~F.col("on")).alias("tn"), count(~F.col("t") & F.col("on")).alias("fp"))
    tp, fn, tn, fp = map(F.col, ("tp", "fn", "tn", "fp"))
    return d.select("*", F.try_divide(tp + tn, tp + fn + tn + fp).alias("accuracy"), F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"), _ratio(tp, tp + fp).alias("precision"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def net_benefit(sweep: DataFrame) -> DataFrame:
    """(threshold, model, treat_all, treat_none): net benefit of a decision curve, from a binary sweep."""
    n = F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    odds = F.col("threshold") / (F.lit(1.0) - F.col("threshold"))
    all_ = (F.col("tp") + F.col("fn")) / n - (F.col("tn") + F.col("fp")) / n * odds
    return sweep.select("threshold", (F.col("tp") / n - F.col("fp") / n * odds).alias("model"), all_.alias("treat_all"), F.lit(0.0).alias("treat_none"))


def moments(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, population deviation, quantiles, skewness and excess kurtosis of a column."""
    d = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))
    q = quantiles(df, value, (0.05, 0.25, 0.5, 0.75, 0.95), *by)
    d = d.join(q, list(by), "left") if by else d.join(q, how="cross")
    return d.select(*by, "mean", "std", *[F.col("q")[i].alias(f"p{x}") for i, x in enumerate(("05", "25", "50", "75", "95"))], "skew", "kurtosis")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by, bin, share): normalised histogram of equally wide bins; what lies outside is not counted."""
    v = F.col(value).cast("double")
    place = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    d = df.where((v >= low) & (v <= high)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return d.select(*by, "bin", (F.col("n") / F.sum("n").over(every)).alias("share"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, mean, std): vectors of means and population deviations per class."""
    d = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    d = d.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("x"))
    return d.select("label", F.col("x.m").alias("mean"), F.col("x.s").alias("std"))
