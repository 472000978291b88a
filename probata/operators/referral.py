"""Selective referral: what a mask retains, by rule, by class, over thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import places


def totals(df: DataFrame, *by: str) -> DataFrame:
    """(by, n, retained_n, coverage, retained_accuracy, errors_total, errors_referred, error_capture) of rows (ok, retained)."""
    ok, kept = F.col("ok"), F.col("retained")
    d = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(kept).alias("retained_n"), F.count_if(kept & ok).alias("hits"), F.count_if(~ok).alias("errors_total"), F.count_if(~ok & ~kept).alias("errors_referred"))
    return d.select(*by, "n", "retained_n", F.try_divide("retained_n", "n").alias("coverage"), F.try_divide("hits", "retained_n").alias("retained_accuracy"), "errors_total", "errors_referred", F.try_divide("errors_referred", "errors_total").alias("error_capture"))


def by_class(df: DataFrame, *by: str) -> DataFrame:
    """Support, retained, referred, sensitivity and accuracy by true class; precision by predicted class, of rows (y, pred, retained)."""
    sides = df.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(True).alias("truth")), F.struct(F.col("pred").alias("c"), F.lit(False).alias("truth")))).alias("s"), (F.col("y") == F.col("pred")).alias("ok"), "retained").select(*by, "s.*", "ok", "retained")
    t, kept, ok = F.col("truth"), F.col("retained"), F.col("ok")
    d = sides.groupBy(*by, "c").agg(F.count_if(t).alias("support"), F.count_if(t & kept).alias("retained"), F.count_if(t & kept & ok).alias("hits"), F.count_if(t & ~ok).alias("errors"), F.count_if(t & ~ok & ~kept).alias("errors_referred"), F.count_if(~t & kept).alias("predicted"))
    return d.select(
        *by, "c", "support", "retained", (F.col("support") - F.col("retained")).alias("referred"), F.try_divide("retained", "support").alias("retained_fraction"),
        F.try_divide("hits", "support").alias("auto_correct_sensitivity"), F.try_divide("hits", "retained").alias("retained_case_accuracy"),
        F.try_divide("hits", "predicted").alias("retained_precision"), "hits", "errors", "errors_referred", F.try_divide("errors_referred", "errors").alias("error_capture"),
    )


def curve(df: DataFrame, thresholds: Sequence[float], rules: dict[str, Column]) -> DataFrame:
    """(rule, threshold, retained_n, coverage, retained_accuracy, error_capture) of rows (conf, ok); a rule is a mask besides conf >= threshold."""
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    masks = F.array(*[F.struct(F.lit(n).alias("rule"), m.alias("mask")) for n, m in rules.items()])
    d = df.select("conf", "ok", masks.alias("masks")).select("conf", "ok", F.explode("masks").alias("m")).select("conf", "ok", "m.rule", "m.mask", grid)
    d = d.select("rule", "threshold", "ok", (F.col("mask") & (F.col("conf") >= F.col("threshold"))).alias("retained"))
    t = totals(d, "rule", "threshold")
    return t.select("rule", "threshold", "retained_n", "coverage", "retained_accuracy", (F.col("errors_referred") / F.greatest(F.lit(1), F.col("errors_total"))).alias("error_capture"))


def matched(df: DataFrame, most: int, id: str = "id", conf: str = "conf") -> DataFrame:
    """``df`` with ``matched``: whether a row is among the ``most`` of largest confidence, ties by id."""
    return places(df, [F.desc(conf), id]).withColumn("matched", F.col("place") <= most).drop("place")
