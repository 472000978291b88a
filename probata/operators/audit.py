"""Audit of aggregate evidence, and gates on releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile_rules(reported: DataFrame, classwise: DataFrame, classes: int, cases: int | None = None, close: float = 1e-9, integral: float = 1e-8) -> DataFrame:
    """(rule, check, ok): whether what is reported for each rule follows from its rows per class.

    ``reported`` has (rule, retained_n, coverage, retained_accuracy, error_capture, errors_total, errors_referred), and
    ``classwise`` (rule, support, retained, referred, retained_case_accuracy). Ratios have to agree within ``close``; the
    right ones among the retained of a class have to be whole numbers within ``integral``; the supports have to add up to
    ``cases``, if given. A class that retains nothing has none right; a ratio over nothing has to be reported as null; a
    rule without rows per class fails all checks.
    """
    right = F.col("retained") * F.coalesce("retained_case_accuracy", F.lit(0.0))
    g = classwise.groupBy(F.col("rule").alias("r2")).agg(
        F.count("*").alias("rows"), F.sum("support").alias("total"), F.sum("retained").alias("kept"), F.sum(F.bround(right)).alias("right"),
        F.max(F.abs(right - F.bround(right))).alias("off"), F.bool_and(F.col("retained") + F.col("referred") == F.col("support")).alias("whole"),
    )
    x = reported.join(g, F.col("rule") == F.col("r2"), "left")
    missed = F.col("kept") - F.col("right")
    same = lambda a, b: F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull() & F.col("rows").isNotNull()).otherwise(F.abs(a - b) <= close)
    checks = {
        "classes": F.col("rows") == classes,
        "cases": F.lit(True) if cases is None else F.col("total") == cases,
        "counts": F.col("whole"),
        "whole_numbers": F.col("off") <= integral,
        "retained_n": F.col("kept") == F.col("retained_n"),
        "coverage": same(F.try_divide("kept", "total"), F.col("coverage")),
        "retained_accuracy": same(F.try_divide("right", "kept"), F.col("retained_accuracy")),
        "errors_referred": F.col("errors_total") - missed == F.col("errors_referred"),
        "error_capture": same(F.try_divide(F.col("errors_total") - missed, F.col("errors_total")), F.col("error_capture")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()])).alias("c")
    return x.select("rule", each).select("rule", "c.check", "c.ok")


def regressions(base: DataFrame, candidate: DataFrame, tolerances: dict[str, float], errors: tuple[str, ...] = ()) -> DataFrame:
    """(metric, base, candidate, delta, tolerance) of the metrics that get worse by more than their tolerance, or are missing; tables are (metric, value), and less is better for those in ``errors``."""
    t = base.sparkSession.createDataFrame([(m, v, m in errors) for m, v in sorted(tolerances.items())], "metric string, tolerance double, less boolean")
    d = t.join(base.withColumnRenamed("value", "base"), "metric", "left").join(candidate.withColumnRenamed("value", "candidate"), "metric", "left")
    d = d.withColumn("delta", F.col("candidate") - F.col("base"))
    worse = F.when(F.col("less"), F.col("delta")).otherwise(-F.col("delta"))
    return d.where(worse.isNull() | (worse > F.col("tolerance"))).select("metric", "base", "candidate", "delta", "tolerance")
