"""Expressions on probability vectors (ARRAY<DOUBLE>): validation, decision, entropy, scaling, mixing, the referral gate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + v)


def invalid_reason(p: str | Column, k: int, tolerance: float = 1e-6) -> Column:
    """Why ``p`` is no probability vector of length ``k``, the first rule that fails; null if it is one."""
    p = _c(p)
    return (
        F.when(p.isNull() | (F.size(p) != k), "length")
        .when(F.exists(p, lambda v: v.isNull()), "not_numeric")
        .when(F.exists(p, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "not_finite")
        .when(F.exists(p, lambda v: (v < 0) | (v > 1)), "out_of_range")
        .when(F.abs(total(p) - 1.0) > tolerance, "sum")
    )


def top(p: str | Column) -> Column:
    return F.array_max(_c(p))


def argmax(p: str | Column) -> Column:
    """Index from 0 of the first maximum."""
    p = _c(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def margin(p: str | Column) -> Column:
    s = F.sort_array(_c(p), asc=False)
    return s[0] - s[1]


def clipped(v: Column, eps: float) -> Column:
    return F.greatest(v, F.lit(eps))


def entropy(p: str | Column, k: int, eps: float = 1e-9) -> Column:
    """Shannon entropy over its maximum, from 0 to 1."""
    return -total(F.transform(_c(p), lambda v: v * F.ln(clipped(v, eps)))) / math.log(k) + F.lit(0.0)


def temperature(p: str | Column, t: Column | float, eps: float = 1e-9) -> Column:
    """softmax(ln(p) / t), with the largest exponent taken off first."""
    t = F.lit(t) if isinstance(t, int | float) else t
    z = F.transform(_c(p), lambda v: F.ln(clipped(v, eps)) / t)
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / total(e))


def _scaled(p: Column, w: Column) -> Column:
    return F.transform(p, lambda v: v * w)


def mixture(parts: Sequence[tuple[float | Column, str | Column]]) -> Column:
    """Sum of weight * vector."""
    out = None
    for w, p in parts:
        own = _scaled(_c(p), F.lit(w) if isinstance(w, int | float) else w)
        out = own if out is None else F.zip_with(out, own, lambda a, b: a + b)
    return out


def onehot(y: str | Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == _c(y)).cast("int"))


#: Actions and reasons, in the order in which they are given.
RETAIN, REFER = "retain_for_research", "refer_for_human_review"
REASONS = ("roi_low_confidence", "roi_high_entropy", "branch_disagreement", "latent_low_confidence", "latent_high_entropy")


@dataclass(frozen=True)
class GatePolicy:
    """Thresholds of the referral gate; what lies on a threshold is retained."""

    # The thresholds.
    roi_confidence: float = 0.70
    roi_entropy: float = 0.65
    latent_confidence: float = 0.50
    latent_entropy: float = 0.75


def gate_reasons(roi: str | Column, latent: str | Column, k: int, policy: GatePolicy = GatePolicy()) -> Column:
    """Reasons to refer an example, in fixed order."""
    rules = (
        top(roi) < policy.roi_confidence,
        entropy(roi, k) > policy.roi_entropy,
        argmax(roi) != argmax(latent),
        top(latent) < policy.latent_confidence,
        entropy(latent, k) > policy.latent_entropy,
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in zip(rules, REASONS, strict=True)]))


def retained(roi: str | Column, latent: str | Column, k: int, policy: GatePolicy = GatePolicy()) -> Column:
    """The gate as a mask."""
    agree = argmax(roi) == argmax(latent)
    return retained_single(roi, k, policy) & agree & (top(latent) >= policy.latent_confidence) & (entropy(latent, k) <= policy.latent_entropy)


def retained_single(roi: str | Column, k: int, policy: GatePolicy = GatePolicy()) -> Column:
    """Confidence and entropy of the first branch only."""
    return (top(roi) >= policy.roi_confidence) & (entropy(roi, k) <= policy.roi_entropy)


def decide(roi: str | Column, latent: str | Column, k: int, policy: GatePolicy = GatePolicy()) -> Column:
    """struct: predictions, confidences, entropies, roi_only_retained, action and reasons; null where a vector is invalid."""
    reasons = gate_reasons(roi, latent, k, policy)
    out = F.struct(
        argmax(roi).alias("roi_prediction"),
        argmax(latent).alias("latent_prediction"),
        top(roi).alias("roi_confidence"),
        top(latent).alias("latent_confidence"),
        entropy(roi, k).alias("roi_entropy"),
        entropy(latent, k).alias("latent_entropy"),
        retained_single(roi, k, policy).alias("roi_only_retained"),
        F.when(F.size(reasons) == 0, RETAIN).otherwise(REFER).alias("action"),
        reasons.alias("reasons"),
    )
    return F.when(invalid_reason(roi, k).isNull() & invalid_reason(latent, k).isNull(), out)
