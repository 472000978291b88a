"""The referral gate against its rules by hand: thresholds, random and certain vectors, invalid ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from probata.functions import probs as P

POLICY = P.GatePolicy()
STEP = 2**-20


def vector(top, at=0, k=4, rest=(1, 0, 0)):
    """A probability vector with ``top`` at one place and the rest shared as given."""
    out = [(1 - top) * r / sum(rest) for r in rest]
    return [*out[:at], top, *out[at:]]


def plain(roi, latent, policy=POLICY):
    """The gate by hand."""
    entropy = lambda p: -sum(v * math.log(max(v, 1e-9)) for v in p) / math.log(len(p))
    rules = [max(roi) < policy.roi_confidence, entropy(roi) > policy.roi_entropy, roi.index(max(roi)) != latent.index(max(latent)), max(latent) < policy.latent_confidence, entropy(latent) > policy.latent_entropy]
    return [name for bad, name in zip(rules, P.REASONS, strict=True) if bad]


def gated(spark, pairs, policy=POLICY):
    rows = [(i, list(a) if a is not None else None, list(b) if b is not None else None) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    return [r.g for r in df.select("i", P.decide("a", "b", 4, policy).alias("g")).orderBy("i").collect()]


def test_thresholds_retain_what_lies_on_them(spark):
    c, d = POLICY.roi_confidence, POLICY.latent_confidence
    pairs = [(vector(c + x), vector(d + y)) for x in (-STEP, 0, STEP) for y in (-STEP, 0, STEP)]
    for (roi, latent), g in zip(pairs, gated(spark, pairs), strict=True):
        assert ("roi_low_confidence" in g.reasons) == (max(roi) < c)
        assert ("latent_low_confidence" in g.reasons) == (max(latent) < d)


def test_random_vectors_against_the_rules_by_hand(spark):
    rng = random.Random(12)
    draw = lambda: [w / sum(ws) for w in ws] if (ws := [rng.random() ** rng.choice([1, 3, 9]) for _ in range(4)]) else None
    pairs = [(draw(), draw()) for _ in range(400)]
    for policy in (POLICY, P.GatePolicy(0.4, 0.9, 0.3, 0.95)):
        seen = set()
        for (roi, latent), g in zip(pairs, gated(spark, pairs, policy), strict=True):
            assert g.reasons == plain(roi, latent, policy)
            assert g.action == (P.REFER if g.reasons else P.RETAIN)
            assert g.roi_only_retained == (not {"roi_low_confidence", "roi_high_entropy"} & set(g.reasons))
            assert math.copysign(1, g.roi_entropy) == 1  # no negative zero
            seen |= set(g.reasons)
        assert len(seen) >= 4


def test_certain_vectors_agree_or_not(spark):
    sure = [vector(1.0, at) for at in range(4)]
    for (i, j), g in zip([(i, j) for i in range(4) for j in range(4)], gated(spark, [(a, b) for a in sure for b in sure]), strict=True):
        assert (g.roi_prediction, g.latent_prediction, g.roi_entropy) == (i, j, 0.0)
        assert g.reasons == (["branch_disagreement"] if i != j else [])


@pytest.mark.parametrize("reason", ["length", "not_numeric", "not_finite", "out_of_range", "sum", None])
def test_invalid_vectors_on_either_side(spark, reason):
    good = vector(0.8, rest=(2, 1, 1))
    broken = {
        "length": [good[:-1], [*good, 0.0], [], None], "not_numeric": [[None, *good[1:]]], "not_finite": [[x, *good[1:]] for x in (math.nan, math.inf, -math.inf)],
        "out_of_range": [[-STEP, 1 + STEP, 0.0, 0.0], [2.0, -1.0, 0.0, 0.0]], "sum": [[v * 1.01 for v in good], [v / 3 for v in good], [0.0] * 4], None: [good, [v + 1e-8 for v in good]],
    }[reason]
    for bad in broken:
        df = spark.createDataFrame([(bad, good)], "p array<double>, q array<double>")
        assert df.select(P.invalid_reason("p", 4).alias("r")).first().r == reason
        assert [(g is None) for g in gated(spark, [(bad, good), (good, bad)])] == [reason is not None] * 2


def test_temperature_one_changes_nothing(spark):
    q = spark.createDataFrame([([0.7, 0.2, 0.1, 0.0],)], "p array<double>").select(P.temperature("p", 1.0).alias("q")).first().q
    assert q == pytest.approx([0.7, 0.2, 0.1, 0.0], abs=1e-8)


def test_mixture_weights(spark):
    m = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>").select(P.mixture([(0.25, "a"), (F.lit(0.75), "b")]).alias("m")).first().m
    assert m == [0.25, 0.75]
