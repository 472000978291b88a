"""Quantiles of the normal, beta and binomial distributions as column expressions.

Beta integrals are Gauss-Legendre sums over panels of the density relative to its peak, divided by the same sums over the
whole range, so no gamma function is needed and nothing cancels however large the parameters are. The cost of a value
doesn't depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES, WEIGHTS = (x.tolist() for x in np.polynomial.legendre.leggauss(8))
#: Panels that a range is cut into, how often the one with the quantile is cut again, and standard deviations from the peak
#: to where the range ends.
PANELS, ZOOMS, REACH = 32, 6, 40.0
#: Below this variance a binomial quantile is summed up from 0, in so many terms, of which the last is below 1e-50.
SMALL, TERMS = 25.0, 240
#: Places that a binomial quantile is looked for on either side of the estimate; it misses by 3 at most (tests).
NEAR = 16


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is evaluated once."""
    return F.transform(F.array(x), f)[0]


def normal_quantile(u: Column) -> Column:
    """z with P(Z <= z) = u for 0 < u < 1, within 0.00045 (a rational approximation of the tail)."""
    t = F.sqrt(-2 * F.ln(F.least(u, 1 - u)))
    # fixed values of the approximation
    z = let(t, lambda t: t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
    return F.when(u < 0.5, -z).otherwise(z)


def _density(t: Column, s: Column) -> Column:
    """Beta density relative to its peak; ``s`` has a and b, each less one, and the peak."""
    d = t - s["peak"]
    left = F.when(s["a"] > 0, s["a"] * F.log1p(d / s["peak"])).otherwise(0.0)
    right = F.when(s["b"] > 0, s["b"] * F.log1p(-d / (1 - s["peak"]))).otherwise(0.0)
    return F.exp(left + right)


def _panel(low: Column, width: Column, s: Column) -> Column:
    """Integral over a panel."""
    half = width / 2
    return half * sum((w * _density(low + half * (1 + x), s) for x, w in zip(NODES, WEIGHTS, strict=True)), F.lit(0.0))


def _shape(a: Column, b: Column) -> Column:
    n = a + b
    peak = F.when(n > 2, (a - 1) / (n - 2)).otherwise(0.5)
    return F.struct((a - 1).alias("a"), (b - 1).alias("b"), peak.alias("peak"), (F.sqrt(a * b / (n + 1)) / n).alias("sd"))


def _integral(low: Column, high: Column, s: Column, panels: int) -> Column:
    width = (high - low) / panels
    return F.aggregate(F.sequence(F.lit(0), F.lit(panels - 1)), F.lit(0.0), lambda total, i: total + _panel(low + i * width, width, s))


def beta_quantile(q: float, a: Column, b: Column) -> Column:
    """x with P(X <= x) = q for a, b >= 1."""

    def zoom(state: Column, s: Column) -> Column:
        """The panel with the quantile, and the mass that is left to find in it."""
        width = state["width"] / PANELS
        start = F.struct(F.lit(0).alias("i"), state["need"].alias("need"))

        def step(acc: Column, i: Column) -> Column:
            mass = _panel(state["low"] + i * width, width, s)
            here = (acc["i"] == i) & (acc["need"] >= mass) & (i < PANELS - 1)
            return let(mass, lambda m: F.struct(F.when(here, i + 1).otherwise(acc["i"]).alias("i"), F.when(here, acc["need"] - m).otherwise(acc["need"]).alias("need")))

        found = F.aggregate(F.sequence(F.lit(0), F.lit(PANELS - 1)), start, step)
        return let(found, lambda f: F.struct((state["low"] + f["i"] * width).alias("low"), width.alias("width"), f["need"].alias("need")))

    def solve(s: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), s["peak"] - REACH * s["sd"]), F.least(F.lit(1.0), s["peak"] + REACH * s["sd"])
        start = F.struct(low.alias("low"), (high - low).alias("width"), (q * _integral(low, high, s, PANELS)).alias("need"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ZOOMS)), start, lambda state, _: zoom(state, s))
        # in the last panel the density is as good as constant
        return let(end, lambda e: e["low"] + F.least(e["width"], e["need"] / _density(e["low"] + e["width"] / 2, s)))

    return let(_shape(a.cast("double"), b.cast("double")), solve)


def _binomial_at(k: Column, n: Column, p: Column) -> Column:
    """struct(below, mass): P(K <= k) and P(K = k) for 0 <= k < n, from the beta distribution of p given k."""

    def at(s: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), s["peak"] - 12 * s["sd"]), F.least(F.lit(1.0), s["peak"] + 12 * s["sd"])
        mid = F.least(high, F.greatest(low, p))
        parts = F.struct(_integral(low, mid, s, PANELS // 2).alias("left"), _integral(mid, high, s, PANELS // 2).alias("right"))
        return let(parts, lambda m: F.struct((m["right"] / (m["left"] + m["right"])).alias("below"), (_density(p, s) / (m["left"] + m["right"]) * (1 - p) / (n - k)).alias("mass")))

    return let(_shape(k + 1, n - k), at)


def binomial_quantile(u: Column, n: Column, p: Column) -> Column:
    """The smallest k with P(K <= k) >= u, for K binomial of ``n`` and ``p`` and 0 < u < 1.

    With a variance below 25 probabilities are summed from the near end. Otherwise a normal estimate with its correction for
    skewness and one Newton step lands next to the quantile, and probabilities there settle it.
    """
    n, p = n.cast("double"), p.cast("double")

    def summed(v: Column) -> Column:
        """From the end that is rarer; counted from n down, ties of u and a sum are on the other side."""
        few = F.least(v["p"], 1 - v["p"])
        down = v["p"] > 0.5
        start = F.struct(F.exp(v["n"] * F.log1p(-few)).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("count"))

        def step(acc: Column, i: Column) -> Column:
            total = acc["sum"] + acc["term"]
            counted = F.when(down, total <= 1 - v["u"]).otherwise(total < v["u"])
            return F.struct((acc["term"] * (v["n"] - i) / (i + 1) * few / (1 - few)).alias("term"), total.alias("sum"), (acc["count"] + counted.cast("double")).alias("count"))

        count = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step)["count"]
        return let(F.least(count, v["n"]), lambda c: F.when(down, v["n"] - c).otherwise(c))

    def searched(v: Column) -> Column:
        z, sd = normal_quantile(v["u"]), F.sqrt(v["n"] * v["p"] * (1 - v["p"]))
        inside = lambda k: F.least(v["n"] - 1, F.greatest(F.lit(0.0), F.floor(k).cast("double")))
        guess = let(z, lambda z: inside(v["n"] * v["p"] + z * sd + (z * z - 1) * (1 - 2 * v["p"]) / 6))
        near = let(guess, lambda g: let(_binomial_at(g, v["n"], v["p"]), lambda f: inside(g + F.greatest(-3 * sd, F.least(3 * sd, (v["u"] - f["below"]) / F.greatest(f["mass"], F.lit(1e-300)))))))

        def settle(k: Column) -> Column:
            """The first place in the neighbourhood whose sum reaches u."""
            odds = v["p"] / (1 - v["p"])

            def around(f: Column) -> Column:
                first = F.struct(k.alias("k"), f["below"].alias("below"), f["mass"].alias("mass"))
                down = lambda acc, _: F.when((acc["below"] - acc["mass"] >= v["u"]) & (acc["k"] > 0), F.struct((acc["k"] - 1).alias("k"), (acc["below"] - acc["mass"]).alias("below"), (acc["mass"] * acc["k"] / (v["n"] - acc["k"] + 1) / odds).alias("mass"))).otherwise(acc)

                def up(acc: Column, _: Column) -> Column:
                    more = let(acc["mass"] * (v["n"] - acc["k"]) / (acc["k"] + 1) * odds, lambda m: F.struct((acc["k"] + 1).alias("k"), (acc["below"] + m).alias("below"), m.alias("mass")))
                    return F.when((acc["below"] < v["u"]) & (acc["k"] < v["n"]), more).otherwise(acc)

                steps = F.sequence(F.lit(1), F.lit(NEAR))
                return let(F.aggregate(steps, first, down), lambda low: F.aggregate(steps, low, up))["k"]

            return let(_binomial_at(k, v["n"], v["p"]), around)

        return let(near, settle)

    values = F.struct(u.alias("u"), n.alias("n"), p.alias("p"))
    out = let(values, lambda v: F.when((v["n"] <= 0) | (v["p"] <= 0), 0.0).when(v["p"] >= 1, v["n"]).when(v["n"] * v["p"] * (1 - v["p"]) < SMALL, summed(v)).otherwise(searched(v)))
    return out.cast("long")


def clopper_pearson(hits: str | Column, n: str | Column, level: float = 0.95) -> Column:
    """struct(low, high): the exact interval of a share; null where ``n`` is not above 0 or the hits are not within it."""
    k, m = (F.col(c) if isinstance(c, str) else c for c in (hits, n))
    side = (1 - level) / 2
    fine = (m > 0) & (k >= 0) & (k <= m)
    low = F.when(k == 0, 0.0).otherwise(beta_quantile(side, k, m - k + 1))
    high = F.when(k == m, 1.0).otherwise(beta_quantile(1 - side, k + 1, m - k))
    return F.struct(F.when(fine, low).alias("low"), F.when(fine, high).alias("high"))


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight places up, and back by the recurrence."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.ln(product)
