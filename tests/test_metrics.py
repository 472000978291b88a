"""Metrics against known tables and brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from probata.functions import distributions as D
from probata.operators import metrics as M
from probata.operators import resample as B
from probata.operators.ranks import prefix_sums
from probata.plans import groups as G


def cells(spark, table):
    rows = [(i, j, n) for i, row in enumerate(table) for j, n in enumerate(row)]
    return spark.createDataFrame(rows, "y int, pred int, n long")


def test_summary_of_a_class_without_hits(spark):
    s = M.summary(cells(spark, [[8, 1, 0], [2, 5, 0], [1, 2, 0]])).first()
    assert s.accuracy == pytest.approx(13 / 19)
    assert s.balanced_accuracy == pytest.approx((8 / 9 + 5 / 7 + 0) / 3)
    p0, p1 = 8 / 11, 5 / 8
    f = [2 * p0 * (8 / 9) / (p0 + 8 / 9), 2 * p1 * (5 / 7) / (p1 + 5 / 7), 0]
    assert s.macro_f1 == pytest.approx(sum(f) / 3)


def test_mcc_of_constant_predictions_is_zero(spark):
    assert M.summary(cells(spark, [[5, 0], [3, 0]])).first().mcc == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(c, round(rng.random(), 2), rng.randrange(2)) for c in (0, 1) for _ in range(120)]
    return rows, spark.createDataFrame(rows, "c int, score double, hit int").cache()


def test_auc_counts_pairs(points):
    rows, df = points
    got = {r.c: r.auc for r in M.auc(df).collect()}
    for c in (0, 1):
        own = [(s, h) for k, s, h in rows if k == c]
        pairs = [(a, b) for (a, x), (b, y) in itertools.product(own, own) if x == 1 and y == 0]
        assert got[c] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))


def test_auc_of_reversed_scores(points):
    _, df = points
    a = {r.c: r.auc for r in M.auc(df).collect()}
    b = {r.c: r.auc for r in M.auc(df.withColumn("score", 1 - F.col("score"))).collect()}
    assert all(a[c] + b[c] == pytest.approx(1) for c in a)


def test_average_precision(points):
    rows, df = points
    got = {r.c: r.ap for r in M.average_precision(df).collect()}
    for c in (0, 1):
        own = [(s, h) for k, s, h in rows if k == c]
        total, ap = sum(h for _, h in own), 0.0
        for t in sorted({s for s, _ in own}, reverse=True):
            new = sum(h for s, h in own if s == t)
            ap += new / total * sum(h for s, h in own if s >= t) / sum(s >= t for s, _ in own)
        assert got[c] == pytest.approx(ap)


def test_calibration_edges(spark):
    rows = [([x, 1 - x], 0) for x in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)]
    bins = {r.bin: r.n for r in M.calibration(spark.createDataFrame(rows, "p array<double>, y int")).collect()}
    # 0.6 and 0.7 lie under their edges, 6 * 0.1 and 7 * 0.1, in doubles
    edges = [i * 0.1 for i in range(11)]
    want = {}
    for x in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
        b = next(i for i in range(10) if edges[i] <= x and (x < edges[i + 1] or i == 9))
        want[b] = want.get(b, 0) + 1
    assert bins == want


def test_mcnemar_known_value(spark):
    p = spark.createDataFrame([(18, 11), (0, 0), (5, 0)], "b long, c long").select(B.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()
    assert p[0].p == pytest.approx(0.26493089646101, rel=1e-12)
    assert p[1].p == 1.0
    assert p[2].p == pytest.approx(2 / 32)


def test_clopper_pearson_known_value(spark):
    r = spark.createDataFrame([(85, 86), (0, 10), (10, 10), (1, 0)], "k long, n long").select(B.clopper_pearson("k", "n").alias("ci")).collect()
    assert r[0].ci.low == pytest.approx(0.9369094837, abs=1e-9)
    assert r[0].ci.high == pytest.approx(0.9997056502, abs=1e-9)
    assert r[1].ci.low == 0
    assert r[2].ci.high == 1
    assert r[3].ci.low is None


def binomial_by_sums(u, n, p):
    if n == 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(n + 1)]
    up = np.cumsum(np.exp(logs))
    down = np.cumsum(np.exp(logs)[::-1])[::-1]
    below = np.where(up < 0.5, up, 1 - np.append(down[1:], 0))
    return int((below < u).sum())


def test_binomial_quantiles(spark):
    g = np.random.default_rng(1)
    rows = [(float(u), n, p) for n in (0, 1, 2, 5, 30, 99, 101, 400, 3000) for p in (0.0, 1e-6, 0.01, 0.2, 0.5, 0.63, 0.9, 0.9999, 1.0) for u in [*g.random(3), 2**-33, 1 - 2**-33]]
    df = spark.createDataFrame(rows, "u double, n long, p double")
    for r in df.select("u", "n", "p", D.binomial_quantile(F.col("u"), F.col("n"), F.col("p")).alias("k")).collect():
        assert r.k == binomial_by_sums(r.u, r.n, r.p), r


def test_binomial_quantiles_of_large_numbers(spark):
    """Against the normal quantile with its correction for skewness, which is within a place at a thousand million rows."""
    rows = [(u, n, p) for n in (10**6, 10**9) for p in (0.1, 0.31, 0.5, 0.97) for u in (1e-9, 0.01, 0.3, 0.5, 0.9, 1 - 1e-9)]
    df = spark.createDataFrame(rows, "u double, n long, p double")
    for r in df.select("u", "n", "p", D.binomial_quantile(F.col("u"), F.col("n"), F.col("p")).alias("k")).collect():
        z, sd = NormalDist().inv_cdf(r.u), math.sqrt(r.n * r.p * (1 - r.p))
        q = 1 - 2 * r.p
        want = r.n * r.p + z * sd + (z * z - 1) * q / 6 - 0.5
        assert abs(r.k - want) <= 1.5, (r, want)


def test_clopper_pearson_of_large_numbers(spark):
    """The ends solve the binomial tails; at 10**9 they agree with the normal interval to its own order."""
    rows = [(k, n) for n in (1, 2, 7, 60, 500) for k in {0, 1, n // 3, n - 1, n} if 0 <= k <= n] + [(310_000_000, 10**9), (1, 10**9), (10**9, 10**9)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", B.clopper_pearson("k", "n").alias("ci")).collect()

    def at_least(k, n, p):
        return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))

    for r in got:
        if r.n <= 500:
            assert r.ci.low == 0 if r.k == 0 else at_least(r.k, r.n, r.ci.low) == pytest.approx(0.025, rel=1e-9)
            assert r.ci.high == 1 if r.k == r.n else at_least(r.k + 1, r.n, r.ci.high) == pytest.approx(0.975, rel=1e-9)
    ends = {r.k: r.ci for r in got if r.n == 10**9}
    wide = NormalDist().inv_cdf(0.975) * math.sqrt(0.31 * 0.69 / 1e9)
    assert ends[310_000_000].low == pytest.approx(0.31 - wide, abs=3e-9)
    assert ends[310_000_000].high == pytest.approx(0.31 + wide, abs=3e-9)
    assert ends[1].low == pytest.approx(-math.log1p(-0.025) / 1e9, rel=1e-8)
    assert ends[10**9].low == pytest.approx(0.025 ** (1 / 1e9), rel=1e-12)
    odd = spark.createDataFrame([(3, 2), (-1, 2), (None, 2), (1, None)], "k long, n long").select(B.clopper_pearson("k", "n").alias("ci")).collect()
    assert {(r.ci.low, r.ci.high) for r in odd} == {(None, None)}


def test_counts_are_multinomial(spark):
    """Moments of the counts, and intervals of a share next to those of drawn rows."""
    rows = [(i, i % 3 == 0, i % 5 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a boolean, b boolean")
    reps, own = 800, Counter((a, b) for _, a, b in rows)
    got = {}
    for r in B.bootstrap_counts(df, reps, "s", "a", "b").collect():
        got.setdefault(r.rep, {})[(r.a, r.b)] = r.n
    assert set(got) == set(range(reps))
    assert all(sum(x.values()) == 600 for x in got.values())
    for i, c in enumerate(sorted(own)):
        x = np.array([v[c] for v in got.values()])
        p = own[c] / 600
        assert abs(x.mean() - 600 * p) < 4 * math.sqrt(600 * p * (1 - p) / reps)
        assert x.var() == pytest.approx(600 * p * (1 - p), rel=0.25)
        for d in sorted(own)[i + 1 :]:
            y = np.array([v[d] for v in got.values()])
            want = -p * own[d]
            spread = math.sqrt((600 * p * (1 - p) * own[d] * (1 - own[d] / 600) + want**2) / reps)
            assert np.cov(x, y)[0, 1] == pytest.approx(want, abs=4 * spread)
    drawn = B.bootstrap(df, "id", reps, "s").groupBy("rep").agg(F.avg(F.col("a").cast("double")).alias("v"))
    counted = B.bootstrap_counts(df, reps, "s", "a").groupBy("rep").agg((F.sum(F.when(F.col("a"), F.col("n"))) / F.sum("n")).alias("v"))
    one, two = (B.interval(x, "v").first() for x in (drawn, counted))
    for end in ("low", "median", "high"):
        assert one[end] == pytest.approx(two[end], abs=0.008)
    again = {(r.rep, r.a, r.b): r.n for r in B.bootstrap_counts(df.repartition(3), reps, "s", "a", "b").collect()}
    assert again == {(rep, *c): n for rep, x in got.items() for c, n in x.items()}


def test_counts_of_few_rows(spark):
    df = spark.createDataFrame([], "a boolean, s string")
    assert B.bootstrap_counts(df, 5, "s", "a").count() == 0
    df = spark.createDataFrame([(None, "x"), (None, "x"), (True, "y")], "a boolean, s string")
    got = B.bootstrap_counts(df, 50, "s", "a", "s").groupBy("rep").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in got} == {3}
    assert len(got) == 50


def test_rank_metrics_of_crowded_scores(spark):
    """All scores between 0.999 and 1: same values as pair by pair, and no partition has most of the rows."""
    g = np.random.default_rng(3)
    rows = [(int(c), float(1 - round(g.random(), 3) / 1000), int(g.random() < 0.3 + 0.2 * c)) for c in (0, 1) for _ in range(400)]
    points = spark.createDataFrame(rows, "c int, score double, hit int").repartition(4)
    auc = {r.c: r.auc for r in M.auc(points).collect()}
    ap = {r.c: r.ap for r in M.average_precision(points).collect()}
    for c in (0, 1):
        own = [(s, h) for k, s, h in rows if k == c]
        pairs = [(a > b) + (a == b) / 2 for a, h in own if h for b, m in own if not m]
        assert auc[c] == pytest.approx(sum(pairs) / len(pairs))
        total = 0.0
        for s in {s for s, _ in own}:
            above = [h for t, h in own if t >= s]
            total += sum(h for t, h in own if t == s) * sum(above) / len(above)
        assert ap[c] == pytest.approx(total / sum(h for _, h in own))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in M.running(points).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) >= 3
    assert max(sizes) < 0.6 * sum(sizes)


def test_prefix_sums(spark):
    rows = [(i % 3 if i % 7 else None, i * 37 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, o int, v long")
    got = {(r.g, r.o): r.v_before for r in prefix_sums(df, ["o"], ["v"], "g").collect()}
    assert got == {(g, o): sum(w for h, p, w in rows if h == g and p < o) for g, o, _ in rows}
    assert prefix_sums(df.limit(0), ["o"], ["v"], "g").count() == 0


def test_sums_of_drawn_rows(spark):
    """Draws inside of blocks: each replicate draws as many as there are rows, blocks get multinomial shares, and sums are those of the rows that the draws name."""
    n, reps, block = 130, 300, 16
    rows = [(i * 3, float(i % 7), None if i % 11 == 0 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, y long").repartition(5)
    counts = {(r.rep, r.block): r.draws for r in B.block_counts(spark, n, reps, "s", block).collect()}
    totals = np.zeros((reps, -(-n // block)))
    for (rep, b), k in counts.items():
        totals[rep, b] = k
    assert (totals.sum(axis=1) == n).all()
    for b in range(totals.shape[1]):
        p = min(block, n - b * block) / n
        assert abs(totals[:, b].mean() - n * p) < 4 * math.sqrt(n * p * (1 - p) / reps)
        assert totals[:, b].var() == pytest.approx(n * p * (1 - p), rel=0.4)
    got = {r.rep: (r.n, r.x, r.y) for r in B.bootstrap_sums(df, "id", reps, "s", "x", "y", block=block).collect()}
    assert set(got) == set(range(reps))
    for rep in range(0, reps, 37):
        drawn = []
        for b in range(totals.shape[1]):
            size = min(block, n - b * block)
            drawn += [rows[b * block + int(hashlib.md5(f"s|{rep}|{b}|{pos}".encode()).hexdigest()[:8], 16) % size] for pos in range(int(totals[rep, b]))]
        assert got[rep] == (n, pytest.approx(sum(r[1] for r in drawn)), sum(r[2] or 0 for r in drawn))
    assert B.bootstrap_sums(df.limit(0), "id", 5, "s", "x").count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_draws_of_more_rows_than_a_block(spark, tmp_path, monkeypatch, broadcast):
    """``boot_index`` draws from all rows, also beyond 65,536 of them, by a broadcast or a shuffle."""
    n, reps = 70_000, 2
    spark.range(n).selectExpr("id * 3 as vec_id", "array(cast(0 as float)) as embedding", "cast(id % 4 as int) as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(G, "REPS", reps)
    monkeypatch.setattr(B, "BROADCAST_ROWS", broadcast, raising=False)
    got = {r.rep: (r.n, r.s) for r in G.boot_index(spark, str(tmp_path)).collect()}
    draw = lambda rep, pos: int(hashlib.md5(f"{G.SEED}|{rep}|0|{pos}".encode()).hexdigest()[:8], 16) % n
    assert got == {rep: (n, sum(3 * draw(rep, pos) for pos in range(n))) for rep in range(reps)}
    assert B.drawn_sums(spark.range(0), "id", 5, "s", "id").count() == 0
