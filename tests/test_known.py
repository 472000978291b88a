"""Known tables with known figures, and models against plain solvers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from probata.functions.images import dct_hash
from probata.operators import audit as A
from probata.operators import lake as L
from probata.operators import metrics as M
from probata.operators import resample as B
from probata.operators import train as T
from probata.sources import files as IO

# Confusion tables (true by predicted) and their accuracy, balanced accuracy, macro F1 and MCC.
TABLES = [
    ([[10, 0, 0, 4], [0, 12, 0, 1], [1, 0, 2, 4], [9, 0, 3, 58]], 0.7884615385, 0.6879120879, 0.6820709890, 0.5982008050),
    ([[7, 0, 1, 6], [0, 12, 0, 1], [3, 0, 0, 4], [5, 4, 5, 56]], 0.7211538462, 0.5557692308, 0.5319657689, 0.4687027641),
    ([[8, 1, 5], [0, 2, 5], [6, 4, 55]], 0.7558139535, 0.5677655678, 0.5677655678, 0.3827751196),
    ([[78, 0, 0, 0, 0], [0, 85, 5, 0, 0], [0, 1, 84, 2, 3], [0, 0, 1, 84, 5], [0, 0, 3, 5, 82]], 0.9429223744, None, 0.9446459569, 0.9286780994),
]


@pytest.mark.parametrize(("table", "accuracy", "balanced", "f1", "mcc"), TABLES)
def test_figures_of_known_tables(spark, table, accuracy, balanced, f1, mcc):
    s = M.summary(spark.createDataFrame([(i, j, n) for i, row in enumerate(table) for j, n in enumerate(row)], "y int, pred int, n long")).first()
    assert (s.accuracy, s.macro_f1, s.mcc) == pytest.approx((accuracy, f1, mcc), abs=5e-10)
    assert balanced is None or s.balanced_accuracy == pytest.approx(balanced, abs=5e-10)


def test_calibration_error_of_known_bins(spark):
    # Rows, accuracy and mean confidence of seven bins.
    bins = [(2, 0.0, 0.3504587518129072), (14, 0.6428571428571429, 0.4520794623166156), (9, 0.4444444444444444, 0.5402561912702775), (8, 0.75, 0.6422984699446666), (16, 0.8125, 0.7482205363566261), (21, 0.9047619047619048, 0.8580066723714119), (34, 0.9117647058823529, 0.9425335009176422)]
    assert M.ece(spark.createDataFrame(bins, "n long, accuracy double, mean_confidence double")).first().ece == pytest.approx(0.0783864743, abs=5e-10)


def test_spread_of_known_repeats(spark):
    v = [0.7629212367950302, 0.7540480057144423, 0.7958365746398248, 0.7507635671044318, 0.7410635137256268]
    r = spark.createDataFrame([(x,) for x in v], "v double").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    assert (r.m, r.s) == pytest.approx((0.760927, 0.021023), abs=5e-7)


@pytest.mark.parametrize(("b", "c"), [(18, 11), (0, 0), (0, 3), (5, 5), (600, 600), (2000, 2000), (700, 500), (1200, 900), (40_000, 39_000), (1, 5000)])
def test_exact_mcnemar(spark, b, c):
    got = spark.createDataFrame([(b, c)], "b long, c long").select(B.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).first().p
    n, k = b + c, min(b, c)
    want = 1.0 if b == c else min(1.0, 2 * math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))
    assert got == pytest.approx(want, rel=1e-8, abs=1e-300)
    if (b, c) == (18, 11):
        assert got == pytest.approx(0.26493089646101, abs=1e-13)


CLASSWISE = [
    # Rule, support, retained, referred, right share of the retained, of four classes and three rules.
    ("first", 14, 11, 3, 8 / 11), ("first", 13, 9, 4, 8 / 9), ("first", 7, 5, 2, 2 / 5), ("first", 70, 45, 25, 44 / 45),
    ("both", 14, 5, 9, 4 / 5), ("both", 13, 7, 6, 1.0), ("both", 7, 2, 5, 0.0), ("both", 70, 40, 30, 1.0),
    ("matched", 14, 9, 5, 6 / 9), ("matched", 13, 4, 9, 1.0), ("matched", 7, 4, 3, 1 / 4), ("matched", 70, 37, 33, 1.0),
]
REPORTED = [("first", 70, 70 / 104, 62 / 70, 14 / 22, 22, 14), ("both", 54, 54 / 104, 51 / 54, 19 / 22, 22, 19), ("matched", 54, 54 / 104, 48 / 54, 16 / 22, 22, 16)]


def audited(spark, classwise=CLASSWISE, reported=REPORTED):
    c = spark.createDataFrame(classwise, "rule string, support long, retained long, referred long, retained_case_accuracy double")
    r = spark.createDataFrame(reported, "rule string, retained_n long, coverage double, retained_accuracy double, error_capture double, errors_total long, errors_referred long")
    return {(x.rule, x.check) for x in A.reconcile_rules(r, c, 4, 104).collect() if not x.ok}


def test_evidence_that_agrees_passes(spark):
    assert audited(spark) == set()


def test_every_tampering_shows(spark):
    swap = lambda rows, i, j, v: [(*r[:j], v, *r[j + 1 :]) if n == i else r for n, r in enumerate(rows)]
    for j, check in enumerate(["retained_n", "coverage", "retained_accuracy", "error_capture"], 1):
        assert audited(spark, reported=swap(REPORTED, 0, j, REPORTED[0][j] + (1 if j == 1 else 1e-8))) == {("first", check)}
    assert ("both", "errors_referred") in audited(spark, reported=swap(REPORTED, 1, 6, 18))
    assert audited(spark, swap(CLASSWISE, 0, 4, 0.73)) >= {("first", "whole_numbers")}
    assert audited(spark, swap(CLASSWISE, 0, 3, 4)) == {("first", "counts")}
    assert audited(spark, CLASSWISE[1:]) >= {("first", "classes"), ("first", "cases")}
    assert len(audited(spark, CLASSWISE[4:])) == 8 or len({r for r, _ in audited(spark, CLASSWISE[4:])}) == 1


def test_gate_on_missing_and_worse_figures(spark):
    base = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("e", 0.1), ("p", 1.0)], "metric string, value double")
    candidate = spark.createDataFrame([("a", 0.895), ("b", 0.7), ("e", 0.12)], "metric string, value double")
    got = {r.metric: r.delta for r in A.regressions(base, candidate, {"a": 0.01, "b": 0.05, "e": 0.01, "p": 0.0}, errors=("e",)).collect()}
    assert got == {"b": pytest.approx(-0.1), "e": pytest.approx(0.02), "p": None}


def test_strict_provenance_ends_the_job(spark):
    df = spark.createDataFrame([(1, "expert"), (2, "pseudo"), (3, None)], "id int, level string")
    assert [r.id for r in L.admitted(df, "level", "expert").collect()] == [1]
    assert L.admitted(df.where("id = 1"), "level", "expert", strict=True).count() == 1
    for i in (2, 3):
        with pytest.raises(Exception, match="level has to be expert"):
            L.admitted(df.where(f"id = {i}"), "level", "expert", strict=True).collect()


def test_lineage_ends_on_cycles(spark):
    e = spark.createDataFrame([("m1", "d"), ("m2", "d"), ("d", "t"), ("t", "s"), ("s", "d"), ("m2", "s"), ("d", "t")], "child string, parent string")
    got = {(r.node, r.source): r.depth for r in L.ancestors(e, F.col("child").startswith("m")).collect()}
    assert got == {("m1", "d"): 1, ("m1", "t"): 2, ("m1", "s"): 3, ("m2", "d"): 1, ("m2", "s"): 1, ("m2", "t"): 2}


def test_lineage_of_a_long_chain(spark):
    """1,000 steps in as many rounds as 1,000 has binary digits, and each pair once."""
    e = spark.createDataFrame([(str(i), str(i + 1), "ab"[i % 2]) for i in range(1000)], "child string, parent string, kind string")
    got = L.ancestors(e, F.col("child").isin("0", "600"), "kind").collect()
    assert len(got) == 1000 + 400
    assert all(r.depth == int(r.source) - int(r.node) for r in got)
    assert {tuple(r.kinds) for r in got if r.depth == 1} == {("a",)}
    assert {tuple(r.kinds) for r in got if r.depth > 1} == {("a", "b")}


def test_lineage_of_a_random_graph(spark):
    """Depths and kinds of all shortest paths against a search, cycles and loops and rows without an end included."""
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice("xyz")) for _ in range(60)] + [("n1", "n1", "x"), (None, "n1", "x"), ("n2", None, "y")]
    up = {}
    for c, p, k in edges:
        if c and p:
            up.setdefault(c, {}).setdefault(p, set()).add(k)
    want = {}
    for n in up:
        found, level, depth = {}, {n: set()}, 0
        while level:
            depth, higher = depth + 1, {}
            for x, kinds in level.items():
                for p, own in up.get(x, {}).items():
                    if p not in found:
                        higher.setdefault(p, set()).update(kinds | own)
            found |= {p: (depth, sorted(k)) for p, k in higher.items()}
            level = higher
        want |= {(n, p): x for p, x in found.items()}
    got = L.ancestors(spark.createDataFrame(edges, "child string, parent string, kind string"), F.lit(True), "kind").collect()
    assert {(r.node, r.source): (r.depth, list(r.kinds)) for r in got} == want
    assert len(got) == len(want)


def test_lineage_tasks_hold_few_rows(spark, monkeypatch):
    """Files of what is grouped, one a task, hold no more rows on more edges, though all lies below one node."""
    monkeypatch.setattr(L, "TASK_ROWS", 200, raising=False)
    for n in (500, 3000):
        edges = [(f"o{i}", f"c{i % 40}", "placed") for i in range(n)] + [(f"c{i}", "hub", "resides") for i in range(40)] + [("hub", "root", "lies")]
        df = spark.createDataFrame(edges, "child string, parent string, kind string")
        got = L.ancestors(df, F.lit(True), "kind").withColumn("file", F.input_file_name())
        want = {(f"o{i}", p): (d, k) for i in range(n) for p, d, k in ((f"c{i % 40}", 1, ["placed"]), ("hub", 2, ["placed", "resides"]), ("root", 3, ["lies", "placed", "resides"]))}
        want |= {(f"c{i}", p): (d, k) for i in range(40) for p, d, k in (("hub", 1, ["resides"]), ("root", 2, ["lies", "resides"]))} | {("hub", "root"): (1, ["lies"])}
        rows = got.collect()
        assert {(r.node, r.source): (r.depth, r.kinds) for r in rows} == want and len(rows) == len(want)
        assert max(Counter(r.file for r in rows if r.depth > 1).values()) <= 400
    a = spark.createDataFrame([(f"o{i}", "hub") for i in range(5000)] + [(f"p{i}", f"q{i}") for i in range(100)], "node string, mid string")
    met = L._linked(a, spark.createDataFrame([("hub", "root"), ("hub", "top"), ("q7", "x")], "mid string, source string")).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.node, r.source) for r in met} == {(f"o{i}", s) for i in range(5000) for s in ("root", "top")} | {("p7", "x")} and len(met) == 10_001
    assert max(Counter(r.task for r in met).values()) <= 2500


def test_lineage_of_many_kinds(spark):
    """150 kinds and none: what is on the path, in order."""
    kinds = [f"k{i:03}" for i in range(150)]
    e = spark.createDataFrame([("a", "b", k) for k in kinds[:70]] + [("a", "b", None)] + [("b", "c", k) for k in kinds[60:]], "child string, parent string, kind string")
    got = {(r.node, r.source): (r.depth, r.kinds) for r in L.ancestors(e, F.col("kind") == "k000", "kind").collect()}
    assert got == {("a", "b"): (1, [*kinds[:70], None]), ("a", "c"): (2, [*kinds, None])}
    assert L.ancestors(e.where("false"), F.lit(True), "kind").collect() == []


def test_drift_inside_of_fields(spark):
    """Every kind of change at depth two, in structs, lists and maps."""
    old = StructType.fromDDL("a struct<b: struct<c: int, d: string, e: int, f: int>, g: array<struct<h: int, i: float>>>, m map<string, struct<x: int>>, k array<int>, t int")
    new = StructType.fromDDL("a struct<b: struct<c: bigint, e: string, f: int not null, n: int, o: int not null>, g: array<struct<h: int, i: double, j: int>>>, m map<string, struct<x: string>>, k array<bigint>, t array<int>")
    got = {r.field: r.change for r in L.drift(spark, old, new).collect()}
    assert got == {"a.b.c": "widened", "a.b.d": "removed", "a.b.e": "incompatible", "a.b.f": "tightened", "a.b.n": "added_optional", "a.b.o": "added_required", "a.g[].i": "widened", "a.g[].j": "added_optional", "m{value}.x": "incompatible", "k[]": "widened", "t": "incompatible"}
    assert L.drift(spark, old, old).count() == 0


def test_rows_by_contract(spark):
    contract = StructType.fromDDL("id bigint not null, who struct<name: string not null, age: int>, at timestamp, ok boolean, score double, marks array<struct<v: int not null>>, more map<string, int>")
    rows = [
        ('{"id": 1}', [], None),
        ('{"id": 1, "who": {"name": "x", "age": 3}, "at": "2024-01-01T00:00:00", "ok": true, "score": 1, "marks": [{"v": 1}], "more": {"a": 1}}', [], None),
        ('{"who": {"name": "x"}}', [], "id missing"),
        ('{"id": null}', [], "id missing"),
        ('{"id": "1"}', [], "id incompatible"),
        ('{"id": 1.5}', [], "id incompatible"),
        ('{"id": 1, "who": {}}', [], "who.name missing"),
        ('{"id": 1, "who": "x"}', [], "who incompatible"),
        ('{"id": 1, "who": {"name": "x", "age": 99999999999}}', [], "who.age incompatible"),
        ('{"id": 1, "who": {"name": "x", "zip": 1, "a.b": 2}, "new": [1]}', ["who.a.b", "who.zip", "new"], None),
        ('{"id": 1, "at": "noon"}', [], "at incompatible"),
        ('{"id": 1, "ok": "yes"}', [], "ok incompatible"),
        ('{"id": 1, "marks": [{"v": 1}, {"w": 2}]}', ["marks[].w"], "marks[].v missing"),
        ('{"id": 1, "marks": {"v": 1}}', [], "marks incompatible"),
        ('{"id": 1, "marks": [], "more": {}}', [], None),
        ('{"id": 1, "more": {"a": 1, "b": "x"}}', [], "more{value} incompatible"),
        ("{", [], "unreadable"),
        ("[1]", [], "unreadable"),
        ("", [], "unreadable"),
        (None, [], "unreadable"),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(rows)], "i int, payload string")
    got = {r.i: (r.rescued, r.reason) for r in L.conformed(df, "payload", contract).collect()}
    assert got == {i: (rescued, reason) for i, (_, rescued, reason) in enumerate(rows)}


def test_late_rows_against_a_loop(spark):
    rows = [(i, (i * 7919) % 5000 + i * 40) for i in range(3000)]
    got = L.late(spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("ts")), "ts", ["id"], "10 MINUTES", width=16).first()
    newest, late = None, 0
    for _, s in rows:
        late += newest is not None and s < newest - 600
        newest = s if newest is None else max(newest, s)
    assert (got.n, got.late) == (3000, late)
    assert late > 100


def test_picture_hash_against_the_sum_of_cosines(spark):
    rng = np.random.default_rng(2)
    pictures = [rng.integers(0, 256, 1024).astype(float), np.arange(1024.0), np.zeros(1024)]
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(pictures)] + [(3, [1.0] * 5), (4, None), (5, [None] * 1024)]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, p array<double>").select("i", dct_hash("p").alias("h")).collect()}
    for i, p in enumerate(pictures[:2]):
        x = p.reshape(32, 32)
        cos = [[math.cos(math.pi * (n + 0.5) * k / 32) for n in range(32)] for k in range(8)]
        waves = [4 * sum(x[a, b] * cos[u][a] * cos[v][b] for a in range(32) for b in range(32)) for u in range(8) for v in range(8)]
        middle = (sorted(waves)[31] + sorted(waves)[32]) / 2
        want = int("".join(str(int(w > middle)) for w in waves), 2)
        # waves that are 0 but for rounding may fall to either side
        clear = int("".join(str(int(abs(w - middle) > 1e-6)) for w in waves), 2)
        assert (got[i] % (1 << 64)) & clear == want & clear
    assert got[3] is None
    assert got[4] is None
    assert got[5] is None


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    y = np.arange(600) % 3
    x = rng.normal(size=(600, 6)) @ rng.normal(size=(6, 6)) + 1.5 * np.eye(3)[y] @ rng.normal(size=(3, 6)) + 5
    x = np.c_[x, np.full(600, 3.0)]  # a constant feature
    return y, x, np.array(["train", "train", "val", "test"])[rng.integers(0, 4, 600)]


def test_training_against_a_plain_solver(spark, rows):
    y, x, part = rows
    df = spark.createDataFrame([(int(a), [float(v) for v in b], str(c)) for a, b, c in zip(y, x, part, strict=True)], "y int, x array<double>, part string")
    own = part == "train"
    s = T.fit_scaler(df.where("part = 'train'"), "x")
    assert s.mean == pytest.approx(list(x[own].mean(axis=0)))
    assert s.std == pytest.approx(list(x[own].std(axis=0)), abs=1e-9)
    z = (x - x[own].mean(axis=0)) / np.where(x[own].std(axis=0) > 1e-9, x[own].std(axis=0), 1)
    value, vector = np.linalg.eigh(np.cov(z[own].T))
    order = np.argsort(-value)
    kept = int(np.searchsorted(np.cumsum(value[order]) / value.sum(), 0.97 - 1e-12) + 1)
    p = T.fit_pca(df.where("part = 'train'").withColumn("x", s.scaled("x")), "x", 0.97)
    assert p.eigenvalues == pytest.approx(list(value[order][:kept]))
    w = z @ vector[:, order[:kept]] / np.sqrt(value[order[:kept]])
    # the convex loss by plain gradient steps: sum of weighted losses times C, and half the squared weights
    t, n = np.eye(3)[y[own]], np.bincount(y[own])
    each = (own.sum() / (3 * n))[y[own]]
    a, bias = np.zeros((kept, 3)), np.zeros(3)
    soft = lambda m: np.exp(m - m.max(axis=1, keepdims=True)) / np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    for _ in range(6000):
        g = (soft(w[own] @ a + bias) - t) * each[:, None] * 0.05
        a, bias = a - 0.05 * (w[own].T @ g + a), bias - 0.05 * g.sum(axis=0)
    q = soft(w @ a + bias)
    val, test = part == "val", part == "test"
    loss = lambda h, m: -np.log(soft(np.log(np.clip(q[m], 1e-9, 1)) / h)[np.arange(m.sum()), y[m]]).mean()
    grid = np.linspace(0.25, 4, 30_001)
    best = grid[np.argmin([loss(h, val) for h in grid[::30]]) * 30]
    got = T.train(df, 3).first()
    assert got.temperature == pytest.approx(best, abs=0.01)
    assert got.log_loss == pytest.approx(loss(best, test), abs=2e-3)
    assert got.accuracy == pytest.approx((q[test].argmax(axis=1) == y[test]).mean(), abs=0.011)
    with pytest.raises(ValueError, match="all 4 classes"):
        T.train(df, 4)


def test_other_models_learn_planted_classes(spark, rows):
    y, x, part = rows
    df = spark.createDataFrame([(int(a), [float(v) for v in b], str(c)) for a, b, c in zip(y, x, part, strict=True)], "y int, x array<double>, part string")
    got = {r.model: r for r in T.alternatives(df, 3).collect()}
    assert set(got) == {"forest", "vectors", "perceptron"}
    assert all(r.n == (part == "test").sum() and r.hits > 0.6 * r.n for r in got.values())


def test_hashes_of_files_that_no_task_holds(spark, tmp_path):
    """Files are hashed in pieces, byte for byte: empty, without a last break, with byte order marks, carriage returns and bytes that are no text."""
    bom, long = b"\xef\xbb\xbf", b"".join(b"line %d \xff\x00\r\n" % i for i in range(9000))
    bodies = [b"", b"\n", b"\n\n", b"a", b"a\n", b"a\r\nb\r", bom, bom + b"\n", bom + b"a", bom + b"a\nb\n", b"\xff\xfe\x00", long, bom + long[:-1]]
    for i, body in enumerate(bodies):
        (tmp_path / f"f{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"f{i % 3}" / f"{i}.bin").write_bytes(body)
    own = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "20000"}
    known = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = {r.path.rsplit("/", 1)[1]: (r.label, r.bytes, r.sha256) for r in IO.labelled_files(spark, str(tmp_path), "*.bin").collect()}
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert got == {f"{i}.bin": (f"f{i % 3}", len(b), hashlib.sha256(b).hexdigest()) for i, b in enumerate(bodies) if b}
