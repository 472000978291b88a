"""Codes and whitened vectors against plain versions, and on odd tables."""

import hashlib
import math

import numpy as np
import pytest

from probata.llm.quantize import codes, lloyd
from probata.llm.whiten import Centre, lobpcg, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds part by part, everything compared with everything, in Python's integers."""
    kept = [(i, [math.floor(4096 * float(c)) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [near(x, book)[1] for x in cut[p]]
            for e in range(len(book)):
                of = [x for x, o in zip(cut[p], own, strict=True) if o == e]
                if of:
                    book[e] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    last = [[near(cut[p][r], books[p]) for p in range(parts)] for r in range(len(kept))]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in x) for x in last]
    by = {lab: sum(e for e, r in zip(errors, kept, strict=True) if r[2] == lab) for lab in {r[2] for r in kept}}
    return [(r[0], "".join(f"{i:02x}" for _, i in x), e, by[r[2]], digest) for r, x, e in zip(kept, last, errors, strict=True)]


def sample(n, dims=16, seed=3):
    g = np.random.default_rng(seed)
    centres = g.normal(0, 0.2, (12, dims))
    rows = [(int(i), [float(np.float32(c)) for c in centres[i % 12] + g.normal(0, 0.05, dims)], int(i % 5) if i % 7 else None) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(n // 3)]  # a third are one vector
    rows += [(n * 2, None, 0), (n * 2 + 1, [None] + [0.0] * (dims - 1), 0), (n * 2 + 2, [math.inf] * dims, 0), (n * 2 + 3, [math.nan] * dims, 2), rows[5], rows[5]]
    g.shuffle(order := list(range(len(rows))))
    return [rows[i] for i in order]


@pytest.mark.parametrize("n", [7, 300])
def test_codes(spark, n):
    rows = sample(n)
    got = codes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(rows))


def test_ties_go_to_the_lower_entry(spark):
    """Entries that are equal, and parts half way between two entries, in every round."""
    rows = [(i, [(i // 2 % 9) / 64] * 8 + [0.5 * (i % 3)] * 8, None) for i in range(60)]
    got = codes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(rows))


def test_bounds_save_scans(spark):
    rows = sample(600)
    coded = lloyd(spark.createDataFrame(rows, SCHEMA))
    n = coded.rows.count()
    assert 7 * n < coded.scanned[0] <= 8 * n
    assert sum(coded.scanned[1:]) < 0.5 * 6 * 8 * n


def test_odd_code_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert codes(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes(df).count() == 0
    rows = [(None, [0.25] * 16, 1), (2, [0.5] * 16, 1), (3, [0.5] * 15, 1), (4, [1e6] * 16, 1), (5, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "'x' AS error", "2 AS id", "3 AS x", "4 AS upper")
    assert sorted((r.vec_id or 0, r.code, r.error) for r in codes(df).collect()) == [(0, "01" * 8, 0), (2, "00" * 8, 0)]


def plain_whitened(rows, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    z = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return deviation, z @ vectors / np.sqrt(values), values / np.trace(z.T @ z / n)


def matches(got, rows):
    deviation, white, explained = plain_whitened([v for _, v in rows])
    at = {i: n for n, (i, _) in enumerate(rows)}
    own = np.zeros_like(white)
    for r in got:
        assert (r.n, r.deviation) == (len(rows), deviation[at[r.vec_id]])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        own[at[r.vec_id], r.component - 1] = r.whitened
    assert len(got) == own.size
    own *= np.sign((own * white).sum(axis=0))
    assert np.abs(own - white).max() < 1e-9


def test_whitened(spark):
    rows = [(i, v) for i, v, _ in sample(400, 24) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    rows = list({i: (i, v) for i, v in rows}.values())
    df = spark.createDataFrame([(i, v, 0) for i, v in rows] + [(-1, None, 0), (-2, [math.nan] * 24, 0), (-3, [None] * 24, 0)], SCHEMA)
    matches(whitened(df.repartition(6)).collect(), rows)


def test_whitened_near_random_vectors(spark, sf):
    """The tables' vectors have close eigenvalues; steps are needed, and residuals end at rounding level."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    matches(whitened(df).collect(), rows)


def test_lobpcg_takes_steps_and_certifies(spark):
    g = np.random.default_rng(1)
    x = np.floor(g.normal(0, 100, (500, 80)) * np.linspace(3, 1, 80)).astype(int)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>")
    found = lobpcg(rows, Centre.of(len(x), [int(s) for s in x.sum(axis=0)]), 5)
    assert len(found.residuals) > 5
    assert found.residuals[-1] < 1e-11 * found.values[0]
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert found.values == pytest.approx(want[:5], rel=1e-12)
    assert found.trace == pytest.approx(want.sum(), rel=1e-12)


def test_odd_whitening_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert whitened(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened(df).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25, 0.125], 0) for i in range(4)] + [(None, [0.5, 0.25, 0.125], 0), (9, [0.5], 0), (10, [2.0**50] * 3, 0)], SCHEMA).selectExpr("*", "1 AS n", "2 AS whitened", "3 AS x", "4 AS id")
    got = whitened(same).collect()
    assert len(got) == 5 * 3
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(5, 0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(5)], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitened(line).collect()}
    assert got[(0, 1)].explained == pytest.approx(1)
    assert {got[(i, 2)].whitened for i in range(5)} == {0.0}
    assert abs(got[(0, 1)].whitened) == pytest.approx(math.sqrt(2))


def test_deviation_beyond_longs():
    c = Centre.of(3, [3 * 10**9, 1])
    x = np.array([[10**9, 0], [2 * 10**9, 5], [5 * 10**9, 7]])
    assert c.deviations(x) == [1, 9 * 10**18 + 14**2, None]
