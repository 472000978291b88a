"""The text model and its export, and models that bend, against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from probata.operators import text as TX
from probata.operators import train as T

WORDS = {"a": "apple pear plum cherry grape melon".split(), "b": "iron steel zinc copper tin lead".split(), "c": "rain snow hail wind fog frost".split()}


def documents(n=120):
    g = np.random.default_rng(7)
    rows = []
    for i in range(n):
        y = "abc"[i % 3]
        own = list(g.choice(WORDS[y], 6)) + list(g.choice(sum(WORDS.values(), []), 3)) + ["The", "the", "x"]
        rows.append((i, " ".join(map(str, own)), y))
    return rows + [(n, None, "a"), (n + 1, "", "b"), (n + 2, "never seen before", "c"), (n + 3, "apple Apple ÄPFEL äpfel_1", "a"), (n + 4, "apple iron", None), (n + 5, "apple " * 20_000, "a")]


def test_export_gives_the_probabilities_of_the_model(spark):
    """Both within 1e-9 on every document, and both what a plain softmax over TF-IDF gives."""
    rows = documents()
    df = spark.createDataFrame(rows, "id long, text string, y string").repartition(3)
    train = df.where("id < 100")
    model = TX.fit(train, "id", "text", "y", ["a", "b", "c"])
    export, intercepts = model.export(df)
    one = {r.id: r.p for r in model.transform(df).collect()}
    two = {r.id: r.p for r in TX.score(df, export, intercepts, "id", "text").collect()}
    assert set(one) == set(two) == {r[0] for r in rows}
    table = {r.term: (r.idf, r.weights) for r in export.collect()}
    terms = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    df_ = Counter(w for i, t, _ in rows if i < 100 for w in set(terms(t)))
    assert set(table) == {w for w, n in df_.items() if n >= 2}
    for i, text, _ in rows:
        x = {w: n * table[w][0] for w, n in Counter(terms(text)).items() if w in table}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        z = [sum(v * table[w][1][c] for w, v in x.items()) / norm + intercepts[c] for c in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert one[i] == pytest.approx([v / sum(e) for v in e], abs=1e-9)
        assert two[i] == pytest.approx(one[i], abs=1e-9)
    for w, n in df_.items():
        if n >= 2:
            assert table[w][0] == pytest.approx(math.log(101 / (1 + n)) + 1)
    held = [(one[i].index(max(one[i])), "abc".index(y)) for i, t, y in rows if i >= 100 and y and t and i < 120]
    assert sum(a == b for a, b in held) == len(held)


def test_vocabulary_of_the_most_frequent(spark):
    counts = spark.createDataFrame([(d, t, 1) for t, n in (("b", 3), ("a", 3), ("c", 5), ("d", 1)) for d in range(n)], "id long, term string, n long")
    assert [r.term for r in TX.vocabulary(counts, 9, most=2).orderBy(F.desc("df"), "term").collect()] == ["c", "a"]
    assert TX.vocabulary(counts, 9).count() == 3
    with pytest.raises(ValueError, match="no term"):
        TX.fit(spark.createDataFrame([(1, "only once", "a")], "id long, text string, y string"), "id", "text", "y", ["a", "b"])


def test_fourier_features_make_the_kernel(spark):
    g = np.random.default_rng(1)
    x = g.normal(0, 1, (60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x array<double>").repartition(3)
    z = np.array([r.z for r in df.select("i", T.fourier("x", 5, 0.3, 4000).alias("z")).orderBy("i").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_rings(spark):
    """Classes in rings: no line parts them, the kernel and the boosted trees do."""
    g = np.random.default_rng(5)
    rows = []
    for i in range(600):
        angle, y = g.uniform(0, 2 * math.pi), i % 2
        r = (1 + 2 * y) + g.normal(0, 0.25)
        rows.append((y, [float(r * math.cos(angle)), float(r * math.sin(angle))], ["train", "train", "test"][i % 3]))
    df = spark.createDataFrame(rows, "y int, x array<double>, part string")
    z = df.select(F.col("y").cast("double").alias("y"), array_to_vector("x").alias("z"), "part")
    line = LinearSVC(featuresCol="z", labelCol="y", maxIter=20).fit(z.where("part = 'train'")).transform(z.where("part = 'test'"))
    straight = line.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    bent = {r.model: r.hits / r.n for r in T.curved(df, 2, gamma=1.0, features=128).collect()}
    assert straight < 0.75
    assert bent["kernel"] > 0.95
    assert bent["boosted"] > 0.9


def test_terms_are_counted_in_place(spark, monkeypatch):
    """No term of a text is shuffled to be counted, and scores don't depend on how many terms are broadcast."""
    texts = ["Ab ab cd_1 x", "", None, "cd_1 efg, EFG! ab", "efg hij ab " * 50, "hij"]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "id long, text string, y string")
    counts = TX.term_counts(docs, "id", "text")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.term): r.n for r in counts.collect()} == {(0, "ab"): 2, (0, "cd_1"): 1, (3, "cd_1"): 1, (3, "efg"): 2, (3, "ab"): 1, (4, "efg"): 50, (4, "hij"): 50, (4, "ab"): 50, (5, "hij"): 1}
    export, intercepts = TX.bayes(docs, "id", "text", "y", ["a", "b"])
    whole = {r.id: r.p for r in TX.score(docs, export, intercepts, "id", "text").collect()}
    monkeypatch.setattr(TX, "BROADCAST_ROWS", 2)
    assert export.count() == 4 and set(whole) == set(range(len(texts)))
    for r in TX.score(docs, export, intercepts, "id", "text").collect():
        assert r.p == pytest.approx(whole[r.id], abs=1e-12)


def test_fourier_features_of_a_batch(spark):
    """A batch's features are one block of numbers, not an object per row, and are those of the formula."""
    import pyarrow as pa

    run = T.fourier("x", 3, 0.5, 8, seed=1)
    x = np.random.default_rng(2).normal(size=(2500, 3))
    got = np.array([r.z for r in spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, x array<double>").select("i", run.alias("z")).orderBy("i").collect()])
    g = np.random.Generator(np.random.PCG64(1))
    waves, phases = g.normal(0, np.sqrt(2 * 0.5), (3, 8)), g.uniform(0, 2 * np.pi, 8)
    assert np.allclose(got, np.cos(x @ waves + phases) * np.sqrt(2 / 8), atol=1e-12)
    plan = spark.range(1).selectExpr("array(cast(id as double), 0D, 0D) as x").select(run)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and pa.__version__
    with pytest.raises(Exception, match="no features"):
        spark.createDataFrame([(None,)], "x array<double>").select(run).collect()


def test_fitting_shuffles_sums_of_terms(spark, monkeypatch):
    """The vocabulary comes from sums of tasks, not from a row per document and term, and is the same; blocks are larger than the weights."""
    import pyarrow as pa

    texts = ["Ab ab cd_1 x", "", None, "cd_1 efg, EFG! ab", "efg hij ab " * 50, "hij \u00c4\u00d6 \u00e4\u00f6", "\u00e4\u00f6 kl mn op qr"]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts * 40)], "id long, text string, y string").repartition(2)
    want = {r.term: r.df for r in TX.vocabulary(TX.term_counts(docs, "id", "text"), 280).collect()}
    assert want == {"ab": 120, "cd_1": 80, "efg": 80, "hij": 80, "\u00e4\u00f6": 80, "kl": 40, "mn": 40, "op": 40, "qr": 40}

    def counted(*args):
        raise AssertionError("a row per document and term")

    monkeypatch.setattr(TX, "term_counts", counted)
    model = TX.fit(docs, "id", "text", "y", ["a", "b"], iterations=3)
    assert list(model.terms) == sorted(want)
    assert model.idf == pytest.approx([math.log(281 / (1 + want[t])) + 1 for t in model.terms])
    assert {r.term: r.df for r in TX.frequencies(docs, "text").collect()} == want
    sums = docs.select(F.array_join(TX.tokens("text"), " ").alias("t")).mapInArrow(TX._held, "term string, df long")
    assert sums.count() <= len(want) * 2
    monkeypatch.setattr(TX, "HELD_TERMS", 3)
    parts = list(TX._held(iter([pa.RecordBatch.from_pydict({"t": ["a b a", "a c d e", "", "a"]})])))
    assert [dict(zip(*b.to_pydict().values(), strict=True)) for b in parts] == [{"a": 2, "b": 1, "c": 1, "d": 1, "e": 1}, {"a": 1}]
    assert model.logistic.getMaxBlockSizeInMB() * (1 << 20) > 4 * 65_536 * 8
