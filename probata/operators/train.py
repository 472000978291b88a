"""Training on locked settings: scale, whiten, logistic regression, temperature, and figures of test rows that nothing was fitted on.

Rows have (y, x, part): class, array of features, and ``train``, ``val`` or ``test``. Scaling divides by population
deviations (1 where a feature is constant); components are those that keep a share of the variance, whitened by the square
root of their eigenvalues; the regression's penalty is that of a sum of losses with factor C, and classes weigh alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from . import metrics as M
from .select import fit_temperature

#: Rows whose Fourier features are computed at once.
WAVE_ROWS = 1024


@dataclass(frozen=True)
class Scaler:
    mean: Sequence[float]
    std: Sequence[float]

    def scaled(self, x: str | Column) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        by = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s or 1.0).alias("s")) for m, s in zip(self.mean, self.std, strict=True)])
        return F.zip_with(x, by, lambda v, b: (v - b["m"]) / b["s"])


@dataclass(frozen=True)
class Components:
    vectors: np.ndarray  # a row per component
    eigenvalues: Sequence[float]

    def whitened(self, x: str | Column) -> Column:
        """Scores with deviation 1 on the rows that the components come from, if those have mean 0."""

        @F.pandas_udf("array<double>")
        def run(v):  # noqa: ANN001, ANN202
            import pandas as pd

            z = np.stack(v.to_numpy()) @ (self.vectors / np.sqrt(self.eigenvalues)[:, None]).T if len(v) else np.zeros((0, len(self.eigenvalues)))
            return pd.Series(list(z))

        return run(F.col(x) if isinstance(x, str) else x)


def fit_scaler(df: DataFrame, x: str) -> Scaler:
    """Means and population deviations; a row per feature reaches the driver."""
    d = df.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    return Scaler([r.m for r in d], [r.s for r in d])


def fit_pca(df: DataFrame, x: str, share: float) -> Components:
    """The first components whose variances add up to ``share`` or more of all; their number is at most the features'."""
    v = df.select(array_to_vector(x).alias("x")).persist()
    first = v.first()
    if first is None:
        raise ValueError("no rows to fit components on")
    m = PCA(k=len(first.x), inputCol="x", outputCol="c").fit(v)
    ratio = m.explainedVariance.toArray()
    spread = v.select(F.posexplode(vector_to_array("x")).alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("s")).agg(F.sum("s")).first()[0]
    v.unpersist()
    kept = min(int(np.searchsorted(np.cumsum(ratio), share - 1e-12) + 1), int((ratio > 1e-12).sum()))
    return Components(m.pc.toArray().T[:kept], [float(r * spread) for r in ratio[:kept]])


def train(df: DataFrame, classes: int, share: float = 0.97, c: float = 0.05, most_iterations: int = 3000, bounds: tuple[float, float] = (0.25, 4.0)) -> DataFrame:
    """temperature, accuracy, balanced_accuracy, macro_f1, mcc and log_loss of the test rows, in one row. Raises if a class has no training row."""
    own = df.where("part = 'train'")
    scaler = fit_scaler(own, "x")
    parts = fit_pca(own.withColumn("x", scaler.scaled("x")), "x", share)
    z = df.withColumn("z", array_to_vector(parts.whitened(scaler.scaled("x")))).select("y", "z", "part").persist()
    n = {r.y: r.n for r in z.where("part = 'train'").groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row per class
    if set(n) != set(range(classes)):
        raise ValueError(f"training rows have to be of all {classes} classes, not of {sorted(n)}")
    total = sum(n.values())
    weight = F.element_at(F.create_map(*[F.lit(v) for y, k in n.items() for v in (y, total / (classes * k))]), F.col("y"))
    rows = z.where("part = 'train'").select(F.col("y").cast("double").alias("y"), "z", weight.alias("w"))
    # the loss is a mean over the weights, which add up to the rows
    model = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", family="multinomial", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=most_iterations, tol=1e-9).fit(rows)
    p = model.transform(z).select("y", "part", vector_to_array("probability").alias("p"))
    t = fit_temperature(p.where("part = 'val'"), "y", "p", *bounds)
    test = p.where("part = 'test'").select("y", P.temperature("p", t).alias("p"))
    cells = M.confusion(test.withColumn("pred", P.argmax("p")), classes)
    out = M.summary(cells).crossJoin(M.log_loss(test))
    return out.select(F.lit(float(t)).alias("temperature"), "accuracy", "balanced_accuracy", "macro_f1", "mcc", "log_loss")


def alternatives(df: DataFrame, classes: int, trees: int = 50, hidden: int = 32, seed: int = 42) -> DataFrame:
    """(model, n, hits) on the test rows of a random forest, linear support vectors (one against the rest) and a perceptron with one hidden layer, fitted on the scaled training rows."""
    scaler = fit_scaler(df.where("part = 'train'"), "x")
    z = df.select(F.col("y").cast("double").alias("y"), array_to_vector(scaler.scaled("x")).alias("z"), "part").persist()
    models = {
        "forest": RandomForestClassifier(featuresCol="z", labelCol="y", numTrees=trees, seed=seed),
        "vectors": OneVsRest(classifier=LinearSVC(featuresCol="z", labelCol="y", regParam=0.01, maxIter=50), featuresCol="z", labelCol="y"),
        "perceptron": MultilayerPerceptronClassifier(featuresCol="z", labelCol="y", layers=[len(scaler.mean), hidden, classes], maxIter=100, seed=seed),
    }
    out = None
    for name, model in models.items():
        p = model.fit(z.where("part = 'train'")).transform(z.where("part = 'test'"))
        one = p.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("y")).alias("hits"))
        out = one if out is None else out.unionByName(one)
    return out


def fourier(x: str, dims: int, gamma: float, features: int, seed: int = 42) -> Column:
    """Random Fourier features: their inner products approach exp(-gamma |x - y|^2), so a linear model on them is one with that kernel."""
    g = np.random.Generator(np.random.PCG64(seed))
    waves, phases = g.normal(0, np.sqrt(2 * gamma), (dims, features)), g.uniform(0, 2 * np.pi, features)

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        if v.null_count:
            raise ValueError("a row has no features")
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        z = np.empty((len(v), features))
        for at in range(0, len(v), WAVE_ROWS):
            part = z[at : at + WAVE_ROWS]
            np.matmul(x[at : at + WAVE_ROWS], waves, out=part)
            part += phases
            np.cos(part, out=part)
            part *= np.sqrt(2 / features)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * features), pa.array(z.ravel()))

    return run(F.col(x))


def curved(df: DataFrame, classes: int, gamma: float | None = None, features: int = 512, rounds: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """(model, n, hits) on the test rows of models that bend: support vectors with a Gaussian kernel (by Fourier features; ``gamma`` is 1 / dimensions if None) and boosted trees, both one against the rest, fitted on the scaled training rows."""
    scaler = fit_scaler(df.where("part = 'train'"), "x")
    dims = len(scaler.mean)
    z = df.select(F.col("y").cast("double").alias("y"), scaler.scaled("x").alias("s"), "part")
    z = z.select("y", "part", array_to_vector("s").alias("z"), array_to_vector(fourier("s", dims, gamma or 1 / dims, features, seed)).alias("waves")).persist()
    models = {
        "kernel": OneVsRest(classifier=LinearSVC(featuresCol="waves", labelCol="y", regParam=1e-3, maxIter=30), featuresCol="waves", labelCol="y", parallelism=classes),
        "boosted": OneVsRest(classifier=GBTClassifier(featuresCol="z", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed), featuresCol="z", labelCol="y", parallelism=classes),
    }
    out = None
    for name, model in models.items():
        p = model.fit(z.where("part = 'train'")).transform(z.where("part = 'test'"))
        one = p.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("y")).alias("hits"))
        out = one if out is None else out.unionByName(one)
    return out
