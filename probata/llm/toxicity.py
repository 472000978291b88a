"""Toxicity by a chain of linear models.

The categories come one after another: each has a logistic model over the words of a text and the probabilities of the
categories before it. Where a model is trained, those earlier probabilities are out-of-fold: each training text gets
them from models that have not seen it. The labels say only whether a text is toxic, so the earlier categories are found
in the labelled texts: the words that are far more frequent in toxic texts than in others are parted into two kinds by
which of two words that hardly ever meet they occur with, and a labelled text is of a kind if it is toxic and has a word
of it. The last category, ``toxic``, is the label itself.

The models are fitted on the driver on a bounded sample of the labelled rows: those ``most_rows`` whose id has the least
hash. Texts are whole, in training as in prediction. Features are the words that occur, hashed; the models use those
``features`` of them whose presence differs most between the classes of their training rows.

Defined results: a text without a word (null, empty) has probability 0 in every category; without labelled rows, or where
a category has one class only, its probability is the share of that class; labels that are null or of no document are
passed over, an id with several labels is toxic if one of them is, and one with several texts is learned from the text
with the least hash; rows that repeat are judged each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import core

SPACE = 1 << 20

KINDS = ("kind_1", "kind_2")
CATEGORIES = (*KINDS, "toxic")


class Features(dict):
    """Token -> feature number, or -1 for one without a core; forgets all when it holds a million."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        w = core(token)
        n = self[token] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % SPACE if w else -1
        return n


@dataclass
class Linear:
    """p = sigmoid(sum of ``words`` weights that occur + earlier probabilities * ``chain`` + bias)."""

    numbers: np.ndarray
    words: np.ndarray
    chain: np.ndarray
    bias: float

    def scores(self, sets: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        out = np.full(len(sets), self.bias) + earlier @ self.chain
        each = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        if len(self.numbers) and len(each):
            at = np.searchsorted(self.numbers, each)
            at[at == len(self.numbers)] = 0
            weight = np.where(self.numbers[at] == each, self.words[at], 0.0)
            out += np.bincount(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), weight, len(sets))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def presence(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, place of each entry in them, rows of class 1 that have them, z) of the features: how far their presence differs between the classes."""
    numbers, back = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.repeat(y, [len(s) for s in sets])
    n1, n0 = np.bincount(back, label, len(numbers)), np.bincount(back, 1 - label, len(numbers))
    ones, none, p = y.sum(), len(y) - y.sum(), (n1 + n0) / len(y)
    z = (n1 / ones - n0 / none) / np.sqrt(p * (1 - p) * (1 / ones + 1 / none) + 1e-9)
    return numbers, back, n1, z


def kinds(sets: list[np.ndarray], toxic: np.ndarray, markers: int = 64, least_z: float = 5.0) -> list[np.ndarray]:
    """The features of each kind of toxic texts.

    Of at most ``markers`` features that mark toxic texts by ``least_z`` or more, the first (by z) stands for kind 1 and,
    for kind 2, the one whose texts overlap with its texts least; the others go to that they overlap with more (by the
    share of common texts in all texts of the two), ties to kind 1.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return [np.zeros(0, np.int64) for _ in KINDS]
    numbers, back, _, z = presence(sets, toxic)
    chosen = np.argsort(-z, kind="stable")[:markers]
    chosen = chosen[z[chosen] >= least_z]
    if len(chosen) < 2:
        return [numbers[chosen], np.zeros(0, np.int64)]
    place = np.full(len(numbers), -1)
    place[chosen] = np.arange(len(chosen))
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    has = np.zeros((len(sets), len(chosen)), np.float32)
    has[rows[place[back] >= 0], place[back][place[back] >= 0]] = 1
    has = has[toxic > 0]
    both, own = has.T @ has, has.sum(axis=0)
    overlap = both / np.maximum(own[:, None] + own[None, :] - both, 1)
    other = int(np.argmin(overlap[0]))
    second = overlap[:, other] > overlap[:, 0]
    second[0], second[other] = False, True
    return [np.sort(numbers[chosen[~second]]), np.sort(numbers[chosen[second]])]


def train_linear(sets: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, features: int, ridge: float = 1.0, rounds: int = 120) -> Linear:
    """Logistic regression by accelerated gradient steps; a constant if there is one class only."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), -30.0 if share == 0 else 30.0)
    numbers, back, _, z = presence(sets, y)
    z = np.abs(z)
    chosen = np.sort(np.argsort(-z, kind="stable")[:features])
    place = np.full(len(numbers), -1)
    place[chosen] = np.arange(len(chosen))
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.zeros((len(sets), len(chosen) + earlier.shape[1] + 1), np.float32)
    inside = place[back] >= 0
    x[rows[inside], place[back][inside]] = 1
    x[:, len(chosen) : -1] = earlier
    x[:, -1] = 1
    t = y.astype(np.float32)
    penalty = np.full(x.shape[1], ridge, np.float32)
    penalty[-1] = 0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # the largest curvature, for the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(np.linalg.norm(x.T @ (x @ v))) * 1.05 + ridge)
    w, last = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for i in range(rounds):
        a = w + (i / (i + 3)) * (w - last)
        q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        last, w = w, a - step * (x.T @ (q - t) + penalty * a)
    w = w.astype(float)
    return Linear(numbers[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def word_sets(texts: Iterator[str | None], features: Features) -> Iterator[np.ndarray]:
    for t in texts:
        tokens = (t or "").split()
        s = np.unique(np.fromiter(map(features.__getitem__, tokens), np.int64, len(tokens)))
        yield s[s >= 0]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 8000, features: int = 1024, folds: int = 5) -> list[Linear]:
    """The chain, trained on at most ``most_rows`` labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Features()
        for batch in batches:
            sets = list(word_sets((t.as_py() for t in batch.column(2)), numbers))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["k", "y", "s"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(known), "k")
    rows = rows.select(F.struct("k", F.xxhash64("t").alias("h")).alias("k"), F.col("y").cast("int").alias("y"), "t").mapInArrow(run, "k struct<k:long,h:long>, y int, s array<long>")
    rows = rows.groupBy(F.col("k.k").alias("k")).agg(F.min(F.struct("k.h", "y", "s")).alias("r")).select("k", "r.y", "r.s").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["s"]), key=lambda r: r["k"])
    sets = [np.array(r["s"], np.int64) for r in rows]
    toxic = np.array([r["y"] for r in rows], float)
    fold = np.array([xxhash.xxh64_intdigest(str(r["k"])) % folds for r in rows], int)
    chain, earlier = [], np.zeros((len(rows), 0))
    found = kinds(sets, toxic)
    for words in (*found, None):
        y = toxic if words is None else toxic * np.array([np.isin(s, words).any() for s in sets], float)
        unseen = np.zeros(len(rows))
        for f in range(folds):
            own = fold != f
            if own.all() or not own.any():
                unseen[~own] = y.mean() if len(y) else 0.0
                continue
            model = train_linear([s for s, o in zip(sets, own, strict=True) if o], earlier[own], y[own], features)
            unseen[~own] = model.scores([s for s, o in zip(sets, own, strict=True) if not o], earlier[~own])
        chain.append(train_linear(sets, earlier, y, features))
        earlier = np.c_[earlier, unseen]
    return chain


def score(docs: DataFrame, chain: list[Linear], key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """key, p_kind_1, p_kind_2, p_toxic and is_toxic of every document."""
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Features()
        for batch in batches:
            sets = list(word_sets((t.as_py() for t in batch.column(1)), numbers))
            some = np.array([len(s) > 0 for s in sets], bool)
            p = np.zeros((len(sets), 0))
            for model in chain:
                p = np.c_[p, model.scores(sets, p)]
            p = np.round(p * some[:, None], 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(len(names))], pa.array(p[:, -1] >= least)], [key, *names, "is_toxic"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` long, " + ", ".join(f"{n} double" for n in names) + ", is_toxic boolean")
