"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram (a letter between its two neighbours, a word edge counting
as a letter of its own) binds the three vectors after shifting them by two, one and no places; a text bundles
(adds) its trigrams' vectors; a language's prototype bundles the unit vectors of its training texts. A text gets
the language whose prototype has the largest cosine with it.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the language first by
code point; texts of training rows with null language are not learned from; without any training row every text
is ``und``. Rows are never merged, and columns that are not named are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: A training text adds its unit vector times this, rounded, so that sums don't depend on the order of rows.
UNIT = 1 << 20


@dataclass
class LetterSpace:
    """Vectors of letters and of the trigrams met so far; all follow from ``seed`` and the code points alone."""

    dims: int = 1024
    seed: int = 7
    most_rows: int = 32_768
    most_letters: int = 4096
    letters: dict[int, int] = field(default_factory=lambda: {0: 0})
    rows: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.number = np.full(0x110000, -1, np.int32)  # code point -> letter number, 0 for what is no letter
        self.codes = [0]  # letter number -> code point
        self.base: dict[int, np.ndarray] = {}  # vectors of letters, as many as most_letters
        self.table = np.full(1 << 21, -1, np.int32)  # trigram of letter numbers under 128 -> row
        self.vectors = np.zeros((1024, self.dims), np.float32)

    def _random(self, code: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dims).astype(np.float32) * 2 - 1

    def _learn_letters(self, codes: np.ndarray) -> None:
        for c in np.unique(codes):
            ch = chr(c)
            if not unicodedata.category(ch).startswith("L"):
                self.number[c] = 0
                continue
            low = ord(ch.lower()[0])
            if low not in self.letters:
                self.letters[low] = len(self.letters)
                self.codes.append(low)
            self.number[c] = self.letters[low]

    def _of_letters(self, numbers: np.ndarray) -> np.ndarray:
        """The vectors of letters; those not kept are made again."""
        kinds, back = np.unique(numbers, return_inverse=True)
        out = np.empty((len(kinds), self.dims), np.float32)
        for i, n in enumerate(kinds.tolist()):
            v = self.base.get(n)
            if v is None:
                v = self._random(self.codes[n])
                if len(self.base) < self.most_letters:
                    self.base[n] = v
            out[i] = v
        return out[back]

    def _bound(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF
        return np.roll(self._of_letters(a), 2, axis=1) * np.roll(self._of_letters(b), 1, axis=1) * self._of_letters(c)

    def _learn_trigrams(self, keys: np.ndarray) -> None:
        if len(self.rows) + len(keys) > self.most_rows:  # a bound on memory, not on what is counted
            self.rows.clear()
            self.table[:] = -1
        first = len(self.rows)
        while len(self.vectors) < first + len(keys):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        for lo in range(0, len(keys), 2048):
            part = keys[lo : lo + 2048]
            self.vectors[first + lo : first + lo + len(part)] = self._bound(part)
        for i, k in enumerate(keys.tolist()):
            self.rows[k] = first + i
        a, b, c = keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF
        small = (a < 128) & (b < 128) & (c < 128)
        self.table[(a << 14 | b << 7 | c)[small]] = np.arange(first, first + len(keys), dtype=np.int32)[small]

    def encode(self, texts: list[str]) -> np.ndarray:
        """One bundled vector per text; zero where a text has no letter."""
        codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = self.number[codes]
        if (n < 0).any():
            self._learn_letters(codes[n < 0])
            n = self.number[codes]
        at = np.flatnonzero(n)
        out = np.zeros((len(texts), self.dims), np.float32)
        if not len(at):
            return out
        doc = np.searchsorted(np.cumsum([1 + len(t) for t in texts]), at, side="left")
        a, b, c = n[at - 1].astype(np.int64), n[at].astype(np.int64), n[at + 1].astype(np.int64)
        if len(self.letters) <= 128:
            key = a << 14 | b << 7 | c
            row = self.table[key]
            if (row < 0).any():
                new = np.unique(key[row < 0])
                if len(self.rows) + len(new) > self.most_rows:
                    new = np.unique(key)
                self._learn_trigrams((new >> 14) << 42 | (new >> 7 & 127) << 21 | new & 127)
                row = self.table[key]
        else:
            keys, back = np.unique(a << 42 | b << 21 | c, return_inverse=True)
            if len(keys) > self.most_rows:  # more kinds than the cache holds: bundle them a part at a time
                return self._encode_wide(keys, back, doc, out)
            new = np.array([k for k in keys.tolist() if k not in self.rows], np.int64)
            if len(self.rows) + len(new) > self.most_rows:
                new = keys
            if len(new):
                self._learn_trigrams(new)
            row = np.array([self.rows[k] for k in keys.tolist()], np.int64)[back]
        width = len(self.rows)
        counts = np.bincount(doc * width + row, minlength=len(texts) * width).reshape(len(texts), width)
        return counts.astype(np.float32) @ self.vectors[:width]

    def _encode_wide(self, keys: np.ndarray, back: np.ndarray, doc: np.ndarray, out: np.ndarray) -> np.ndarray:
        for lo in range(0, len(keys), 2048):
            part = keys[lo : lo + 2048]
            v = self._bound(part)
            inside = (back >= lo) & (back < lo + len(part))
            counts = np.bincount(doc[inside] * len(part) + back[inside] - lo, minlength=len(out) * len(part)).reshape(len(out), len(part))
            out += counts.astype(np.float32) @ v
        return out


@dataclass(frozen=True)
class Prototypes:
    """``vectors[i]`` is the unit prototype of ``labels[i]``."""

    labels: list[str]
    vectors: np.ndarray
    dims: int
    seed: int


def fit(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", dims: int = 1024, seed: int = 7) -> Prototypes:
    """Prototypes from all rows where ``training`` holds and ``lang`` is given. What reaches the driver is labels x dims sums."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = LetterSpace(dims, seed), {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for texts in chunks(batch.column(0).to_pylist()):
                v = space.encode(texts)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.rint(v / np.where(size > 0, size, 1) * UNIT).astype(np.int64)
                own = np.array(langs[at : at + len(texts)], object)
                for k in set(own):
                    sums[k] = sums.get(k, 0) + v[own == k].sum(axis=0)
                at += len(texts)
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(s)], ["label", "dim", "part"])

    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sums = rows.mapInArrow(bundle, "label string, dim int, part long").groupBy("label", "dim").agg(F.sum("part").alias("part")).toPandas()
    labels = sorted(set(sums["label"]))
    vectors = np.zeros((len(labels), dims))
    vectors[[labels.index(x) for x in sums["label"]], sums["dim"].to_numpy(int)] = sums["part"]
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Prototypes(labels, (vectors / np.where(size > 0, size, 1)).astype(np.float32), dims, seed)


def predict(docs: DataFrame, model: Prototypes, key: list[str], text: str = "text") -> DataFrame:
    """The columns ``key`` with ``lang_pred`` and ``score`` (the cosine, from 0 to 1) of every row."""
    spots = model.vectors.T.copy()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = LetterSpace(model.dims, model.seed)
        for batch in batches:
            labels, scores = [], []
            for texts in chunks(batch.column(batch.num_columns - 1).to_pylist()):
                v = space.encode(texts)
                size = np.linalg.norm(v, axis=1)
                if model.labels:
                    cos = np.round((v @ spots) / np.where(size > 0, size, 1)[:, None], 5)
                    best = cos.argmax(axis=1)
                    score = np.clip(cos[np.arange(len(texts)), best].astype(float), 0, 1)
                else:
                    best, score, size = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                labels += [model.labels[b] if s > 0 else "und" for b, s in zip(best, size, strict=True)]
                scores += [round(x, 5) if s > 0 else 0.0 for x, s in zip(score.tolist(), size, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*key, "lang_pred", "score"])

    kept = docs.select(*[F.col(k) for k in key], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(name, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Prototypes, text: str = "text", least: float = 0.05) -> DataFrame:
    """The documents, with all their columns, that have a letter and a cosine of ``least`` or more with some language."""
    spots, at = model.vectors.T.copy(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = LetterSpace(model.dims, model.seed)
        for batch in batches:
            good: list[bool] = []
            for texts in chunks(batch.column(at).to_pylist()):
                v = space.encode(texts)
                size = np.linalg.norm(v, axis=1)
                best = (v @ spots).max(axis=1, initial=0) / np.where(size > 0, size, 1)
                good += (best >= least).tolist()
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out that have an id."""
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
