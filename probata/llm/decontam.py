"""Benchmark decontamination: a BM25 index of test items that every passage of the training texts queries.

Items are documents of the index; a passage (a window of words, half overlapping the next, at least twice as long as
any item) is a query of its distinct words. Weights are BM25's, divided by what an item scores against itself, so a
score is the share of an item that a passage has, from 0 to 1. Retrieval is exact: everything at or above the threshold
is found. Items are numbered in blocks; the largest weight of a word in a block bounds what any item there can score.
A text whose words can't reach the threshold in any block is passed over, then a passage likewise; a passage that is
left walks the postings with block-max WAND. What is retrieved is verified: of the item's question (all sentences but
the last) and of its answer (the last sentence; of an item of one sentence, its second half) enough word trigrams have
to occur in the passage.

The index is built on the driver from one shard of the items at a time, and shipped with the tasks; the number of shards
follows from the characters of all items, so its size is bounded whatever the benchmark's. Frequencies, the number of
items, their mean length and the longest of them, from which the passages' length follows, are those of all items, so
neither passages nor scores depend on the shards; if there are several, the
result of each is written before the next index is built, so the driver holds one at a time.

Defined results: null and empty texts have no passage; items without a word are never found; an item without an id is
found like any other, with a null item_id; an item in several passages of a text counts once, at its best; rows that
repeat are judged each by itself, items too; other columns pass through unread.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

BLOCK = 2
EPS = 1e-9
INNER = re.compile(r"\w(?:.*\w)?", re.DOTALL)
DENSE = 4_000_000


def core(token: str) -> str:
    """A token in lower case without what is no letter, digit or underscore at its ends."""
    m = INNER.search(token.lower())  # from the first to the last, which takes one pass each way
    return m[0] if m else ""


def words_of(text: str) -> list[str]:
    """The tokens between blanks that have a core."""
    return [w for t in text.split() if (w := core(t))]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def check_of(words: list[str]) -> tuple[int, set[tuple[str, ...]]]:
    """The trigrams of a part of an item, or the whole part if it is shorter."""
    n = min(3, len(words))
    return n, grams(words, n) if n else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer of an item."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    half = (len(words) + 1) // 2
    return words[:half], words[half:] or words[:half]


@dataclass
class Rows:
    """Rows of numbers of different lengths: row i is at[i]:at[i + 1]."""

    at: np.ndarray
    column: np.ndarray
    weight: np.ndarray

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each entry of ``rows``: its place in ``rows``, column and weight."""
        size = self.at[rows + 1] - self.at[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[rows], size)
        return owner, self.column[place], self.weight[place]


def _rows(lists: list[list[tuple[int, float]]]) -> Rows:
    return Rows(np.cumsum([0, *map(len, lists)]), np.array([c for x in lists for c, _ in x], np.int64), np.array([w for x in lists for _, w in x], float))


class _Numbers(dict):
    """Token -> number of its core among the terms, or -1; forgets all when it holds 200,000."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[token] = self.terms.get(core(token), -1)
        return n

    def __reduce__(self):
        return (_Numbers, (self.terms,))


class Index:
    """Inverted BM25 index of items (id, text); ``every`` has the figures of all items if these are a shard of them: how many hold a term, their number, mean length and longest."""

    def __init__(self, items: list[tuple[int | None, str]], k1: float = 1.2, b: float = 0.75, every: tuple[dict[str, int], int, float, int] | None = None) -> None:
        bags = [(i, Counter(words_of(t)), t) for i, t in items]
        bags = sorted(((i, c, t) for i, c, t in bags if c), key=lambda x: (sum(x[1].values()), x[0] is None, x[0] or 0, x[2]))
        self.ids = [i for i, _, _ in bags]
        self.checks = [tuple(map(check_of, parts(t))) for _, _, t in bags]
        own = Counter(w for _, c, _ in bags for w in c)
        self.terms = {w: n for n, w in enumerate(sorted(own))}
        sizes = [sum(c.values()) for _, c, _ in bags]
        found, count, mean, self.longest = every or (own, len(bags), sum(sizes) / max(1, len(sizes)), max(sizes, default=0))
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for n, (_, c, _) in enumerate(bags):
            length = sum(c.values())
            raw = {w: math.log(1 + (count - found[w] + 0.5) / (found[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean)) for w, f in c.items()}
            total = sum(raw.values())
            for w, x in raw.items():
                lists[self.terms[w]].append((n, x / total))
        self.postings = [([c for c, _ in x], [w for _, w in x]) for x in lists]
        self.block_max = []
        for x in lists:
            tops: dict[int, float] = {}
            for c, w in x:
                tops[c // BLOCK] = max(w, tops.get(c // BLOCK, 0))
            self.block_max.append(tops)
        self.bounds = _rows([sorted(x.items()) for x in self.block_max])
        self.most = [max(x.values()) for x in self.block_max]
        self.blocks = len(bags) // BLOCK + 1
        self.numbers = _Numbers(self.terms)
        self.dense = None
        if len(self.terms) * self.blocks <= DENSE:
            self.dense = np.zeros((len(self.terms), self.blocks))
            self.dense[np.repeat(np.arange(len(self.terms)), np.diff(self.bounds.at)), self.bounds.column] = self.bounds.weight

    def block_sums(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each group of terms (they begin at ``starts``): the most that the items of each block can score."""
        if self.dense is not None:
            return np.add.reduceat(self.dense[terms], starts, axis=0)
        owner, block, weight = self.bounds.gather(terms)
        group = np.searchsorted(starts, owner, side="right") - 1
        return np.bincount(group * self.blocks + block, weight, len(starts) * self.blocks).reshape(len(starts), self.blocks)

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (item number, score) of at least ``least`` for a query of distinct terms."""
        found = []
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]  # item, place, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for item, _, t in cursors:
                bound += self.most[t]
                if bound >= least - EPS:
                    pivot = item
                    break
            if pivot is None:
                break
            before = [c for c in cursors if c[0] <= pivot]
            block = pivot // BLOCK
            if sum(self.block_max[t].get(block, 0.0) for _, _, t in before) < least - EPS:
                # nothing in what is left of this block before the next list begins
                to = min([(block + 1) * BLOCK, *[c[0] for c in cursors if c[0] > pivot]])
            elif before[0][0] == pivot:
                score = sum(self.postings[t][1][at] for _, at, t in before)
                if score >= least - EPS:
                    found.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for c in before:
                if c[0] < to:
                    items = self.postings[c[2]][0]
                    c[1] = bisect.bisect_left(items, to, c[1])
                    c[0] = items[c[1]] if c[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def search(self, text: str, least: float, window: int, question: float, answer: float) -> list[tuple[int, float, float, float]]:
        """(item id, score, share of the question, share of the answer) of the verified items in ``text``, each once."""
        tokens = text.split()
        known = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return []
        known = known[at]
        alive = self.block_sums(np.flatnonzero(np.bincount(known)), np.zeros(1, np.int64))[0] >= least - EPS
        if not alive.any():
            return []
        window = max(window, 2 * self.longest)
        step = window // 2
        # passage p has tokens p * step .. p * step + window, so a token is in passages at // step and the one before
        n = max(1, -(-len(tokens) // step) - 1)
        late = at // step
        pairs = np.unique(np.concatenate([np.minimum(late, n - 1), np.minimum(np.maximum(late - 1, 0), n - 1)]) * len(self.terms) + np.tile(known, 2))
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        hot = passage[starts][(self.block_sums(term, starts)[:, alive] >= least - EPS).any(axis=1)]
        best: dict[int, tuple[int, float, float, float]] = {}
        for p in hot.tolist():
            inside: dict[int, set[tuple[str, ...]]] = {}
            for item, score in self.wand(term[passage == p].tolist(), least):
                for size, _ in self.checks[item]:
                    if size not in inside:
                        inside[size] = grams([w for t in tokens[p * step : p * step + window] if (w := core(t))], size)
                q, a = ((len(x & inside[size]) / len(x) if x else 0.0) for size, x in self.checks[item])
                if q >= question - EPS and a >= answer - EPS:
                    best[item] = max(best.get(item, (0,)), (self.ids[item], round(score, 6), round(q, 6), round(a, 6)), key=lambda x: x[1:])
        return [best[item] for item in sorted(best)]


def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, words, length) of items (shard, t): the distinct words and how many there are."""
    for batch in batches:
        words = [words_of(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())), pa.array(list(map(len, words)), pa.int64())], ["shard", "words", "length"])


def indexes(benchmark: DataFrame, key: str, text: str, shard_chars: int) -> tuple[int, Iterator[Index]]:
    """How many shards there are, and an index for each; a shard has about ``shard_chars`` characters."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    shards = int((rows.agg(F.sum(F.length("t"))).first()[0] or 0) // shard_chars) + 1
    collected = lambda df: [(r.k, r.t) for r in df.collect()]
    if shards == 1:
        return 1, iter([Index(collected(rows))])
    rows = stored(rows.withColumn("shard", F.pmod(F.xxhash64("k", "t"), F.lit(shards)).cast("int")), "items")
    bags = stored(rows.select("shard", "t").mapInArrow(item_words, "shard int, words array<string>, length long").where("length > 0"), "item-words")
    total = bags.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    words = bags.select("shard", F.explode("words").alias("w"))
    often = stored(words.groupBy("w").agg(F.count("*").cast("long").alias("n")), "item-terms")

    def each() -> Iterator[Index]:
        for s in range(shards):
            own = often.join(words.where(F.col("shard") == s).select("w").distinct(), "w", "left_semi").collect()  # the words of one shard
            yield Index(collected(rows.where(F.col("shard") == s)), every=({r.w: r.n for r in own}, total.n, total.mean or 1.0, total.longest or 0))

    return shards, each()


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = 0.6, window: int = 128, question: float = 0.6, answer: float = 0.6, shard_chars: int = 16_000_000) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap) of every test item that a document has."""

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, rows = [], []
                for n, t in enumerate(batch.column(1)):
                    hits = index.search(t.as_py(), least, window, question, answer)
                    owner += [n] * len(hits)
                    rows += hits
                cols = [pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.float64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *cols], [key, "item_id", "score", "question_overlap", "answer_overlap"])

        return run

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"))
    out = None
    shards, every = indexes(benchmark, item, item_text, shard_chars)
    for index in every:
        found = rows.mapInArrow(finder(index), f"`{key}` long, item_id long, score double, question_overlap double, answer_overlap double")
        found = stored(found, "contaminated") if shards > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: float = 0.6, window: int = 128, question: float = 0.6, answer: float = 0.6, shard_chars: int = 16_000_000) -> DataFrame:
    """The documents that have no test item, with all their columns; nothing is shuffled."""

    def dropper(index: Index, column: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not (t.is_valid and index.search(t.as_py(), least, window, question, answer)) for t in batch.column(column)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    shards, every = indexes(benchmark, item, item_text, shard_chars)
    for index in every:
        docs = docs.mapInArrow(dropper(index, docs.columns.index(text)), docs.schema)
        docs = stored(docs, "clean") if shards > 1 else docs
    return docs
