"""Substring dedup by sliding sentence spans.

From every sentence a span runs on, and back, over consecutive sentences until it has ``several`` (three) of them, or two
with ``words`` (20) words; so every sentence of a passage that holds a span is in a span inside the passage, no sentence is
a span by itself, and three sentences are one however short they are. Spans are hashed with 128 bits and joined over all documents; of a span that occurs more than once,
the first occurrence (least document id, then position) stays, and the sentences that any other occurrence covers are
removed.

Sentences end after . ! or ? and a blank, or at a line end; what separates them goes with the sentence before. Spans
compare words in lower case. Counts and first occurrences are partial sums on both sides of the shuffle; the join back
is one of plain rows, whose hot keys Spark splits.

Defined results: a text of one sentence, or of two with fewer words, has no span; a null text stays null and an empty one empty; a text that is removed whole is left empty; rows with one
id are told apart by their text, and equal rows each count as one document, cut alike; a row without an id comes after
those that have one; columns that are not named are
left alone, but those that are called n_sentences or n_removed, which the result's take the place of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import checkpoint

#: Blanks are matched from their start only, so a long run of them takes one pass.
BREAK = re.compile(r"(?<=[.!?])[\x20\t]+(?:\n\s*)?|(?<![\x20\t])[\x20\t]*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; together they are the text."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def spans(text: str, several: int = 3, words: int = 20) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, hash) of the distinct spans of a text."""
    parts = [text[s:e].lower().split() for s, e in sentences(text)]
    sizes = list(map(len, parts))
    found = set()
    for step in (1, -1):
        for i in range(len(parts)):
            j, n, count = i, 0, 0
            while 0 <= j < len(parts):
                n += sizes[j]
                count += sizes[j] > 0
                if count >= several or count > 1 and n >= words:
                    found.add((i, j + 1) if step > 0 else (j, i + 1))
                    break
                j += step
    joined = [" ".join(p) for p in parts]
    return [(a, b, xxhash.xxh3_128_digest(" ".join(x for x in joined[a:b] if x).encode("utf-8", "surrogatepass"))) for a, b in sorted(found)]


def span_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, copy, at, to, h1, h2): ``copy`` tells apart texts of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, at, to, span = [], [], [], []
            for n, t in enumerate(batch.column(2)):
                own = spans(t.as_py())
                owner += [n] * len(own)
                at += [a for a, _, _ in own]
                to += [b for _, b, _ in own]
                span += [h for _, _, h in own]
            index = pa.array(owner, pa.int64())
            half = np.frombuffer(b"".join(span), ">i8").astype(np.int64).reshape(-1, 2)  # two numbers stand for the hash
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array(half[:, 0]), pa.array(half[:, 1])], ["id", "copy", "at", "to", "h1", "h2"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("copy"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, copy long, at int, to int, h1 long, h2 long")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, copy, ranges): the sentence ranges that other than first occurrences cover, of every document that has any."""
    rows = span_rows(docs, key, text)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("copy"), F.col("at"))
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    first = checkpoint(first)  # with an exchange of its own the join can split the rows of a hot span
    later = rows.join(first, ["h1", "h2"]).where(~(place.eqNullSafe(F.col("first"))))
    return later.groupBy("id", "copy").agg(F.collect_set(F.struct("at", "to")).alias("ranges"))


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns, ``text`` without the sentences of repeated spans, n_sentences and n_removed."""
    docs = docs.drop("n_sentences", "n_removed")
    taken = {c.lower() for c in docs.columns}
    own = {c: next(n for k in range(len(taken) + 1) if (n := c + "_" * k) not in taken) for c in ("id", "copy", "ranges")}
    cuts = repeated(docs, key, text).toDF(*own.values())
    same = docs[key].cast("long").eqNullSafe(cuts[own["id"]]) & (F.xxhash64(docs[text]) == cuts[own["copy"]])
    rows = docs.join(cuts, same, "left").select(*[docs[c] for c in docs.columns], own["ranges"])
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for t, ranges in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                t, ranges = t.as_py(), ranges.as_py()
                parts = sentences(t) if t else []
                gone = {i for r in ranges or () for i in range(r["at"], r["to"])}
                texts.append("".join(t[s:e] for i, (s, e) in enumerate(parts) if i not in gone) if gone else t)
                total.append(len(parts))
                removed.append(len(gone))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_sentences", "n_removed"])

    schema = StructType([*docs.schema.fields]).add("n_sentences", LongType()).add("n_removed", LongType())
    return rows.mapInArrow(run, schema)
