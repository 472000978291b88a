"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence, mapped through the cumulative weights of the sources, give every slot of the
schedule a source; the slots of a source are ranked in the order of the sequence. The documents of a source, shuffled by
a hash of their id and size, form a stream of words that is cut into blocks of equally many words; slot r of a source
takes block r of that stream, which starts again when it ends. So the mix is what the slots take, in their order, and a
source's words in it are those of the blocks that the sequence dealt to it. A source weighs as many slots as its target
has blocks. The sequence gives any interval its share of the points but for a few, so what is taken misses the target by
a few blocks; a source's blocks have ``block`` words or a 4,096th of its target, whichever is less, but one at least. A
slot beyond the last epoch (``most``) takes nothing, so no document is taken more often.

Positions in a stream are sums over hash ranges first and within them then, with as many ranges as the rows need, so no
task gets a whole source.

Defined results: the size of a text is its number of words between blanks (null: 0); documents of size 0 take part but
give nothing; a null source is a source of its own, last in order; a null id is shuffled as an empty one; rows that
repeat are documents of their own (equal ids and sizes are interchangeable); sources that are all empty have target 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import WORD, word_count

WORDS = re.compile(WORD)
#: The points are multiples of the golden ratio's fraction, in 31 bits: STEP is the odd number next to 2**31 times it.
PERIOD = 1 << 31
STEP = 1_327_217_885
#: Blocks that a source has at least, if it has as many words to give.
FINEST = 4096
#: Rows of a hash range on average; there are 64 ranges at least.
RANGE_ROWS = 50_000
#: A table with a row per source is broadcast up to this many sources.
BROADCAST_ROWS = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of (source, size): all words are shared by weight, but none gets more than ``most`` times its size.

    A source is full if its limit per weight is no more than the level at which all words are shared. Sources in the
    order of that limit are full up to some place, which running sums find. There is a row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("edge", F.col("limit") / F.col("weight"))
    order = Window.orderBy("edge", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.min(F.when(F.col("edge") > F.col("level"), F.struct("edge", "level"))).over(every))
    level = F.col("open.level")
    share = F.when(level.isNull() | (F.col("edge") < F.col("open.edge")), F.col("limit")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", F.least(share, F.col("limit")).alias("target"))


def plan(goal: DataFrame, block: int) -> DataFrame:
    """(no, source, source_size, block, per_epoch, slots, hi) of the sources that give words, in order: blocks, slots and where its slots end among all."""
    g = goal.where("source_size > 0 and target > 0")
    g = g.withColumn("block", F.expr(f"greatest(1L, least({block}L, cast(floor(target / {FINEST}) as long)))"))
    g = g.withColumn("per_epoch", F.ceil(F.col("source_size") / F.col("block")))
    g = g.withColumn("slots", F.greatest(F.lit(1).cast("long"), F.round(F.col("target") / F.col("source_size") * F.col("per_epoch")).cast("long")))
    up = Window.orderBy(F.col("source").asc_nulls_last())
    return g.select((F.row_number().over(up) - 1).alias("no"), "source", "source_size", "block", "per_epoch", "slots", F.sum("slots").over(up).alias("hi"))


def schedule(sources: DataFrame, most: float = 3.0, step: int = STEP) -> DataFrame:
    """(slot, no, rank, epoch, part): slot ``rank`` of source ``no`` takes block ``part`` of its stream for the ``epoch``-th time.

    ``sources`` is the checkpointed result of plan(). Slots are numbered in the order in which they are to be read.
    """
    spark = sources.sparkSession
    ends = np.array([r.hi for r in sources.select("no", "hi").orderBy("no").collect()], np.int64)  # one number per source
    total = int(ends[-1]) if len(ends) else 0
    edges = np.floor(ends / max(1, total) * float(PERIOD)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            points = (i + 1) % PERIOD * step % PERIOD
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(edges, points, side="right").astype(np.int32))], ["slot", "no"])

    # ranks within a source: by chunks of the sequence first, then within a chunk
    points = spark.range(total).mapInArrow(deal, "slot long, no int").withColumn("chunk", F.expr("slot div 4096"))
    counts = points.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    above = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).drop("n")
    ranked = points.withColumn("within", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts, ["no", "chunk"]).select("no", "slot", (F.col("before") + F.col("within")).alias("rank"))
    rows = ranked.join(small(sources.select("no", "per_epoch")), "no")
    rows = rows.withColumn("epoch", F.expr("rank div per_epoch")).withColumn("part", F.expr("rank % per_epoch"))
    return rows.where(F.col("epoch") < most).select("slot", "no", "rank", "epoch", "part")


def small(sources: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is no larger than that."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources


def streams(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, size and more) with ``begin``, the words of its source before it in the shuffled order."""
    ranges = max(64, docs.count() // RANGE_ROWS)
    mixed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    rows = docs.withColumn("h", mixed).withColumn("range", F.expr(f"cast(conv(substring(h, 1, 7), 16, 10) as long) * {ranges}L div 268435456L"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("own"))
    above = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("own").over(above), F.lit(0))).select(F.col("source").alias("s2"), F.col("range").alias("r2"), "before")
    inside = Window.partitionBy("source", "range").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    return rows.withColumn("begin", F.col("before") + F.col("within")).select(*docs.columns, "begin")


def placed(sized: DataFrame, goal: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, begin, no, part, lo, hi): a row per document and block it reaches into, with the words of the document there; one row without a block for what gives nothing."""
    g = goal.withColumnsRenamed({"source": "s3"})
    g = g.join(sources.select(F.col("source").alias("s4"), "no", "block"), F.col("s3").eqNullSafe(F.col("s4")), "left").drop("s4")
    g = checkpoint(g)
    rows = streams(sized).join(small(g), F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    rows = rows.withColumn("part", F.explode_outer(F.expr("if(size > 0, sequence(begin div block, (begin + size - 1) div block), null)")))
    lo, hi = F.greatest(F.lit(0), F.col("part") * F.col("block") - F.col("begin")), F.least("size", (F.col("part") + 1) * F.col("block") - F.col("begin"))
    return rows.withColumn("lo", lo).withColumn("hi", hi).drop("block")


def prepare(docs: DataFrame, text: str, block: int, weights: tuple[float, ...], most: float, step: int, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``placed`` and ``schedule`` give for the documents, with their texts as ``words`` if they are to be kept."""
    own = [F.col(text).alias("words")] if keep else []
    sized = checkpoint(docs.select("doc_id", "source", word_count(text).alias("size"), *own))
    goal = checkpoint(targets(sized, weights, most))
    sources = checkpoint(plan(goal, block))
    return placed(sized, goal, sources), schedule(sources, most, step)


def pieces(docs: DataFrame, text: str = "text", block: int = 8192, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, step: int = STEP) -> DataFrame:
    """The mix: (slot, doc_id, source, begin, lo, hi); read by slot and begin, words ``lo`` to ``hi`` of the documents. ``begin`` is the document's place in its source's stream."""
    parts, slots = prepare(docs, text, block, weights, most, step)
    return parts.join(slots, ["no", "part"]).select("slot", "doc_id", "source", "begin", "lo", "hi")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, doc_id, source, begin, lo, text) of rows with ``hi`` and whole ``words``: the text from word ``lo`` to word ``hi``, as it is between them."""
    for batch in batches:
        texts = []
        for whole, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("words", "lo", "hi")), strict=True):
            ends = [(m.start(), m.end()) for m in islice(WORDS.finditer(whole), lo, hi)]
            texts.append(whole[ends[0][0] : ends[-1][1]] if ends else "")
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("slot", "doc_id", "source", "begin", "lo")], pa.array(texts, pa.string())], ["slot", "doc_id", "source", "begin", "lo", "text"])


def write(docs: DataFrame, path: str, text: str = "text", block: int = 8192, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, step: int = STEP) -> DataFrame:
    """Write the mix itself as Parquet, in reading order within and between files: (slot, doc_id, source, begin, lo, text); return what was written.

    Each piece is the text from the words that a slot takes of a document. Files are ranges of slots, so no task sorts more than
    its own; a document that several slots take travels with each, which is ``most`` times the corpus at worst.
    """
    parts, slots = prepare(docs, text, block, weights, most, step, keep=True)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = parts.where("hi > lo").join(slots, ["no", "part"]).select("slot", "doc_id", "source", "begin", "lo", "hi", F.col("words").cast("string").alias("words"))
    rows = rows.mapInArrow(cut, f"slot long, doc_id {kinds['doc_id']}, source {kinds['source']}, begin long, lo long, text string")
    rows.repartitionByRange("slot", "begin").sortWithinPartitions("slot", "begin", "lo").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def mix(docs: DataFrame, text: str = "text", block: int = 8192, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, step: int = STEP) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document: the words that the slots take of it, repeats counted."""
    parts, slots = prepare(docs, text, block, weights, most, step)
    rows = parts.join(slots, ["no", "part"], "left").withColumn("got", F.when(F.col("slot").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0))
    # documents are apart by their place; those that give nothing may share one and are passed by
    some = rows.where("size > 0").groupBy("doc_id", "source", "size", "source_size", "target", "begin").agg(F.sum("got").cast("long").alias("taken")).drop("begin")
    none = parts.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)
