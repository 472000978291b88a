"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Every run of five words is labelled with its number among its equals in the text. A sketch takes the two labelled runs
with the least hashes, keeps them in the order of the text and hashes that pair: two texts agree in a sketch only if
they share the sampled runs in the same order, so agreement follows edit similarity. Texts that agree in any sketch are
candidates; they are linked if their words align with similarity 1 - edits / longer length >= 0.8. Two texts that differ
in one word of five share about a fifth of their runs, hence agree in a sketch with probability 0.038 and in any of 96
with 0.97; at a similarity of 0.9 it is more than 0.999.

Two thirds of these sketches take five words in a row, one third five words with gaps (of eleven or thirteen), which
outlive words that are replaced at even distances, where no five in a row are left. Of texts under 64 words too few runs of
five outlive an edit in five words: they are sketched by runs of three words, and under 12 words of two. The lengths of
these kinds of sketches overlap by a quarter, so two near texts always have one in common.

How groups stay bounded: equal texts become one node first (partial sums on each side of the shuffle). In a bucket of
candidates every text is compared with the bucket's first node, its centre. Where a text is linked to its centre neither
so nor through others, the texts that met this centre are held against each other: they are cut into blocks of bounded
size by length and salt, any two blocks whose lengths allow a link meet in one task, and a task aligns the pairs that
aren't linked yet and that counts of hashed words can't rule out. It returns links between parts only, at most one a
text, so rows grow with the texts and not with their pairs. No group is cut: every two texts of a bucket are linked
through others, aligned, or ruled out by an exact bound. Classes are the connected components of the links.

Defined results: a null text belongs to no group (its class is its own id); empty texts are equal texts; texts with
fewer words than a run count as one run; words are compared in lower case. Rows are judged by their texts: an id that comes with
several texts is in the class of each. A row with a null id is in the class of its text, and null is its class only if no
document of the class has an id. Columns that are not named are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import checkpoint, removed, scratch, stored
from .align import bag_bound, banded_distance

BLOCK = 32_768
#: Characters of texts that meet in one task, from each of two blocks.
BLOCK_CHARS = 8_000_000
#: Texts that meet in one task, from each of two blocks: in a block a text counts with the block's characters over this at least.
#: As many texts of which none is near another take a task about a minute and a half.
BLOCK_TEXTS = 16_384
#: Counts of words by the lowest bits of their hashes, of which a task bounds edits.
SLOTS = 64


@dataclass(frozen=True)
class Family:
    """Sketches of texts of ``low`` to ``high`` words, by runs of the words at these offsets."""

    low: int
    high: int
    offsets: tuple[int, ...]
    sketches: int


FAMILIES = (
    Family(64, 1 << 62, (0, 1, 2, 3, 4), 64),
    Family(64, 1 << 62, (0, 1, 5, 6, 10), 16),
    Family(64, 1 << 62, (0, 1, 6, 7, 12), 16),
    Family(10, 79, (0, 1, 2), 64),
    Family(0, 14, (0, 1), 48),
)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds 200,000."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def labelled_runs(words: np.ndarray, k: int | Sequence[int]) -> np.ndarray:
    """Hashes of the runs of ``k`` words, or of the words at the offsets ``k``, each with its number among its equals; of a shorter text the offsets that it has make one run or more."""
    n = len(words)
    offsets = [i for i in (range(k) if isinstance(k, int) else k) if i < n]
    if not n:
        return words
    count = n - max(offsets)
    run = np.zeros(count, np.uint64)
    for i in offsets:
        run = run * np.uint64(0x100000001B3) + words[i : i + count]
    run = mixed(run)
    order = np.argsort(run, kind="stable")
    s = run[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if not first.all():
        number = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        again = number > 0
        run[order[again]] = mixed(s[again] + number[again].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return run


def order_minhash(runs: np.ndarray, seeds: np.ndarray, take: int) -> np.ndarray:
    """One key per seed: the hash of the ``take`` least runs in the order of the text.

    A run's value for a seed is the upper half of its hash times the seed's, modulo 2**32: the runs are mixed already.
    """
    if not len(runs):
        return np.zeros(0, np.int64)
    factor, half = (seeds >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), (runs >> np.uint64(32)).astype(np.uint32)
    found, places = [], []
    rows = np.arange(len(seeds))
    for at in range(0, len(runs), BLOCK):
        h = half[None, at : at + BLOCK] * factor
        for _ in range(min(take, h.shape[1])):
            i = h.argmin(axis=1)
            found.append(h[rows, i])
            places.append(i + at)
            h[rows, i] = np.uint32(0xFFFFFFFF)
    value, place = np.stack(found, 1), np.stack(places, 1)
    if value.shape[1] > take:
        least = np.argsort(value, axis=1, kind="stable")[:, :take]
        place = np.take_along_axis(place, least, 1)
    place.sort(axis=1)
    key = seeds.copy()
    for i in range(place.shape[1]):
        key = mixed(key * np.uint64(0x100000001B3) + runs[place[:, i]])
    return key.view(np.int64)


def seeds_of(sketches: int) -> np.ndarray:
    return mixed(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def digest(text: str | Column) -> Column:
    return F.unhex(F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256))


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, sha, text) of every row with a text."""
    return docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), digest(text).alias("sha"), F.col(text).alias("text"))


def sketches_of(words: np.ndarray, take: int = 2, families: Sequence[Family] = FAMILIES) -> np.ndarray:
    """The keys of a text's hashed words in all families for its length; each family has seeds of its own."""
    seeds, at, out = seeds_of(sum(f.sketches for f in families)), 0, [np.zeros(0, np.int64)]
    for f in families:
        if f.low <= len(words) <= f.high:
            out.append(order_minhash(labelled_runs(words, f.offsets), seeds[at : at + f.sketches], take))
        at += f.sketches
    return np.concatenate(out)


def sketch(rows: DataFrame, take: int, families: Sequence[Family]) -> DataFrame:
    """(id, sha, n, chars, keys) of rows (id, sha, text): words, characters and sketches of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, chars, keys = [], [], []
            for t in batch.column(2):
                t = t.as_py()
                w = hashes.of(t)
                sizes.append(len(w))
                chars.append(len(t))
                keys.append(sketches_of(w, take, families))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(chars, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "sha", "n", "chars", "keys"])

    return rows.mapInArrow(run, "id long, sha binary, n long, chars long, keys array<long>")


def allowed(n: int, similarity: float) -> int:
    """Edits that two texts may differ by if the longer one has ``n`` words."""
    return int(n * (1 - similarity) + 1e-9)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, center) of the pairs that align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py().lower().split(), y.as_py().lower().split()
                most = allowed(max(len(x), len(y)), similarity)
                near.append(abs(len(x) - len(y)) <= most and bag_bound(x, y) <= most and banded_distance(x, y, most) is not None)
            yield batch.filter(pa.array(near, pa.bool_())).select(["node", "center"])

    side = lambda i: texts.select(F.col("node").alias(i), F.col("text").alias(f"text_{i}"))
    return pairs.join(side("node"), "node").join(side("center"), "center").select("node", "center", "text_node", "text_center").mapInArrow(run, "node long, center long")


def links_within(words: list[np.ndarray], part: list[int], block: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts that align and, together with ``part`` (numbers of what is linked already), link all that can be.

    If there are two blocks, only pairs across them are looked at. What is ruled out without alignment can't align: an
    edit changes the counts of words, hashed to slots, by 2 at most, and the difference in length takes edits that
    change them by 1.
    """
    sizes = np.array(list(map(len, words)), np.int64)
    order = np.argsort(sizes, kind="stable")
    n, own = sizes[order], np.array(block)[order]
    slots = np.stack([np.bincount((words[i] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS) for i in order]).astype(np.int32)
    most = (n * (1 - similarity) + 1e-9).astype(np.int64)
    across = len(set(block)) > 1
    root = {p: p for p in part}
    parts = np.array(part)[order]
    bags: dict[int, Counter] = {}
    lists: dict[int, list] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def bag(i: int) -> Counter:
        if i not in bags:
            lists[i] = words[order[i]].tolist()
            bags[i] = Counter(lists[i])
        return bags[i]

    out = []
    for i in range(1, len(order)):
        first = int(np.searchsorted(n, n[i] - most[i]))  # the shortest that is long enough
        if first == i:
            continue
        may = parts[first:i] != parts[i]
        if across:
            may &= own[first:i] != own[i]
        at = first + np.flatnonzero(may)
        if not len(at):
            continue
        apart = np.abs(slots[at] - slots[i]).sum(axis=1)
        fits = apart <= 2 * most[i] - (n[i] - n[at])
        at, apart = at[fits], apart[fits]
        for j in at[np.argsort(apart, kind="stable")].tolist():
            if find(int(parts[i])) == find(int(parts[j])):
                continue
            e, a, b = int(most[i]), bag(i), bag(j)
            if n[i] - sum((a & b).values()) <= e and banded_distance(lists[i], lists[j], e) is not None:
                out.append((int(order[i]), int(order[j])))
                root[find(int(parts[i]))] = find(int(parts[j]))
    return out


def blocks_of(open_rows: DataFrame, similarity: float, block_chars: int) -> DataFrame:
    """(center, a, b, own, node, component): every text of a centre once for each pair of blocks (a, b) it belongs to.

    If the texts of a centre have no more than ``block_chars`` characters, they are one block; a text counts with a
    BLOCK_TEXTS-th of that at least, which bounds the texts of a block too. Otherwise blocks are made
    by length, in steps within which a near text is at most one step away, and by salt within a step.
    """
    open_rows = open_rows.withColumn("chars", F.greatest("chars", F.lit(block_chars // BLOCK_TEXTS)))
    whole = checkpoint(open_rows.groupBy("center").agg(F.sum("chars").alias("total")))  # with an exchange of its own the join can split a hot centre
    rows = open_rows.join(whole, "center")
    small = rows.where(F.col("total") <= block_chars)
    large = rows.where(F.col("total") > block_chars).withColumn("step", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(-np.log(similarity)) + F.lit(1e-9)))
    steps = large.groupBy("center", "step").agg(F.greatest(F.ceil(F.sum("chars") / block_chars), F.lit(1)).cast("long").alias("salts"))
    steps = steps.groupBy("center").agg(F.map_from_entries(F.collect_list(F.struct("step", "salts"))).alias("salts"))  # as many entries as steps
    large = large.join(checkpoint(steps), "center").withColumn("salt", F.expr("pmod(xxhash64(node), salts[step])"))
    name = lambda step, salt: F.struct(step.alias("step"), salt.alias("salt"))
    own = name(F.col("step"), F.col("salt"))
    others = F.expr("filter(array(step - 1, step, step + 1), s -> map_contains_key(salts, s))")
    others = F.flatten(F.transform(others, lambda s: F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("salts", s) - 1), lambda t: name(s, t))))
    large = large.withColumn("own", own).withColumn("other", F.explode(others))
    columns = lambda df, a, b: df.select("center", a.alias("a"), b.alias("b"), F.xxhash64("own").alias("own"), "node", "component")
    none = name(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return columns(small.withColumn("own", none), none, none).unionByName(columns(large, F.least("own", "other"), F.greatest("own", "other")))


def unlinked(met: DataFrame, linked: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, block_chars: int) -> DataFrame:
    """(node, center): links between texts of one centre that aren't in one component of ``linked``."""
    rows = met.unionByName(met.select("center").distinct().select(F.col("center").alias("node"), "center"))
    rows = rows.join(nodes.select("node", "n", "chars"), "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = checkpoint(rows)
    # a centre whose texts are linked all is done
    todo = checkpoint(rows.groupBy("center").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("center"))
    blocks = blocks_of(checkpoint(rows.join(todo, "center", "left_semi")), similarity, block_chars)

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_pylist()
        found = []
        if len(set(table.column("component").to_pylist())) > 1:
            hashes = WordHashes()
            words = [hashes.of(t.as_py()) for t in table.column("text")]
            found = links_within(words, table.column("component").to_pylist(), table.column("own").to_pylist(), similarity)
        return pa.table([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], ["node", "center"])

    rows = blocks.join(texts, "node").select("center", "a", "b", "own", "node", "component", "text")
    return rows.groupBy("center", "a", "b").applyInArrow(run, "node long, center long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", take: int = 2, families: Sequence[Family] = FAMILIES, similarity: float = 0.8, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(id, sha) of every row with a text, and (sha, copy_of, class_id, class_sha) of every different text: the least ids of the text and of its class, and the least digest of the class's texts that have its least id."""
    spark, seen = docs.sparkSession, digests(docs, key, text)
    texts_of = sketch(seen, take, families).groupBy("sha").agg(F.min("id").alias("copy_of"), F.first("n").alias("n"), F.first("chars").alias("chars"), F.first("keys").alias("keys"))
    texts_of.withColumn("node", F.monotonically_increasing_id()).write.parquet(keyed := scratch(spark, "omh-keys"))  # numbers are fixed by writing them

    members = spark.read.parquet(keyed).select(F.explode("keys").alias("bucket"), "node")
    stars = checkpoint(members.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1").select("bucket", "center"))
    met = checkpoint(members.join(stars, "bucket").where("node <> center").select("node", "center").distinct())
    nodes = stored(spark.read.parquet(keyed).drop("keys"), "omh-nodes")
    removed(spark, keyed)
    involved = nodes.join(met.select("node").unionByName(met.select(F.col("center").alias("node"))).distinct(), "node", "left_semi")
    texts = stored(seen.select("sha", "text").join(involved.select("sha", "node"), "sha").dropDuplicates(["node"]).select("node", "text"), "omh-texts")
    size = lambda i: nodes.select(F.col("node").alias(i), F.col("n").alias(f"n_{i}"))
    close = F.abs(F.col("n_node") - F.col("n_center")) <= F.floor(F.greatest("n_node", "n_center") * F.lit(1 - similarity) + F.lit(1e-9))
    pairs = met.join(size("node"), "node").join(size("center"), "center").where(close).select("node", "center")
    linked = checkpoint(components(checkpoint(verify(pairs, texts, similarity)), "node", "center"))
    more = checkpoint(unlinked(met, linked, nodes, texts, similarity, block_chars))
    groups = nodes.select("node", "sha", "copy_of").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not more.isEmpty():  # what these links join are components, of which there are far fewer than texts
        side = lambda i: linked.select(F.col("node").alias(i), F.col("component").alias(f"of_{i}"))
        ends = more.join(side("node"), "node", "left").join(side("center"), "center", "left")
        joined = components(ends.select(F.coalesce("of_node", "node").alias("a"), F.coalesce("of_center", "center").alias("b")), "a", "b").toDF("component", "whole")
        groups = groups.join(joined, "component", "left").select("node", "sha", "copy_of", F.coalesce("whole", "component").alias("component"))
    groups = checkpoint(groups)
    least = checkpoint(groups.groupBy("component").agg(F.min(F.when(F.col("copy_of").isNotNull(), F.struct("copy_of", "sha"))).alias("least")))
    return seen.select("id", "sha"), groups.join(least, "component").select("sha", "copy_of", F.col("least.copy_of").alias("class_id"), F.col("least.sha").alias("class_sha"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: ``key``, copy_of (least id with the same text), class_id (least id of its group), is_kept (whether that is its own)."""
    seen, found = classes(docs, key, text, **options)
    out = seen.join(stored(found, "omh-found"), "sha").select("id", "copy_of", "class_id")
    none = docs.where(F.col(text).isNull()).select(F.col(key).cast("long").alias("id"))
    out = out.unionByName(none.select("id", F.col("id").alias("copy_of"), F.col("id").alias("class_id")))
    return out.select(F.col("id").alias(key), "copy_of", "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("is_kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group, with the columns of ``docs``: a row of the text with the least digest that has the class's least id. Of rows with a null text one for each id stays; rows without an id stay."""
    seen, found = classes(docs, key, text, **options)
    kept = found.where("class_id is not null and class_sha = sha").select(F.col("class_id").alias("id"), "sha")
    kept = seen.join(kept, ["id", "sha"]).groupBy("id", "sha").agg(F.count("*").alias("__rows"))
    kept = stored(kept.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "__rows"), "omh-kept")
    named = docs.where(F.col(key).isNotNull())
    rows = named.where(F.col(text).isNotNull()).withColumn("__own", digest(text))
    rows = rows.join(kept, (F.col(key).cast("long") == F.col("__id")) & (F.col("__own") == F.col("__sha")))
    rows = rows.where("__rows = 1").unionByName(rows.where("__rows > 1").dropDuplicates([key])).select(docs.columns)
    none = named.where(F.col(text).isNull()).dropDuplicates([key])
    return rows.unionByName(none).unionByName(docs.where(F.col(key).isNull()))
