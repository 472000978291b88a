"""Duplicates, components and splits against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probata.operators import dedup as D
from probata.operators import select as SE
from probata.operators.graph import components
from probata.operators.ranks import places, quantiles
from probata.sources.files import reconcile, safe_path


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] and None not in e for e in edges)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_hashes_are_all_found(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(60) for _ in range(30)]
    rows = [(i, base[i % 30] ^ sum(1 << rng.randrange(60) for _ in range(rng.randrange(5))) & (2**60 - 1)) for i in range(120)] + [(200 + i, base[0]) for i in range(9)] + [(300, None)]
    df = spark.createDataFrame(rows, "id long, h long")
    rows = rows[:-1]
    least = {}
    for i, h in rows:
        least[h] = min(i, least.get(h, i))
    got = sorted((r.a, r.b, r.distance) for r in D.near_links(df, "id", "h", 4).collect())
    want = [(min(least[x], least[y]), max(least[x], least[y]), (x ^ y).bit_count()) for x in least for y in least if x < y and (x ^ y).bit_count() <= 4]
    assert got == sorted(want + [(least[h], i, 0) for i, h in rows if i != least[h]])
    counts = Counter((x ^ y).bit_count() for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 4)
    assert {r.distance: r.pairs for r in D.near_counts(df, "id", "h", 4).collect()} == counts


def test_places_and_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), i) for i in range(500)] + [("c", 7, 500)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {r.id: r.place for r in places(df, ["v", "id"], "g").collect()}
    for g in ("a", "b", "c", None):
        own = sorted((v, i) for k, v, i in rows if k == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert sorted(r.place for r in places(df, ["id"]).collect()) == list(range(1, 502))
    probs = (0.0, 0.05, 0.5, 0.95, 1.0)
    for r in quantiles(df.withColumn("v", F.when(F.col("id") % 9 != 0, F.col("v"))), "v", probs, "g").collect():
        assert r.q == pytest.approx(list(np.quantile([v for g, v, i in rows if g == r.g and i % 9], probs)))
    assert places(df.limit(0), ["id"], "g").count() == 0


def most_below(sizes, target):
    reach = {0}
    for s in sizes:
        reach |= {r + s for r in reach if r + s <= target}
    return max(reach)


def test_sizes_hit_the_target():
    rng = random.Random(4)
    assert D.choose_sizes([(9, 1)], 5, "x") == {}
    assert D.choose_sizes([], 5, "x") == {}
    for n in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(rng.randrange(1, 8))}
        target = rng.randrange(1, 90)
        got = D.choose_sizes(sorted(counts.items()), target, str(n))
        assert all(0 < k <= counts[s] for s, k in got.items())
        assert sum(s * k for s, k in got.items()) == most_below([s for s, k in counts.items() for _ in range(k)], target)


def test_sizes_of_ten_million_groups():
    assert sum(s * k for s, k in D.choose_sizes([(1, 6_000_000), (2, 3_000_000), (7, 1_000_000)], 50_000, "x").items()) == 50_000


def test_split_sizes_are_the_best(spark):
    """Groups of all kinds of sizes, a null class, classes too small for the target and one that is a single group."""
    rng = random.Random(6)
    rows = [(c, 1000 * c + g) for c in range(4) for g in range(30) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 30]))]
    rows += [(None, 9000 + g // 2) for g in range(10)] + [(7, 7000)] * 50 + [(8, 8000), (8, 8001)]
    got = D.split_groups(spark.createDataFrame(rows, "class int, component long").repartition(5), "class", "component", 20, 15).collect()
    assert len(got) == len({r.component for r in got}) == len({g for _, g in rows})
    for c in {c for c, _ in rows}:
        own = [r for r in got if r["class"] == c]
        total = sum(r["size"] for r in own)
        test = sum(r["size"] for r in own if r.split == "test")
        assert test == most_below([r["size"] for r in own], D.target_size(total, 20))
        left = [r["size"] for r in own if r.split != "test"]
        assert sum(r["size"] for r in own if r.split == "val") == most_below(left, D.target_size(total, 15))
    again = D.split_groups(spark.createDataFrame(rows, "class int, component long").repartition(2), "class", "component", 20, 15).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_near_hashes_in_a_hot_band(spark):
    """All hashes agree in two bands, many in more: the same pairs as all against all, from buckets of 20 at most."""
    rng = random.Random(9)
    base = rng.getrandbits(60)
    low = [base ^ (rng.getrandbits(10) << 26) for _ in range(250)] + [base ^ (1 << rng.randrange(24, 60)) ^ (1 << rng.randrange(24, 60)) for _ in range(250)]
    hashes = sorted(set(low))
    got = {(r.h, r.h2, r.distance) for r in D.near_kinds(spark.createDataFrame([(h,) for h in hashes], "h long"), 3, 60, most=20).collect()}
    want = {(a, b, (a ^ b).bit_count()) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (a ^ b).bit_count() <= 3}
    assert got == want
    assert len(want) > 1000


def test_split_keeps_groups_whole(spark):
    rng = random.Random(2)
    rows = [(c, 100 * c + rng.randrange(40)) for c in range(3) for _ in range(150)]
    s = D.split_groups(spark.createDataFrame(rows, "class int, component long"), "class", "component", 20, 20).collect()
    assert len({(r["class"], r.component) for r in s}) == len(s)
    for c in range(3):
        assert sum(r["size"] for r in s if r["class"] == c and r.split == "test") == 20
        assert sum(r["size"] for r in s if r["class"] == c and r.split == "val") == 20


def test_tampering_shows(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha string")
    listed = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "name string, sha string")
    assert {r.name: r.status for r in reconcile(listed, found, "name", "sha").collect()} == {"a": "ok", "b": "mismatch", "c": "extra", "d": "missing"}


def test_safe_paths(spark):
    rows = [("a/b.txt",), ("/etc/x",), ("a/../b",), ("..",), ("a..b",), ("",), (None,)]
    got = [r.ok for r in spark.createDataFrame(rows, "p string").select(safe_path("p").alias("ok")).collect()]
    assert got == [True, False, False, False, True, False, False]


def test_accepted_pseudo_labels(spark):
    """Unreadable contents, copies of training rows and of each other, rows that the rule leaves out or says nothing of."""
    pool = [(1, [1.0, 2.0], True), (2, [1.0, 2.0], True), (3, [3.0, 4.0], True), (4, None, True), (5, [5.0, None], True), (6, [float("nan"), 1.0], True), (7, [6.0, 7.0], False), (8, [6.0, 8.0], None), (0, [1.0, 2.0], False), (9, [9.0, 9.0], True), (10, [], True)]
    df = spark.createDataFrame(pool, "id long, content array<double>, fine boolean").withColumn("label", F.lit("x"))
    train = spark.createDataFrame([(100, [3.0, 4.0]), (101, None), (102, [3.0, 4.0])], "id long, content array<double>")
    got = SE.accepted(df, train, "id", "content", F.col("fine"))
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == [1, 9, 10]
    assert SE.accepted(df, train.limit(0), "id", "content", F.col("fine")).count() == 4
    assert SE.accepted(df.limit(0), train, "id", "content", F.col("fine")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    """Tasks follow the edges, not the partitions of shuffles: the driver keeps a record of every task."""
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 200)], "src long, dst long").repartition(3)
    own = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    known = {k: spark.conf.get(k) for k in own}
    tracker, group = spark.sparkContext.statusTracker(), "components-few-edges"
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        assert {r.component for r in components(edges).collect()} == {0}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in known.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    done = [i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i]
    assert done and sum(n > 4 for n in done) <= 3
