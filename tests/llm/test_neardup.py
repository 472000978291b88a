import random
from collections import Counter

import numpy as np
import pytest

from probata.llm import neardup as N
from probata.llm.align import banded_distance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, component string"


def corpus(seed=5, copies=6, groups=12, length=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(length)]
        for _ in range(copies):
            texts.append(" ".join(rng.choice(vocab) if rng.random() < 0.02 else w for w in base))
    passage = [rng.choice(vocab) for _ in range(40)]
    texts += [" ".join(passage + [rng.choice(vocab) for _ in range(60)]) for _ in range(40)]  # a common passage only
    return texts


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def partition(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(texts):
    w = [t.lower().split() for t in texts]
    return partition(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or banded_distance(w[i], w[j], int(max(len(w[i]), len(w[j])) * 0.2 + 1e-9)) is not None])


def test_groups_are_those_of_all_pairs(spark):
    texts = corpus()
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_pairs_that_are_near_neither_to_the_least_text(spark):
    """Excerpts of a common passage: all that two of them share is what their bucket's least text has as well."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = some(100)
    texts = [" ".join(some(20) + passage + some(20)) for _ in range(300)]
    texts += [" ".join(passage), " ".join(passage + some(10)), " ".join(some(40) + passage[:70]), " ".join(some(12) + passage)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    texts = [None, None, "", "", "one two", "One  two", "one two", long, long + " more", "a " * 60, "a " * 61]
    got = {r.doc_id: (r.copy_of, r.class_id) for r in N.near_duplicates(frame(spark, texts)).collect()}
    assert got[0] == (0, 0)
    assert got[1] == (1, 1)  # nulls are no copies
    assert got[2] == got[3] == (2, 2)
    assert got[6][0] == 4
    assert got[5][1] == got[4][1] == 4
    assert got[7][1] == got[8][1] == 7
    assert got[9][1] == got[10][1] == 9
    kept = N.keep_one(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4, 7, 9]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "p q r s t u", "", "", 1, "", ""), (1, "p q r s t u", "", "", 1, "", ""), (None, "z", "", "", 1, "", ""), (2, None, "", "", 0, "", ""), (2, None, "", "", 0, "", "")]
    kept = N.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.doc_id for r in kept) == Counter({1: 1, 2: 1, None: 1})


def test_one_id_with_two_texts(spark):
    """Each text is judged by itself, whatever the order of the rows."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, a), (1, b), (2, [*a, "x"]), (3, [*b, "y"]), (4, ["alone"] * 9), (None, [*a, "z"]), (None, ["none"] * 7)]
    rows = [(i, " ".join(w), "", "", 1, "", "") for i, w in rows]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, SCHEMA)
        got = sorted(((r.doc_id, r.copy_of, r.class_id) for r in N.near_duplicates(df).collect()), key=str)
        assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 4), (None, None, 1), (None, None, None)], key=str)
        kept = Counter((r.doc_id, r.text[:2]) for r in N.keep_one(df).collect() if r.doc_id is not None)
        assert set(kept) in ({(1, "a0"), (1, "b0"), (4, "al")}, {(1, "a0"), (4, "al")}, {(1, "b0"), (4, "al")})
        assert max(kept.values()) == 1


@pytest.mark.parametrize("similarity", [0.98, 0.95, 0.9, 0.85, 0.82, 0.8])
@pytest.mark.parametrize("length", [5, 8, 10, 12, 15, 20, 25, 40, 63, 70, 100, 200, 1000])
def test_recall_of_candidates(similarity, length):
    """Of pairs as similar as that, nine in ten or more share a sketch, down to the least similarity that links."""
    rng = np.random.default_rng(length)
    edits = int(length * (1 - similarity) + 1e-9)
    hits = {"replaced": 0, "mixed": 0}
    for _ in range(100):
        a = rng.integers(0, 2**63, length).astype(np.uint64)
        x = N.sketches_of(a)
        for kind in hits:
            b = a.tolist()
            for at in sorted(rng.choice(length, edits, replace=False).tolist(), reverse=True):
                new = int(rng.integers(0, 2**63))
                way = rng.integers(0, 3) if kind == "mixed" else 0
                b[at : at + (way < 2)] = [] if way == 1 else [new]  # replaced, dropped or put before
            y = N.sketches_of(np.array(b, np.uint64))
            hits[kind] += bool(np.isin(x, y).any())
    assert min(hits.values()) >= 90, hits


@pytest.mark.parametrize("length", [10, 15, 25, 60, 75, 100, 200, 1000])
@pytest.mark.parametrize("step", [5, 6, 7, 8])
def test_recall_of_even_edits(length, step):
    """Every fifth to eighth word replaced: nine in ten or more share a sketch though no five words in a row may be left."""
    rng = np.random.default_rng(length + step)
    hits = 0
    for _ in range(60):
        a = rng.integers(0, 2**63, length).astype(np.uint64)
        b = a.copy()
        b[step - 1 :: step] = rng.integers(0, 2**63, len(b[step - 1 :: step]))
        hits += bool(np.isin(N.sketches_of(a), N.sketches_of(b)).any())
    assert hits >= 54


def test_short_texts_against_all_pairs(spark):
    """Texts of 4 to 70 words with edits of all kinds; groups next to those of all pairs, at lengths on both sides of the families' bounds."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = []
    for length in (4, 5, 8, 10, 11, 12, 13, 14, 16, 20, 30, 50, 62, 64, 66, 70):
        for _ in range(6):
            base = [rng.choice(vocab) for _ in range(length)]
            texts.append(" ".join(base))
            for _ in range(rng.randrange(0, int(length * 0.2) + 1)):
                at = rng.randrange(len(base))
                base[at : at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            texts.append(" ".join(base))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, texts)).collect()}
    want = brute(texts)
    pairs = [i for i in range(len(texts)) if want[i] != i]
    assert len(pairs) > 60
    assert all(want[i] == want[got[i]] for i in range(len(texts)))
    assert sum(got[i] == want[i] for i in pairs) >= 0.97 * len(pairs)


def test_blocks_hold_few_texts(spark, monkeypatch):
    """Unlinked short texts of one template: blocks are bounded by texts as well as by characters, but for the chance of salts."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", 256)
    rows = spark.createDataFrame([(0, i, i, 12, 60) for i in range(1, 3000)], "center long, node long, component long, n long, chars long")
    for chars in (256 * 60, 2560 * 60, 256 * 6000):
        sizes = [r["count"] for r in N.blocks_of(rows, 0.8, chars).groupBy("a", "b", "own").count().collect()]
        assert max(sizes) <= 1.3 * 256
        assert len(sizes) > 10


def test_blocks_are_no_cut(spark):
    """The same classes whether the texts that met one centre are a block or many, of many lengths."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(700)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = some(60)
    texts = [" ".join(passage + some(10)) for _ in range(20)] + [" ".join(some(5 * i) + passage + some(15)) for i in range(40)]
    texts += [" ".join(passage + some(i)) for i in range(12, 30)] + [" ".join(passage), " ".join(passage[:49])]
    for chars in (10**9, 2000, 300):
        got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, texts), block_chars=chars).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_links_within_is_exact():
    rng = random.Random(3)
    for turn in range(60):
        base = [rng.choice("abcdefghijklmnop") for _ in range(30)]
        lists = [[rng.choice("abcdefghijklmnop") if rng.random() < 0.15 else w for w in base][: rng.randrange(20, 31)] for _ in range(14)] + [[], []]
        hashes = N.WordHashes()
        arrays = [hashes.of(" ".join(x)) for x in lists]
        block = [i % 2 for i in range(len(lists))] if turn % 2 else [0] * len(lists)
        links = N.links_within(arrays, list(range(len(lists))), block, 0.8)
        near = lambda i, j: banded_distance(lists[i], lists[j], N.allowed(max(len(lists[i]), len(lists[j])), 0.8)) is not None  # noqa: E731, B023
        assert all(near(i, j) for i, j in links)
        every = [(i, j) for i in range(len(lists)) for j in range(i) if near(i, j) and (turn % 2 == 0 or block[i] != block[j])]
        assert partition(len(lists), links) == partition(len(lists), every)


def test_empty_table(spark):
    assert N.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_sketch_keeps_the_order():
    seeds = N.seeds_of(64)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 200).astype(np.uint64)
    a = N.order_minhash(N.labelled_runs(words, 1), seeds, 2)
    b = N.order_minhash(N.labelled_runs(words[::-1].copy(), 1), seeds, 2)
    assert (a == b).sum() < 8  # the same runs in another order
    assert (a == N.order_minhash(N.labelled_runs(words, 1), seeds, 2)).all()


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    runs = N.labelled_runs(rng.integers(0, 50, 500).astype(np.uint64), 5)
    whole = N.order_minhash(runs, N.seeds_of(8), 4)
    monkeypatch.setattr(N, "BLOCK", 64)
    assert (N.order_minhash(runs, N.seeds_of(8), 4) == whole).all()
