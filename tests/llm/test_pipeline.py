"""The pipeline on a small table, held against plain versions of its five stages, and on tables with odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_neardup import brute
from test_text_ops import naive, replayed

import corpus_pipeline
from probata.llm import mixing, pii

ALPHABETS = {"aa": "abcdeio", "bb": "fghjkuy"}


def corpus():
    """(items, documents): two languages, copies, near copies, test items, base personal data, texts without letters."""
    rng = random.Random(21)
    word = lambda c: "".join(rng.choice(ALPHABETS[c]) for _ in range(rng.randrange(3, 7)))
    words = lambda c, n: [word(c) for _ in range(n)]
    items = [(i, f"{' '.join(words('aa', 14))}. {' '.join(words('aa', 9))}.") for i in range(4)]
    docs = []
    for i in range(60):
        c = "ab"[i % 2] * 2
        w = words(c, rng.randrange(20, 80))
        if i % 12 == 3:
            w[10:10] = ["x.y@some.org", "+1", "(456)", "555-2186", "10.20.30.40"]
        if i % 15 == 4:
            w[5:5] = items[i % 4][1].split()
        docs.append((" ".join(w), c))
    for i in (0, 7, 8):
        docs.append(docs[i])  # a copy
        w = docs[i][0].split()
        docs += [(" ".join([*w[:4], "zeo", *w[5:]]), docs[i][1]), (" ".join(w[:-1]), docs[i][1])]  # near copies
    docs += [("12 ... 34", "aa"), ("", "bb"), (None, "aa"), ("", None)]
    return items, [(i, t, c, f"s{i % 3}" if i % 20 else None, len(t or "")) for i, (t, c) in enumerate(docs)]


def plain(items, docs):
    letter = lambda c: np.random.Generator(np.random.PCG64([7, c])).integers(0, 2, 1024).astype(int) * 2 - 1
    made = {}

    def bundle(text):
        marks, out = [0, *[ord(c.lower()) if c.isalpha() else 0 for c in text or ""], 0], np.zeros(1024)
        for a, b, c in zip(marks, marks[1:], marks[2:], strict=False):
            if b:
                for x in (a, b, c):
                    if x not in made:
                        made[x] = letter(x)
                out += np.roll(made[a], 2) * np.roll(made[b], 1) * made[c]
        return out / (np.linalg.norm(out) or 1.0)

    spots = {c: sum(bundle(t) for i, t, k, _, _ in docs if k == c and zlib.crc32(str(i).encode()) % 3 != 1) for c in ALPHABETS}
    docs = [d for d in docs if max(float(bundle(d[1]) @ v / np.linalg.norm(v)) for v in spots.values()) >= 0.05]
    yield docs
    docs = [d for d, root in zip(docs, brute([d[1] for d in docs]), strict=True) if docs[root] is d]
    yield docs
    docs = [d for d in docs if not any(t in d[1] for _, t in items)]
    yield docs
    out = []
    for i, t, c, s, _ in docs:
        end, parts = 0, []
        for a, b, k in sorted((a, b, k) for k, a, b in naive(t)):
            if a >= end:
                parts += [t[end:a], f"<{pii.KINDS[k]}>"]
            end = max(end, b)
        out.append((i, text := "".join([*parts, t[end:]]), c, s, len(text)))
    yield out


def test_stages_against_plain_versions(spark, tmp_path):
    items, docs = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain(items, docs), strict=False):
        df = corpus_pipeline.stored(stage(spark, df, str(tmp_path)), name)
        assert sorted(map(tuple, df.collect())) == sorted(want), name
        sizes.append(len(want))
    assert sizes[0] < len(docs)
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 40
    assert any(re.search("<(email|phone|ip)>", t) for _, t, _, _, _ in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected, target = replayed([(i, t, c, s) for i, t, c, s, _ in want], 8192)
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == expected
    assert all(r.target == pytest.approx(target[r.source]) for r in got)
    assert mixing.FINEST == 4096
    texts = {(i, s): t.split() for i, t, _, s, _ in want}
    words = Counter()
    for r in corpus_pipeline.write(spark, str(tmp_path), f"{tmp_path}/mix").collect():
        own = r.text.split()
        assert own == texts[r.doc_id, r.source][r.lo : r.lo + len(own)]
        words[r.doc_id] += len(own)
    assert words == +Counter({r.doc_id: r.taken for r in got})


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No document; null languages and sources; ids that repeat or are null; extra columns with names that operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, node string, component long, begin string, sha string, h string"
    extra = ("x", 1, "y", 2, "z", "s", "h")
    rows = [(i, f"{'abc def ghi ' * 5}{i} word{'x' * (i % 7)}", None if i % 2 else "aa", None, 9, *extra) for i in range(6)]
    rows += [(1, "some other text with letters", "aa", "s", 3, *extra), (None, "a text without an id at all", None, "s", 3, *extra), (7, None, None, None, None, *extra)]
    for name, own in (("none", []), ("odd", rows), ("same", rows * 3)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "what is this? it is that."), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert bool(got) == bool(own)
        assert all(0 <= r.taken <= 3 * r.size for r in got)
