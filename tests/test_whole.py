"""Queries that have to cover all of their tables, against brute force."""

import math
from collections import Counter, defaultdict

import pytest

from probata.plans import QUERIES


def test_tfidf_of_the_whole_vocabulary(spark, tmp_path):
    """More terms in two documents than any fixed vocabulary of 2,000 holds; null texts and languages; single terms."""
    docs = [(i, ("en", "de", None)[i % 3], " ".join(f"T{j}" for j in range(i % 50 * 60, i % 50 * 60 + 60)) + f" the The only{i}") for i in range(100)]
    docs += [(100, "en", None), (101, "fr", "alone")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = [(lang, Counter((text or "").lower().split(" "))) for _, lang, text in docs]
    df = Counter(w for _, c in counts for w in c)
    assert sum(n >= 2 for n in df.values()) > 2000
    want = defaultdict(list)
    for lang, c in counts:
        want[lang].append(sum((n * math.log((len(docs) + 1) / (df[w] + 1))) ** 2 for w, n in c.items() if df[w] >= 2))
    got = {r.lang: (r.docs, r.mean_square) for r in QUERIES["text_tfidf"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for lang, x in want.items():
        assert got[lang] == (len(x), pytest.approx(sum(x) / len(x), abs=1e-4))
