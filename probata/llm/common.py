"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than blank, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def chunks(texts: Iterable[str | None], most: int = 256, chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts in groups of at most ``most`` texts and about ``chars`` characters; a null counts as empty."""
    out: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if out and (len(out) >= most or size + len(t) > chars):
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out
