"""The main text of web pages: boosted trees on DOM nodes, and a decoding that keeps the tree free of contradictions.

A page is read into a tree of block elements with runs of text as leaves (``dom``). Each node has features of its
subtree (characters, words, links, punctuation, text per element, lists, controls), of its names (what its tag and the words
of class, id and role said in training, its own and its ancestors'), of its depth and place, and of its siblings. Gradient
boosted trees give the log-odds that a node holds part of the article. Decoding chooses the set of nodes with the most
log-odds in sum under two rules: a node is in only if its parent is, and an element only if something below it is. So no
text stays under a rejected ancestor, and no element is chosen without a text.

The trees are fitted on ``pages`` (2,000) labelled layouts made by rule (``layouts``), a fixed bound that doesn't grow with
the input; the result for a page depends on that page alone. Pages are read whole, where they lie; nothing is shuffled.

Text: character references are decoded, white space in a block becomes one blank, blocks are joined by one line end. br is
white space. Scripts, styles, titles and other elements that show no text are no blocks.

Defined results: a null or empty page, and one without anything that looks like an article, has the empty text; rows
that repeat are judged each by itself; null ids and urls stay; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Trees
from .boost import fit as fit_trees
from .common import chunks
from .dom import HEADINGS, Page, parse, tokens
from .layouts import labelled

MARK = re.compile(r'data-main="([01])"')
MARKS = (". ", ", ", "! ", "? ", "; ", ": ")
#: Sums over a subtree: characters, words, characters in links, punctuation, digits, runs, elements, p, li, controls, headings, runs that end a sentence.
SUMS = 12


def names(page: Page, i: int) -> tuple[str, ...]:
    return ("<" + page.tag[i], *tokens(page.attributes[i]))


def features(pages: list[Page], said: dict[str, float]) -> np.ndarray:
    """A row per node, page by page."""
    sizes = [len(p.parent) for p in pages]
    first = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)  # the root of each node's page
    parent = np.concatenate([p.parent for p in pages]) + first
    n = len(parent)
    at = np.maximum(parent, first)  # a root is its own parent
    depth = np.concatenate([p.depth for p in pages])
    tags = [t for p in pages for t in p.tag]
    by_tag = {t: said.get("<" + t, 0.0) for t in set(tags)}
    by_name = {}
    for a in {a for p in pages for a in p.attributes}:
        words = [said[w] for w in tokens(a) if w in said]
        by_name[a] = min(words, default=0.0), max(words, default=0.0)
    own = np.array([by_tag[t] for t in tags])
    low, high = np.array([by_name[a] for p in pages for a in p.attributes]).T
    sums, longest = np.zeros((n, SUMS)), np.zeros(n)
    leaf = np.array([not t for t in tags])
    for row, t, links in zip(np.flatnonzero(leaf).tolist(), (t for p in pages for t, g in zip(p.text, p.tag, strict=True) if not g), (x for p in pages for x, g in zip(p.links, p.tag, strict=True) if not g), strict=True):
        marks, digits = sum(map(t.count, MARKS)) + (t[-1] in ".,!?;:"), sum(map(t.count, "0123456789"))
        sums[row, :6] = len(t), t.count(" ") + 1, links, marks, digits, 1
        sums[row, 11] = t[-1] in ".!?\"'"
        longest[row] = len(t)
    for column, kind in ((6, None), (7, {"p"}), (8, {"li"}), (10, HEADINGS)):
        sums[:, column] = ~leaf if kind is None else [t in kind for t in tags]
    sums[:, 9] = np.concatenate([p.controls for p in pages])
    before = np.cumsum(sums[:, 0]) - sums[:, 0]
    before -= before[first]
    above_low, above_high = np.zeros(n), np.zeros(n)
    levels = np.split(order := np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(depth[order])) + 1)
    for nodes in levels[1:]:
        up = at[nodes]
        above_low[nodes] = np.minimum(above_low[up], np.minimum(own[up], low[up]))
        above_high[nodes] = np.maximum(above_high[up], np.maximum(own[up], high[up]))
    for nodes in levels[:0:-1]:
        np.add.at(sums, at[nodes], sums[nodes])
        np.maximum.at(longest, at[nodes], longest[nodes])
    chars, words_, links, marks, digits, runs, elements, ps, lis, controls, heads, ended = sums.T
    density, size, linked = np.log1p(chars / (elements + 1)), np.log1p(chars), links / np.maximum(1, chars)
    # siblings: the nodes by parent, in page order
    inner = np.flatnonzero(at != np.arange(n))
    kids = inner[np.argsort(at[inner], kind="stable")]
    many = np.bincount(at[inner], minlength=n)
    begins = np.cumsum(many) - many
    place, prev, after, most = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    place[kids] = np.arange(len(kids)) - begins[at[kids]]
    same = at[kids[1:]] == at[kids[:-1]]
    prev[kids[1:][same]], after[kids[:-1][same]] = size[kids[:-1][same]], size[kids[1:][same]]
    np.maximum.at(most, at[inner], size[inner])
    siblings = np.maximum(1, many[at])
    mean, their_links = np.bincount(at[inner], size[inner], n)[at] / siblings, np.bincount(at[inner], linked[inner], n)[at] / siblings
    deepest = np.zeros(n)
    np.maximum.at(deepest, first, depth)
    total, per = np.maximum(1, chars[first]), np.maximum(1, words_)
    columns = [own, low, high, above_low, above_high, own[at], low[at], high[at], leaf, depth, depth / np.maximum(1, deepest[first]), size, np.log1p(words_), np.log1p(chars / np.maximum(1, runs)), linked, density, density[at], marks / per, ended / np.maximum(1, runs), np.log1p(ps), lis / np.maximum(1, elements)]
    columns += [np.log1p(controls), controls[at], heads, chars / total, before / total, place / siblings, np.log1p(many[at]), mean, most[at], prev, after, their_links, np.log1p(longest), digits / np.maximum(1, chars), chars / per, np.log(total), chars / np.maximum(1, chars[at])]
    return np.stack(columns, axis=1)


def decoded(page: Page, odds: np.ndarray) -> list[int]:
    """The runs of the best set of nodes: children only under parents, elements only above runs.

    A node's gain is the most that it can add with all below it: an element takes all children that gain, or the one that
    loses least if none does.
    """
    n = len(page.parent)
    gain, below, best, child = odds.astype(float), np.zeros(n), np.full(n, -np.inf), np.zeros(n, np.int64)
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if page.tag[i]:
            gain[i] += below[i] if below[i] > 0 else best[i]
        below[up] += max(gain[i], 0.0)
        if gain[i] >= best[up]:
            best[up], child[up] = gain[i], i
    chosen = np.zeros(n, bool)
    chosen[0] = True  # the page itself is no choice
    for i in range(1, n):
        up = page.parent[i]
        chosen[i] = chosen[up] and (gain[i] > 0 or up > 0 and below[up] <= 0 and child[up] == i)
    return [i for i in np.flatnonzero(chosen).tolist() if not page.tag[i]]


def truth(page: Page) -> np.ndarray:
    """Whether a node of a labelled page holds part of the article: runs by the nearest mark above them."""
    n = len(page.parent)
    mark, holds = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        m = MARK.search(page.attributes[i])
        mark[i] = m[1] == "1" if m else i > 0 and mark[page.parent[i]]
        holds[i] = mark[i] and not page.tag[i]
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    return holds


class Extractor:
    def __init__(self, said: dict[str, float], trees: Trees) -> None:
        self.said, self.trees = said, trees

    def odds(self, pages: list[Page]) -> list[np.ndarray]:
        if not pages:
            return []
        return np.split(self.trees.score(features(pages, self.said)), np.cumsum([len(p.parent) for p in pages])[:-1])

    def texts(self, markups: list[str | None]) -> list[str]:
        pages = [parse(m) for m in markups]
        return ["\n".join(p.text[i] for i in decoded(p, o)) for p, o in zip(pages, self.odds(pages), strict=True)]


@lru_cache(2)
def fit(pages: int = 2000, seed: int = 23) -> Extractor:
    """Trees of ``pages`` labelled layouts; what a name says is its log-odds among their nodes."""
    made = [parse(m) for m in labelled(pages, seed)]
    wanted = [truth(p) for p in made]
    counts: dict[str, list[int]] = {}
    for p, w in zip(made, wanted, strict=True):
        for i in range(1, len(w)):
            for name in names(p, i):
                counts.setdefault(name, [0, 0])[int(w[i])] += 1
    said = {name: float(np.log((yes + 1) / (no + 1))) for name, (no, yes) in sorted(counts.items()) if yes + no >= 10}
    x = features(made, said)
    y = np.concatenate(wanted)
    inner = np.concatenate([np.arange(len(w)) > 0 for w in wanted])
    return Extractor(said, fit_trees(x[inner], y[inner].astype(float)))


def extracted(pages: DataFrame, extractor: Extractor, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for group in chunks(m.as_py() for m in batch.column(2)) for t in extractor.texts(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
