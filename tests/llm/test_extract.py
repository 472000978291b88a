"""Main text of pages: the tree, the decoding against all sets of nodes, hand-written and planted pages, odd tables."""

import html
import itertools
import re
import time

import numpy as np
import pytest

from probata.llm.boost import fit as fit_trees
from probata.llm.dom import Page, parse
from probata.llm.extract import decoded, extracted, fit, truth
from probata.llm.layouts import labelled
from probata.llm.queries import QUERIES

L = "The council met on Tuesday evening to discuss the new bridge. Members heard from two engineers, who said that the old piers would last another ten years. A vote is due next month."
M = "Repairs began in spring, and the road has been closed since. Drivers are asked to use the ring road, which adds about ten minutes."
WANT = f"Bridge vote\n{L}\n{M}"


def runs(markup):
    p = parse(markup)
    return [t for t, tag in zip(p.text, p.tag, strict=True) if not tag]


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        (None, []),
        ("", []),
        ("a  b\n c", ["a b c"]),
        ("<p>one<p>two <b>bold <i>both</b> on<br>three</p>four", ["one", "two bold both on three", "four"]),
        ("<p>&lt;x&gt; &amp;amp; &copy;&#65;&nbsp;z</p>", ["<x> &amp; ©A z"]),
        ('<script>var t="</p>";</script><style>p{}</style><title>t</title>x<!-- <p>no</p> -->y', ["xy"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<head><meta charset=x><title>no</title><p>yes", ["yes"]),
        ('<div title="a > b">x</div></span></p>y', ["x", "y"]),
        ("<select><option>a<option>b</select><textarea><p>no</textarea>z", ["z"]),
        ("<!-- never closed <p>a", []),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ('<p class="x>open quote</p><p>next</p>', ["open quote", "next"]),
        ("<SCRIPT>no</SCRIPT ><P>yes</P>", ["yes"]),
        ("<b>bold<p>in</b>side</p>", ["bold", "inside"]),
    ],
)
def test_blocks(markup, want):
    assert runs(markup) == want


@pytest.mark.parametrize("piece", ["<b>", "<p>", "<a ", "<a 'x", "<b></div>", "<i><div></div>", "<!", "<ul><li>", "</p>", "<table><tr><td>", "<div class='a b'>", "<h1>x"])
def test_odd_markup_takes_one_pass(piece):
    """Hundreds of thousands of pieces that are never closed or never opened."""
    began = time.process_time()
    parse("<b>" * 20_000 + piece * 60_000)
    assert time.process_time() - began < 10


def test_decoding_is_the_best_of_all_sets():
    """Against all sets of nodes: children only under chosen parents, elements only above chosen runs."""
    g = np.random.default_rng(4)
    for _ in range(60):
        p = Page()
        p.add(-1, "#root")
        for _ in range(int(g.integers(1, 9))):
            up = int(g.choice([i for i in range(len(p.parent)) if p.tag[i]]))
            p.add(up, "" if g.random() < 0.5 else "div", text="x")
        odds = g.normal(0, 1, len(p.parent))
        best, sets = 0.0, []
        nodes = range(1, len(p.parent))
        for k in range(len(p.parent)):
            for s in itertools.combinations(nodes, k):
                own = set(s)
                if all(p.parent[i] in own or p.parent[i] == 0 for i in s) and all(not p.tag[i] or any(p.parent[j] == i for j in s) for i in s):
                    sets.append((odds[list(s)].sum(), s))
        best, chosen = max(sets, default=(0.0, ()))
        assert decoded(p, odds) == [i for i in chosen if not p.tag[i]]


def test_trees_learn_what_no_line_can():
    g = np.random.default_rng(2)
    x = g.uniform(-1, 1, (3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.2)).astype(float)
    trees = fit_trees(x[:2000], y[:2000], rounds=30, depth=3)
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    assert len(trees.score(x[:0])) == 0
    assert np.abs(fit_trees(np.ones((10, 2)), np.ones(10), rounds=2).score(np.ones((1, 2)))) > 5


PAGES = {
    "named": f'<html><head><title>x</title></head><body><header><h1><a href="/">Daily Planet</a></h1><p>News for all</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li></ul></nav><div class="cookie-notice">We use cookies to improve your visit. <button>Accept</button></div><div id="content"><h1>Bridge vote</h1><p>{L}</p><div class="advertisement">Buy cheap shoes today at Shoe World.</div><p>{M}</p></div><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm hits the coast again</a></li><li><a href="/2">Team wins the cup</a></li></ul></aside><div class="comments"><h3>Comments</h3><div class="comment"><p>I think the bridge is fine as it is. They should leave it.</p></div></div><form><label>Email</label><input name="e"><button>Subscribe</button></form><footer>&copy; Daily Planet. All rights reserved.</footer></body></html>',
    "main": f'<body><div class="masthead">Site</div><main><section><h2>Bridge vote</h2><p>{L}<p>{M}</section><section class="related"><h3>Related</h3><a href="/x">Another story</a></section></main><div class="footer"><p>Contact us</p></div></body>',
    "table": f"<body><table><tr><td><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></td><td><h1>Bridge vote</h1><p>{L}</p><p>{M}</p></td></tr></table></body>",
    "comments": f'<article class="post"><h1>Bridge vote</h1><p>{L}</p><p>{M}</p><section id="comments"><article class="comment"><p>Nice piece, thank you for writing this.</p></article><article class="comment"><p>I disagree. The old bridge was better, and cheaper too.</p></article></section></article>',
    "unclosed": f"<nav><a href=/a>Home</a></nav><article><h1>Bridge vote</h1><p>{L}<p><b>{M}<br>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_hand_written_pages(name):
    assert fit().texts([PAGES[name]]) == [WANT]


def test_pages_without_an_article():
    assert fit().texts(["<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><footer>&copy; 2020 Example</footer></body>", None, "", "<html></html>", "<!-- -->"]) == [""] * 5


def test_layouts_that_were_not_seen():
    """Held-out layouts: runs found and lost."""
    pages = [parse(m) for m in labelled(200, seed=99)]
    right = wrong = lost = 0
    for p, odds in zip(pages, fit().odds(pages), strict=True):
        want = {i for i in np.flatnonzero(truth(p)) if not p.tag[i]}
        got = set(decoded(p, odds))
        right, wrong, lost = right + len(want & got), wrong + len(got - want), lost + len(want - got)
    assert right / (right + wrong) > 0.97
    assert right / (right + lost) > 0.97


def test_result_depends_on_the_page_alone():
    pages = labelled(30, seed=7)
    assert fit().texts(pages) == [fit().texts([m])[0] for m in pages]


def plain_article(markup):
    """What stands between <article> and </article> in the tables' pages, with p and h1 as blocks."""
    inner = markup.split("<article>", 1)[1].split("</article>", 1)[0]
    inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
    blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_all_pages_of_the_tables(spark, sf, size):
    folder = sf.replace("0.001", size)
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op13_boosted_extraction"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text) == (pages[r.page_id].url, plain_article(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


def test_odd_tables(spark):
    rows = [(1, "u", None, "t"), (None, None, PAGES["main"], "t"), (2, "u", "", "t"), (3, "v", PAGES["main"], "t"), (3, "v", PAGES["main"], "t"), (4, "w", "<article>" + "<p>" + "long words here. " * 200_000 + "<p>end of it.", "t"), (5, "x", "<div>" * 5000 + "deep" + "</div>" * 5000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 AS n_chars")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extracted(df, fit()).collect())
    assert [g[:2] for g in got] == [(0, None), (1, "u"), (2, "u"), (3, "v"), (3, "v"), (4, "w"), (5, "x")]
    assert [g[2] for g in got[:5]] == [WANT, "", "", WANT, WANT]
    assert got[5][2].endswith("\nend of it.")
    assert got[5][3] == 17 * 200_000 - 1 + len("\nend of it.")
    assert extracted(df.limit(0), fit()).columns == ["page_id", "url", "text", "n_chars"]
    assert extracted(df.limit(0), fit()).count() == 0
