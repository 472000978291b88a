"""Labelled pages to train on: layouts put together by rule, whose article is marked with data-main.

Layouts differ in the elements and names that hold the article, in depth, in what stands around and inside of it (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments), in how much of it there is, and in whether elements
are named at all. Words are syllables, so nothing is learned about any language.
"""

from __future__ import annotations

import math
import random

# Words that pages commonly name their parts with.
ARTICLE = "article content post entry story main body text page blog news single hentry prose document maincontent articlebody".split()
AROUND = {
    "menu": "nav menu navigation navbar topnav breadcrumb breadcrumbs pagination tabs toc".split(),
    "header": "header masthead banner topbar logo branding site".split(),
    "footer": "footer copyright colophon bottom legal imprint credits".split(),
    "aside": "sidebar aside widget related recommended popular trending rail recent teaser tags".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer paywall message".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense dfp".split(),
    "form": "form search newsletter subscribe signup login contact register".split(),
    "comments": "comments comment respond replies reply discussion disqus feedback thread reader".split(),
    "share": "share sharing social follow buttons tools meta byline".split(),
}
PLAIN = "wrapper container row col inner outer box block left right grid section wrap layout group clearfix item".split()
ELEMENT = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class Layouts:
    def __init__(self, seed: int) -> None:
        self.g = random.Random(seed)

    def one(self, options: list[str]) -> str:
        return options[int(self.g.random() * len(options))]

    def chance(self, p: float) -> bool:
        return self.g.random() < p

    def words(self, n: int) -> str:
        out = []
        for i in range(n):
            w = "".join(self.one(self.syllables) for _ in range(1 + int(self.g.random() * 3)))
            w = w.capitalize() if not out or out[-1][-1] in ".!?" or self.chance(0.03) else w
            if self.junk and self.chance(0.7):
                w += self.one(["###", "$$$", "%%%", "&amp;&amp;", "***", "7", "|"])
            if i == n - 1 or self.chance(0.12):
                w += self.one([".", ".", ".", ",", "!", "?", ";"])
            elif self.chance(0.01):
                w = "".join(self.one(list("0123456789abcdef")) for _ in range(24))
            out.append(w)
        return " ".join(out)

    def some(self, low: int, high: int) -> int:
        """Small numbers more often than large ones."""
        return int(low * math.exp(self.g.random() * math.log((high + 1) / low)))

    def named(self, tag: str, names: list[str], inside: str, main: str = "") -> str:
        attributes = f' data-main="{main}"' if main else ""
        if self.style != "bare" and self.chance(0.85):
            own = [self.one(names)] + ([self.one(PLAIN)] if self.chance(0.3) else []) + ([self.one(names)] if self.chance(0.2) else [])
            if self.style == "noise" and self.chance(0.5):
                own = ["x" + "".join(self.one(self.syllables) for _ in range(2))]
            attributes += f' {self.one(["class", "class", "id"])}="{self.one(["-", " ", "_"]).join(own)}"'
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def link(self, n: int) -> str:
        return f'<a href="/{self.one(self.syllables)}">{self.words(n)}</a>'

    def around(self, kind: str, main: str = "0") -> str:
        if kind == "menu":
            inside = "<ul>" + "".join(f"<li>{self.link(self.some(1, 3))}</li>" for _ in range(self.some(2, 12))) + "</ul>"
        elif kind == "header":
            inside = (f"<h1>{self.link(self.some(1, 4))}</h1>" if self.chance(0.5) else f"<div>{self.words(self.some(1, 5))}</div>") + (f"<p>{self.words(self.some(2, 10))}</p>" if self.chance(0.4) else "")
        elif kind == "footer":
            inside = f"&copy; {self.words(self.some(1, 4))} &middot; {self.words(self.some(2, 40))}" if self.chance(0.5) else f"<p>&copy; {self.words(self.some(2, 30))}</p>" + "".join(f"<p>{self.link(2)}</p>" for _ in range(self.some(1, 4)))
        elif kind == "aside":
            inside = f"<h3>{self.words(self.some(1, 4))}</h3>" + ("<ul>" + "".join(f"<li>{self.link(self.some(2, 9))}</li>" for _ in range(self.some(2, 8))) + "</ul>" if self.chance(0.6) else f"<p>{self.words(self.some(5, 60))}</p>")
        elif kind == "notice":
            inside = (f"<p>{self.words(self.some(4, 40))}</p>" if self.chance(0.6) else self.words(self.some(4, 30))) + (f"<button>{self.words(1)}</button>" if self.chance(0.5) else self.link(2))
        elif kind == "advert":
            inside = self.one([self.words(self.some(2, 20)), f"<p>{self.words(self.some(2, 20))}</p>", self.link(self.some(2, 12))])
        elif kind == "form":
            inside = (f"<p>{self.words(self.some(2, 12))}</p>" if self.chance(0.5) else "") + "".join(f"<label>{self.words(self.some(1, 3))}</label><input name=q>" for _ in range(self.some(1, 4))) + f"<button>{self.words(1)}</button>"
        elif kind == "comments":
            one = self.one(["div", "li", "article"])
            each = "".join(self.named(one, AROUND["comments"], f"<b>{self.words(1)}</b><p>{self.words(self.some(3, 60))}</p>" + (self.link(1) if self.chance(0.5) else "")) for _ in range(self.some(1, 8)))
            inside = (f"<h3>{self.words(self.some(1, 3))}</h3>" if self.chance(0.7) else "") + (f"<ol>{each}</ol>" if one == "li" else each)
        else:
            inside = "".join(self.link(self.some(1, 2)) + " " for _ in range(self.some(2, 5)))
        tag = ELEMENT.get(kind) if kind in ELEMENT and self.chance(0.7) else self.one(["div", "div", "section", "aside" if kind in ("advert", "share") else "div"])
        # where elements have no names, what text alone can't tell keeps its name or its element
        bare, self.style = self.style, "named" if kind in ("comments", "notice", "advert") and tag != "form" else self.style
        out = self.named(tag, AROUND[kind], inside, main)
        self.style = bare
        return out

    def paragraph(self) -> str:
        words = self.words(self.some(1, 4) if self.chance(0.15) else self.some(3, 150))
        if self.chance(0.15):
            words = words.replace(" ", " " + self.link(2) + " ", 1)
        kind = self.g.random()
        if kind < 0.72:
            return f"<p>{words}" + ("" if self.chance(0.2) else "</p>")
        if kind < 0.8:
            return f"<p><b>{words}<br>"
        if kind < 0.86:
            return f"<h2>{self.words(self.some(1, 8))}</h2>"
        if kind < 0.91:
            return "<ul>" + "".join(f"<li>{self.words(self.some(2, 20))}</li>" for _ in range(self.some(2, 6))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote><p>{words}</p></blockquote>"
        return self.one([f"<pre>{words}</pre>", f"<div>{words}</div>", "<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr>" for _ in range(self.some(1, 5))) + "</table>"])

    def page(self) -> str:
        self.syllables = ["".join(self.one(list("bcdfghjklmnprstvwz")) + self.one(list("aeiou")) + self.one(["", "", "n", "r", "s"])) for _ in range(40)]
        self.style = self.one(["named", "named", "noise", "bare"])
        self.junk = self.chance(0.15)
        body = [f"<h1>{self.words(self.some(1, 12))}</h1>"] * self.chance(0.8) + [self.paragraph() for _ in range(self.some(1, 20))]
        for kind, p in (("advert", 0.25), ("share", 0.15), ("aside", 0.12), ("comments", 0.15), ("form", 0.08)):
            if self.chance(p):
                body.insert(len(body) if kind == "comments" else 1 + int(self.g.random() * len(body)), self.around(kind))
        tag = self.one(["article", "article", "main", "div", "section", "div", "td"])
        bare = self.style
        self.style = "named" if tag in ("div", "section", "td") and self.chance(0.8) else self.style
        whole = self.chance(0.12)  # no element of its own: the body holds it
        main = "".join(body) if whole else self.named(tag, ARTICLE, "".join(body), "1")
        self.style = bare
        if tag == "td" and not whole:
            main = f"<table><tr>{'<td>' + self.around('menu') + '</td>' if self.chance(0.5) else ''}{main}</tr></table>"
        before = [self.around(k) for k, p in (("notice", 0.2), ("header", 0.5), ("menu", 0.75), ("form", 0.15), ("advert", 0.4), ("aside", 0.1)) if self.chance(p)]
        after = [self.around(k) for k, p in (("share", 0.2), ("comments", 0.3), ("aside", 0.4), ("advert", 0.2), ("form", 0.15), ("menu", 0.1), ("footer", 0.75), ("notice", 0.15)) if self.chance(p)]
        inner = 0 if whole else self.some(1, 3) - 1
        for _ in range(inner):
            take_b, take_a = (int(self.g.random() * (len(x) + 1)) for x in (before, after))
            main = self.named("div", PLAIN, "".join(before[len(before) - take_b :]) + main + "".join(after[:take_a]))
            before, after = before[: len(before) - take_b], after[take_a:]
        if self.chance(0.06):  # a page without an article
            whole, main = False, ""
        if whole and self.chance(0.3):
            before, after = [], []
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body{' data-main="1"' * whole}>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled(pages: int, seed: int = 23) -> list[str]:
    made = Layouts(seed)
    return [made.page() for _ in range(pages)]
