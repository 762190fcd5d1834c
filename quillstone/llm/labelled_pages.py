"""Labelled web pages to train the extraction model on, made by rule.

A page is drawn from a grammar of layouts: an article in one of several containers, which may
have no name, one that says nothing, or may be the page's body itself, surrounded by and sometimes
interleaved with menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
Content and noise alike may bear names that a program generated. Each element of the grammar says whether its text is content. An article's own header, with its
heading and byline, is.
"""

from __future__ import annotations

import random
import re

from . import dom

_MARK = "data-y"
# fixed values: names that sites give their parts
CONTENT = ["content", "post", "entry", "article-body", "story", "main-text", "post-content", "articleBody", "entry-content", "body-copy", "text"]
MENU = ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "tabs", "toolbar", "site-nav"]
SIDE = ["sidebar", "side", "widget", "related", "recommended", "trending", "popular", "more-stories", "rail"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"]
NOTICE = ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "warning", "popup", "modal", "disclaimer", "paywall"]
COMMENT = ["comments", "comment", "comment-list", "reply", "disqus", "responses", "discussion", "reader-comments"]
FOOTER = ["footer", "site-footer", "copyright", "bottom", "colophon", "legal"]
HEADER = ["header", "masthead", "top", "site-header", "logo", "branding"]
SHARE = ["share", "social", "share-buttons", "tags", "follow"]
BYLINE = ["byline", "author", "meta", "date", "entry-meta", "published"]
TOP = ["entry-header", "post-header", "article-header"]
PLAIN = ["wrapper", "container", "page", "layout", "row", "inner", "col", "site", "wrap"]
FORM = ["form", "search", "newsletter", "subscribe", "signup", "login", "contact-form"]

ROLES = {"nav": ["navigation"], "aside": ["complementary"], "footer": ["contentinfo"], "header": ["banner"], "form": ["search"], "main": ["main"]}
#: All words of these names; any other word of a class, id or role says nothing.
KNOWN = frozenset(
    w.lower()
    for names in (CONTENT, MENU, SIDE, ADVERT, NOTICE, COMMENT, FOOTER, HEADER, SHARE, BYLINE, TOP, PLAIN, FORM, *ROLES.values())
    for name in names
    for w in re.findall(r"[A-Z]?[a-z]+", name)
)


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        n, out = r.randint(low, high), []
        if r.random() < 0.2:  # without stops, sometimes one word again and again
            word = lambda: "".join(r.choice("aeioustrnlmdch") for _ in range(r.randint(1, 9)))
            if r.random() < 0.5:
                return " ".join(word() for _ in range(n))
            return " ".join([f"{word()} " * r.randint(1, max(1, n)) for _ in range(r.randint(1, 3))])
        while len(out) < n:
            sentence = ["".join(r.choice("aeioustrnlmdch") for _ in range(r.randint(1, 9))) for _ in range(r.randint(3, 14))]
            if len(sentence) > 6 and r.random() < 0.5:
                sentence[3] += ","
            out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + r.choice(["", ".", ".", ".", "?"])]
        return " ".join(out[:n]) + ("." if n > 12 else "")

    def tag(self, name: str, inner: str, y: int, names: list[str] | None = None) -> str:
        r, extra = self.rng, ""
        if name in ROLES and r.random() < 0.1:
            extra = f' role="{ROLES[name][0]}"'
        elif names is None and r.random() < 0.1:
            extra = f' class="{self.generated()}"'
        elif names and r.random() < 0.96:
            extra = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
        return f'<{name}{extra} {_MARK}="{y}">{inner}</{name}>'

    def generated(self) -> str:
        """A name as programs make them."""
        r = self.rng
        return r.choice(["css-", "sc-", "jsx-", "_", "x", ""]) + "".join(r.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(r.randint(2, 8)))

    def links(self, y: int = 0) -> str:
        r = self.rng
        items = "".join(self.tag("li", f'<a href="/{i}">{self.words(1, 4)}</a>', y) for i in range(r.randint(2, 9)))
        return self.tag("ul", items, y)

    def noise(self) -> str:
        r = self.rng
        short = lambda: self.tag("p", self.words(2, 25), 0)
        bare = lambda: self.words(2, 25)
        loose = lambda: r.choice([short, bare])()
        heading = lambda: self.tag(r.choice(["h2", "h3", "h4"]), self.words(1, 4), 0)
        choice = r.randrange(10)
        if choice == 0:
            return self.tag("nav", self.links(), 0, r.choice([None, MENU]))
        if choice == 1:
            return self.tag("div", self.links(), 0, MENU)
        if choice == 2:
            return self.tag("aside", heading() + r.choice([self.links, short, bare])(), 0, r.choice([None, SIDE]))
        if choice == 3:
            return self.tag("div", heading() + r.choice([self.links, short, lambda: short() + short()])(), 0, SIDE)
        if choice == 4:
            return self.tag("div", loose(), 0, ADVERT)
        if choice == 5:
            return self.tag(r.choice(["div", "section", "p"]), bare(), 0, NOTICE)
        if choice == 6:
            fields = self.tag("label", self.words(1, 3), 0) + '<input name="q">' + self.tag("button", self.words(1, 2), 0)
            return self.tag("form", r.choice([short(), ""]) + fields, 0, r.choice([None, FORM]))
        if choice == 7:
            return self.comments()
        if choice == 8:
            return self.tag("div", r.choice([self.links, bare])(), 0, SHARE)
        return self.tag(r.choice(["div", "section"]), self.tag("p", self.words(3, 40), 0), 0, r.choice([NOTICE, ADVERT]))

    def comments(self) -> str:
        r = self.rng
        one = lambda: self.tag(r.choice(["div", "li", "article"]), self.tag("p", self.words(3, 60), 0), 0, COMMENT)
        return self.tag(r.choice(["div", "section"]), self.tag("h3", self.words(1, 3), 0) + "".join(one() for _ in range(r.randint(1, 4))), 0, COMMENT)

    def body(self) -> str:
        """The blocks of an article, now and then with something foreign between them."""
        r, out = self.rng, []
        if r.random() < 0.8:
            heading = self.tag(r.choice(["h1", "h1", "h2"]), self.words(2, 12), 1)
            if r.random() < 0.3:
                heading += self.tag(r.choice(["p", "div"]), self.words(1, 8), 1, r.choice([None, BYLINE]))
            out.append(self.tag("header", heading, 1, r.choice([None, TOP])) if r.random() < 0.25 else heading)
        short = r.random() < 0.3  # some articles are all short lines, or one line many times
        line = self.words(1, 4)
        block = r.choice(["p"] * 6 + ["div"])  # what holds a paragraph
        for _ in range(r.randint(1, r.choice([10, 60]) if short else 7)):
            p = r.random()
            text = r.choice([line, self.words(1, 6)]) if short else self.words(1, 120)
            p = p * 0.7 if short else p
            if r.random() < 0.3:
                cut = text.split(" ")
                k = r.randrange(len(cut))
                cut[k] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>']).format(cut[k])
                text = " ".join(cut)
            if r.random() < 0.2:
                text = "<b>" + text
            if p < 0.75:
                out.append(self.tag(block, text, 1))
            elif p < 0.82:
                out.append(self.tag(r.choice(["h2", "h3"]), self.words(1, 8), 1))
            elif p < 0.88:
                out.append(self.tag("ul", "".join(self.tag("li", self.words(2, 20), 1) for _ in range(r.randint(2, 5))), 1))
            elif p < 0.92:
                out.append(self.tag("blockquote", r.choice([text, self.tag("p", text, 1)]), 1))
            elif p < 0.95:
                row = lambda cell: self.tag("tr", "".join(self.tag(cell, self.words(1, 4), 1) for _ in range(3)), 1)
                out.append(self.tag("table", row(r.choice(["td", "th"])) + row("td") + row("td") * r.randint(0, 3), 1))
            elif p < 0.97:
                out.append(self.tag("pre", "\n".join(self.words(1, 12) for _ in range(r.randint(1, 6))), 1))
            else:
                out.append(self.tag("div", text, 1))
            if r.random() < 0.08:
                out.append(self.noise())
        if len(out) > 2 and r.random() < 0.15:  # in parts
            name, cut = r.choice(["section", "div"]), sorted(r.sample(range(1, len(out)), min(len(out) - 1, r.randint(1, 2))))
            out = [self.tag(name, "".join(out[i:k]), 1) for i, k in zip([0, *cut], [*cut, len(out)], strict=True)]
        return "".join(out)

    def loose(self) -> str:
        """An article whose paragraphs are lines of text without elements of their own, or one element of such lines."""
        r = self.rng
        line = lambda: self.words(6, 60)
        lines = r.choice(["<br><br>", "<br>", "<br/>\n"]).join(line() for _ in range(r.randint(1, 6)))
        whole = r.choice([lines, lines, self.tag("pre", lines, 1)])
        return (self.tag("h1", self.words(2, 9), 1) if r.random() < 0.4 else "") + whole

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.04:  # plain prose
            return self.words(8, 120)
        bare = r.random() < 0.12
        body = self.loose() if bare else self.body()
        layout = r.choice([0, 2, 6, 9, 9, 9]) if bare else r.randrange(11)
        if layout <= 1:
            main = self.tag("article", body, 1, r.choice([None, None, CONTENT]))
        elif layout == 2:
            main = self.tag("main", body, 1, r.choice([None, CONTENT]))
        elif layout == 3:
            main = self.tag("div", body, 1, CONTENT)
        elif layout == 4:
            main = self.tag("main", self.tag("article", body, 1), 1)
        elif layout == 5:
            main = self.tag("section", body, 1, CONTENT)
        elif layout <= 7:
            main = self.tag(r.choice(["div", "div", "section"]), body, 1)
        elif layout == 8:
            main = self.tag("div", body, 1, [*PLAIN, "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 6)))])
        elif layout == 9:
            main = body  # in the page's body, or in the whole of the document
        else:
            cells = self.tag("td", body, 1) + self.tag("td", self.links(), 0, r.choice([None, SIDE])) * r.randint(0, 1)
            main = self.tag("table", self.tag("tr", cells, 1), 1)
        if r.random() < 0.15:  # the article alone
            return self.tag("body", main, 1) if layout == 9 else main
        while layout != 9 and r.random() < 0.35:
            main = self.tag("div", main, 1, r.choice([None, PLAIN]))
        top = self.tag("header", self.tag(r.choice(["div", "p", "h2"]), self.words(1, 5), 0) + r.choice(["", self.links()]), 0, r.choice([None, HEADER])) if r.random() < 0.5 else ""
        if r.random() < 0.2:
            top += self.tag("div", r.choice([self.words(1, 8), self.links()]), 0, HEADER)
        before = "".join(self.noise() for _ in range(r.randint(0, 3)))
        after = "".join(self.noise() for _ in range(r.randint(0, 3)))
        sign = r.choice(["&copy; ", "&copy; ", "", "© "]) + self.words(2, 25)
        end = self.tag("footer", r.choice([sign, self.tag("p", sign, 0), self.links()]), 0, r.choice([None, FOOTER])) if r.random() < 0.8 else self.tag("div", sign, 0, FOOTER)
        if bare and r.random() < 0.5:
            top = before = after = end = ""
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body {_MARK}="{int(layout == 9)}">{top}{before}{main}{after}{end}</body></html>'


def labels(nodes: list[dom.Node]) -> list[int]:
    """The mark of each node, or that of the nearest marked node around it; a page of nothing but text is content."""
    out: list[int] = []
    for node in nodes:
        mark = dom.attribute(node.attributes, _MARK)
        out.append(int(mark) if mark else out[node.parent] if node.parent >= 0 else int(len(nodes) == 1))
    return out


def labelled_pages(n: int, seed: int) -> list[tuple[list[dom.Node], list[int]]]:
    """`n` pages as nodes without the marks, and the label of each node."""
    maker, out = Maker(seed), []
    for _ in range(n):
        nodes = dom.parse(maker.page())
        y = labels(nodes)
        for node in nodes:
            node.attributes = node.attributes.replace(f'{_MARK}="0"', "").replace(f'{_MARK}="1"', "")
        out.append((nodes, y))
    return out
