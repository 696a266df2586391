"""Pages with known labels, written by rule, on which the costs of html_mincut are fitted.

Four writers have different habits: pages with telling names (Writer), plain ones without any (Plain), tables that lay a page out
(Tables), and pages that stand in one form as a whole (Framed).

Each page has an article, in one of many wrappers, among parts that are none: menus, headers, footers, sidebars,
notices, adverts, forms and comments, in elements with and without telling names, some inside the article. Names that
only sound like boilerplate enclose articles now and then. The first character of each block is its label.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

CONTENT, APART = "\ue000", "\ue001"
KNOWN = {CONTENT: 1, APART: 0}
#: Opening tags of what isn't the article, and what stands inside: links, a few words, sentences or fields.
OTHERS = [
    ("nav", "links"), ("ul class=menu", "links"), ("div id=navigation", "links"), ("div class=breadcrumbs", "links"), ("div", "links"), ("ul", "links"), ("div class=topbar", "words"),
    ("header", "words"), ("header", "links"), ("div id=header", "words"), ("footer", "words"), ("footer", "links"), ("footer", "sentences"), ("div class=footer", "sentences"), ("div id=footer", "words"), ("div", "words"),
    ("aside", "sentences"), ("aside", "links"), ("div class=sidebar", "links"), ("div id=sidebar", "sentences"), ("div class=widget", "words"),
    ("div class=ad", "words"), ("div class=ad", "sentences"), ("div class=advert", "sentences"), ("div class=ad-slot", "words"), ("section class=sponsored", "sentences"), ("div id=promo", "words"),
    ("div class=cookie-notice", "sentences"), ("div id=cookie-bar", "sentences"), ("div role=dialog", "sentences"), ("div class=newsletter-signup", "words"), ("div class=notice", "sentences"),
    ("form", "fields"), ("form class=search", "fields"), ("div role=search", "words"), ("form", "sentences"),
    ("section id=comments", "sentences"), ("div class=comments", "sentences"), ("ol class=comment-list", "sentences"), ("div class=reply", "words"),
    ("div class=related-posts", "links"), ("div class=share-buttons", "links"), ("div class=tags", "links"), ("div class=pagination", "links"), ("p class=copyright", "bare"), ("div hidden", "sentences"), ('div style="display:none"', "words"),
]
#: Opening tags around an article.
WRAPPERS = ["article", "article", "article", "main", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div id=story", "div", "div", "section", "", "section class=social-policy", "div class=share-prices", "section class=social-policy", "div class=share-prices", "div class=menu-of-the-day", "section class=notice-of-motion", "div class=page", ""]
#: What an article is made of, and how often.
PARTS = [("p", 12), ("short p", 2), ("h2", 2), ("li", 2), ("blockquote", 1), ("pre", 1), ("td", 1), ("div", 1), ("linked p", 2), ("figcaption", 1), ("apart", 2), ("owned", 1)]
#: What lines say that tell who owns a page; articles say so, too.
OWNED = ["All rights reserved", "Copyright", "&copy; 2024"]


def element(opening: str, inner: str) -> str:
    return f"<{opening}>{inner}</{opening.split()[0]}>" if opening else inner


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choice("aeionrstlcdmpu") for _ in range(self.rng.randint(2, 9))) for _ in range(200)]

    def said(self, least: int, most: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(least, most)))

    def sentences(self, most: int = 9) -> str:
        return " ".join(self.said(5, 18).capitalize() + "." for _ in range(self.rng.randint(1, most)))

    def other(self) -> str:
        opening, kind = self.rng.choice(OTHERS)
        if kind == "links":
            item = "li" if opening.startswith("ul") or self.rng.random() < 0.5 else "p"
            return element(opening, "".join(element(item, f"<a href=x>{APART}{self.said(1, 3)}</a>") for _ in range(self.rng.randint(2, 8))))
        item = self.rng.choice(["p", "div", "div"])
        if kind == "words":
            return element(opening, "".join(element(item, APART + self.said(1, 6)) for _ in range(self.rng.randint(1, 2))))
        if kind == "fields":
            return element(opening, "".join(element(item, APART + self.said(1, 2) + "<input name=x>") for _ in range(self.rng.randint(1, 4))))
        if kind == "bare":
            return element(opening, APART + "&copy; " + self.said(2, 6))
        item = "li" if opening.startswith("ol") else item
        return element(opening, "".join(element(item, APART + self.sentences(2)) for _ in range(self.rng.randint(1, 2))))

    def part(self) -> str:
        kind = self.rng.choices([k for k, _ in PARTS], [n for _, n in PARTS])[0]
        if kind == "apart":
            return self.other()
        if kind == "li":
            return element("ul", "".join(element("li", CONTENT + self.said(2, 12)) for _ in range(self.rng.randint(2, 5))))
        if kind == "td":
            return element("table", element("tr", "".join(element("td", CONTENT + self.said(1, 4)) for _ in range(3))))
        if kind == "linked p":
            return element("p", f"{CONTENT}{self.said(4, 9)} <a href=x>{self.said(1, 3)}</a> {self.sentences(3)}")
        if kind == "owned":
            return element("p", CONTENT + self.rng.choice(OWNED) + self.rng.choice(["", " " + self.said(1, 6)]) + self.rng.choice([".", ""]))
        if kind == "short p":
            return element("p", CONTENT + self.said(1, 6) + self.rng.choice([".", ":", ""]))
        if kind in ("h2", "figcaption", "pre", "div"):
            return element(kind, CONTENT + self.said(2, 9))
        return element(kind, CONTENT + self.sentences())

    def page(self) -> str:
        around = lambda: "".join(self.other() for _ in range(self.rng.randint(1, 4)))
        article = (element("h1", CONTENT + self.said(2, 9)) if self.rng.random() < 0.8 else element("p", CONTENT + self.sentences())) + "".join(self.part() for _ in range(self.rng.randint(1, 14)))
        inner = element(self.rng.choice(WRAPPERS), article)
        if self.rng.random() < 0.4:
            inner = element(self.rng.choice(["div", "div class=wrap", "div id=page"]), inner)
        return element("body", around() + inner + around())


class Plain(Writer):
    """Pages of bare elements: what is an article shows only by length, links and place."""

    def bare(self) -> str:
        kind = self.rng.choice(["links", "links", "words", "legal", "legal", "bar"])
        if kind == "links":
            box, item = self.rng.choice([("ul", "li"), ("div", "p"), ("div", "div"), ("p", "")])
            return element(box, " ".join(element(item, f"<a href=x>{APART if item or not n else ''}{self.said(1, 3)}</a>") for n in range(self.rng.randint(2, 8))))
        if kind == "words":
            return element(self.rng.choice(["div", "p"]), APART + self.said(1, 4))
        if kind == "bar":
            return element("div", APART + " | ".join(f"<a href=x>{self.said(1, 2)}</a>" for _ in range(self.rng.randint(2, 6))))
        return element(self.rng.choice(["div", "p", "div"]), APART + self.rng.choice([*OWNED, ""]) + " " + self.said(1, 5) + self.rng.choice([".", "", ""]))

    def body(self) -> str:
        item = self.rng.choice(["p", "p", "div", "div", "td"])
        title = element(self.rng.choice(["h1", "h2"]), CONTENT + self.said(2, 8)) if self.rng.random() < 0.7 else ""
        if self.rng.random() < 0.3:
            # one block for all
            return title + element("div", CONTENT + " ".join(self.sentences() for _ in range(self.rng.randint(1, 5))))
        return title + "".join(element(item, CONTENT + (self.sentences() if self.rng.random() < 0.85 else self.said(2, 8))) for _ in range(self.rng.randint(1, 10)))

    def page(self) -> str:
        around = lambda: "".join(self.bare() for _ in range(self.rng.randint(0, 3)))
        inner = element(self.rng.choice(["", "", "div", "div", "section"]), self.body())
        return element("body", element(self.rng.choice(["", "", "div"]), around() + inner + around()))


class Tables(Plain):
    """Pages laid out by a table: a column of links, one of text."""

    def page(self) -> str:
        side = element("td", "".join(self.bare() for _ in range(self.rng.randint(1, 3))))
        middle = element("td", "".join(element(self.rng.choice(["p", "div"]), CONTENT + self.sentences()) for _ in range(self.rng.randint(1, 8))))
        row = element("tr", side + middle if self.rng.random() < 0.7 else middle + side)
        return element("body", element("table", element("tr", element("td", self.bare())) + row + element("tr", element("td", self.bare()))))


class Framed(Plain):
    """Pages in one form, with another page's parts inside."""

    def page(self) -> str:
        other = self.rng.choice([Writer.page, Plain.page])(self)
        return element("body", element(self.rng.choice(['form id="aspnetForm" method=post', "form", "form name=frm"]), other.removeprefix("<body>").removesuffix("</body>")))


def labelled_pages(n: int = 500, seed: int = 11) -> Iterator[tuple[str, dict[str, int]]]:
    """n pages of each writer, and what the first character of each of their blocks says: 1 for the article."""
    for kind, writer in enumerate((Writer, Plain, Tables, Framed)):
        written = writer(seed + kind)
        for _ in range(n):
            yield written.page(), KNOWN
