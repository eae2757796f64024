"""Labelled pages to train the extraction model on.

Page layouts are drawn from a small grammar of the parts pages are made of: menus, headers, breadcrumbs, notices,
adverts, articles in various containers, asides and forms within them, share bars, comments, sidebars, footers. Some pages
have no elements at all, some have their article straight in the body, or in elements without names. Every node, the page
itself included, carries the label its part has; texts are drawn words, as the model sees only their lengths and marks.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass
class Part:
    """An element with its attributes, children (parts and strings) and label: 1 main text, 0 anything else."""

    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)
    label: int = 0


_SYLLABLES = "ba ce di fo gu la me ni ro su ta ve wi xo za ren tor lin mas der".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, sentences: int) -> str:
        marks = ".%%%", ".", ".", ".", "?", "!"
        return " ".join(self.phrase(1, 18).capitalize() + self.r.choice(marks) for _ in range(sentences))

    def links(self, tag: str = "li") -> list:
        return [Part(tag, "", [f'<a href="/{self.word()}">{self.phrase(1, 3)}</a>']) for _ in range(self.r.randint(2, 9))]

    def named(self, *names: str) -> str:
        name = self.r.choice(names)
        return self.r.choice([f'class="{name}"', f'id="{name}"', f'class="{name} {self.word()}"', f'class="{self.word()}-{name}"'])

    def menu(self) -> Part:
        items = [Part(self.r.choice(("ul", "ol")), "", self.links())]
        return self.r.choice([Part("nav", self.r.choice(("", self.named("nav", "menu"))), items), Part("div", self.named("nav", "menu", "navbar", "navigation"), items), Part("div", self.named("breadcrumb", "breadcrumbs", "tabs"), self.links("span"))])

    def header(self) -> Part:
        inner = [Part("div", self.named("logo", "brand", "title"), [f'<a href="/">{self.phrase(1, 3)}</a>'])]
        if self.r.random() < 0.4:
            inner.append(Part("p", self.named("tagline", "slogan"), [self.phrase(3, 8)]))
        if self.r.random() < 0.6:
            inner.append(self.menu())
        return Part(*self.r.choice((("header", ""), ("div", self.named("header", "masthead", "topbar", "banner")), ("header", 'role="banner"'))), inner)

    def advert(self) -> Part:
        names = self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor")
        inner = self.r.choice([[self.prose(self.r.randint(1, 3))], [self.phrase(2, 12)], [Part("p", "", [self.prose(self.r.randint(1, 3))])], [f'<a href="/x">{self.phrase(2, 8)}</a>']])
        return Part(self.r.choice(("div", "div", "aside", "section", "p")) if not isinstance(inner[0], Part) else "div", names, inner)

    def notice(self) -> Part:
        names = self.named("cookie", "cookies", "notice", "consent", "alert", "warning", "gdpr", "cookie-banner", "modal", "popup", "message")
        inner = [Part("p", "", [self.prose(self.r.randint(1, 3))])] if self.r.random() < 0.6 else [self.prose(self.r.randint(1, 3))]
        if self.r.random() < 0.5:
            inner.append(Part("button", "", [self.phrase(1, 2)]))
        return Part(self.r.choice(("div", "div", "section", "aside", "dialog")), self.r.choice((names, names, 'role="alert"', 'role="dialog"')), inner)

    def form(self) -> Part:
        inner = [Part("label", "", [self.phrase(1, 4)]), '<input name="q">', Part("button", "", [self.phrase(1, 2)])]
        if self.r.random() < 0.5:
            inner.insert(0, Part(self.r.choice(("p", "h3", "div")), "", [self.prose(1)]))
        form = Part("form", self.r.choice(("", self.named("search", "newsletter", "subscribe", "signup", "login"))), inner)
        return form if self.r.random() < 0.6 else Part("div", self.named("newsletter", "subscribe", "search", "signup"), [form])

    def share(self) -> Part:
        return Part("div", self.named("share", "social", "tags", "meta", "toolbar", "pagination", "pager"), self.links("span"))

    def sidebar(self) -> Part:
        blocks = [Part("div", self.named("widget", "box", "related"), [Part("h3", "", [self.phrase(1, 3)]), Part("ul", "", self.links())])]
        if self.r.random() < 0.5:
            blocks.append(Part("p", "", [self.prose(self.r.randint(1, 4))]))
        if self.r.random() < 0.3:
            blocks.append(self.advert())
        return self.r.choice([Part("aside", self.r.choice(("", self.named("sidebar", "related"))), blocks), Part("div", self.named("sidebar", "side", "related", "recommended", "widgets", "rail"), blocks)])

    def comments(self) -> Part:
        one = self.r.choice(("li", "div", "div", "article", "p"))
        items = []
        for _ in range(self.r.randint(1, 5)):
            said = [Part("span", 'class="author"', [self.phrase(1, 2)]), Part("p", "", [self.prose(self.r.randint(1, 5))])] if one != "p" else [self.prose(self.r.randint(1, 4))]
            items.append(Part(one, self.named("comment", "reply", "comment-body") if one == "article" or self.r.random() < 0.6 else "", said))
        inner = [Part("h3", "", [self.phrase(1, 2)]), *([Part(self.r.choice(("ol", "ul")), "", items)] if one == "li" else items)]
        return Part(self.r.choice(("section", "div", "div")), self.named("comments", "comment-list", "discussion", "responses", "replies", "disqus"), inner)

    def footer(self) -> Part:
        inner = [f"&copy; {self.phrase(1, 3)} &middot; {self.prose(1)}"] if self.r.random() < 0.5 else [Part("p", "", [f"&copy; {self.phrase(2, 9)}"]), Part("ul", "", self.links())]
        return Part(*self.r.choice((("footer", ""), ("footer", ""), ("div", self.named("footer", "copyright", "legal", "bottom")))), inner)

    def block(self) -> Part:
        kind = self.r.random()
        if kind < 0.7:
            text = self.prose(self.r.randint(1, 7))
            if self.r.random() < 0.25:
                text = f"<b>{text}</b>" if self.r.random() < 0.5 else f"<b>{text}<br>"
            if self.r.random() < 0.2:
                text += f' <a href="/{self.word()}">{self.phrase(1, 4)}</a> ' + self.prose(1)
            return Part("p", "", [text], 1)
        if kind < 0.8:
            return Part(self.r.choice(("h2", "h3", "h4")), "", [self.phrase(1, 6)], 1)
        if kind < 0.88:
            return Part(self.r.choice(("ul", "ol")), "", [Part("li", "", [self.phrase(2, 14)], 1) for _ in range(self.r.randint(2, 5))], 1)
        if kind < 0.92:
            return Part("blockquote", "", [Part("p", "", [self.prose(2)], 1)] if self.r.random() < 0.5 else [self.prose(2)], 1)
        if kind < 0.95:
            return Part("pre", "", [self.phrase(5, 20)], 1)
        if kind < 0.97:
            return Part("figure", "", ['<img src="x">', Part("figcaption", "", [self.phrase(2, 9)], 1)], 1)
        rows = [Part("tr", "", [Part("td", "", [self.phrase(1, 3)], 1) for _ in range(3)], 1) for _ in range(self.r.randint(2, 4))]
        return Part("table", "", rows, 1)

    def article(self) -> list[Part]:
        blocks = [self.block() for _ in range(self.r.choice((1, 1, 2, 3, 4, 6, 9)))]
        if self.r.random() < 0.8:
            blocks.insert(0, Part("h1", "", [self.phrase(1, 10)], 1))
        if self.r.random() < 0.15:
            blocks = [Part("div", "", blocks, 1)]
        for make, share in ((self.advert, 0.15), (self.share, 0.15), (self.form, 0.06), (self.sidebar, 0.06), (self.comments, 0.06), (self.notice, 0.06)):
            if self.r.random() < share:
                blocks.insert(self.r.randint(0, len(blocks)), make())
        kind = self.r.random()
        if kind < 0.5:
            return [Part("article", self.r.choice(("", "", self.named("post", "entry", "story"))), blocks, 1)]
        if kind < 0.65:
            return [Part("main", self.r.choice(("", 'role="main"')), blocks, 1)]
        if kind < 0.75:
            return [Part("main", "", [Part("article", "", blocks, 1)], 1)]
        if kind < 0.95:
            return [Part(self.r.choice(("div", "div", "section")), self.named("content", "post", "entry", "article", "article-body", "story", "main", "text", "body"), blocks, 1)]
        return blocks

    def inline(self) -> str:
        """A stretch of text as it stands outside of blocks."""
        text = self.prose(self.r.randint(1, 6)) if self.r.random() < 0.8 else self.phrase(2, 9)
        if self.r.random() < 0.3:
            text += f" <{(tag := self.r.choice(('b', 'i', 'em', 'span')))}>{self.phrase(1, 4)}</{tag}> " + self.r.choice((self.phrase(1, 6), self.prose(1)))
        return text

    def bare(self) -> list:
        """An article without a container: stretches of text, parted by line breaks, and blocks among them."""
        out: list = []
        for _ in range(self.r.randint(1, 5)):
            out += [self.inline(), self.r.choice(("<br>", "<br><br>", "<hr>"))] if self.r.random() < 0.7 else [self.block()]
        return out

    def nameless(self, depth: int) -> Part:
        """An article in nested elements that say nothing."""
        inner: list = []
        for _ in range(self.r.randint(1, 4)):
            kind = self.r.random()
            inner.append(self.nameless(depth - 1) if depth and kind < 0.5 else Part("div", "", [f"<span>{self.inline()}</span>" if kind > 0.8 else self.inline()], 1) if kind < 0.9 else self.block())
        return Part(self.r.choice(("div", "div", "section", "center")), "", inner, 1)

    def page(self) -> Part:
        kind = self.r.random()
        if kind < 0.06:
            return Part("#page", "", [self.r.choice((self.inline, self.inline, lambda: self.phrase(1, 6)))(), *self.r.choice(([], ["<br>", self.inline()], [" ", self.inline()]))], 1)
        if kind < 0.09:
            return Part("#page", "", self.bare(), 1)
        if kind < 0.18:
            before = [make() for make, share in ((self.header, 0.4), (self.menu, 0.4), (self.advert, 0.3)) if self.r.random() < share]
            return Part("body", "", [*before, *self.bare(), *([self.footer()] if self.r.random() < 0.5 else [])], 1)
        if kind < 0.26:
            before = [make() for make, share in ((self.header, 0.4), (self.menu, 0.4), (self.notice, 0.2)) if self.r.random() < share]
            return Part("body", "", [*before, self.nameless(self.r.randint(0, 3)), *([self.footer()] if self.r.random() < 0.5 else [])])
        parts = []
        for make, share in ((self.header, 0.4), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.15), (self.sidebar, 0.15)):
            if self.r.random() < share:
                parts.append(make())
        self.r.shuffle(parts)
        after = [make() for make, share in ((self.share, 0.2), (self.advert, 0.2), (self.sidebar, 0.3), (self.comments, 0.35), (self.form, 0.15), (self.notice, 0.1)) if self.r.random() < share]
        self.r.shuffle(after)
        body = [*parts, *self.article(), *after]
        if self.r.random() < 0.9:
            body.append(self.footer())
        if self.r.random() < 0.2:
            body = [Part("div", self.r.choice(("", self.named("wrapper", "container", "page"))), body)]
        return Part("body", "", body)


def flat(part: Part) -> list[int]:
    """Labels in document order."""
    return [part.label, *(x for c in part.children if isinstance(c, Part) for x in flat(c))]


def html(part: Part) -> str:
    inner = "".join(html(c) if isinstance(c, Part) else c for c in part.children)
    return inner if part.tag == "#page" else f"<{part.tag}{' ' + part.attributes if part.attributes else ''}>{inner}</{part.tag}>"
