"""Generated labelled pages for training: a bounded sample of layouts with known main text.

Content carries ``data-content="1"``, everything else ``"0"``; a mark holds for
what is below it.  Words are drawn from random letters, so that nothing of the
text itself is learnt, only its shape and place.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

MENU = ("menu", "nav", "navbar", "navigation", "topnav", "main-menu", "site-nav", "breadcrumbs", "breadcrumb", "pagination", "pager", "links", "toc")
HEAD = ("header", "site-header", "masthead", "banner", "topbar", "top", "branding", "logo")
FOOT = ("footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal")
SIDE = ("sidebar", "side", "aside", "widget", "rail", "related", "recommended", "trending", "popular", "more", "tags", "social", "share", "author-box")
NOTE = ("notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "promo", "disclaimer", "warning", "message")
AD = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "adsbox", "banner-ad", "ad-slot", "promo", "outbrain", "taboola")
TALK = ("comments", "comment", "comment-list", "reader-comments", "discussion", "replies", "responses", "disqus", "feedback", "thread")
BODY = ("content", "main", "article", "post", "entry", "entry-content", "post-content", "post-body", "article-body", "story", "text", "body", "page-content", "main-content")
#: Parts of an article whose names begin like those of other things.
PARTS = ("work", "results", "methods", "history", "background", "notes", "introduction", "reading", "section", "chapter", "facts", "data")
WRAP = ("wrapper", "container", "page", "layout", "row", "col", "inner", "site", "grid", "app", "root", "wrap", "column")


class Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("etaoinshrdlucmfwypvbgk") for _ in range(1 + int(self.r.expovariate(0.25)) % 11))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(max(1, n)))

    def sentences(self, n: int) -> str:
        mark = self.r.choice([".", ".", ".", ".###", "!!"])
        return " ".join(self.words(self.r.randint(1, 16)).capitalize() + mark for _ in range(n))

    def names(self, of: tuple[str, ...]) -> str:
        r = self.r
        name = self.spelt(r.choice(of))
        kind = r.random()
        if kind < 0.55:
            return f' class="{name}"'
        if kind < 0.75:
            return f' id="{name}"'
        return f' class="{name} {r.choice(WRAP)}" id="{r.choice(of)}"'

    def spelt(self, name: str) -> str:
        """A name with hyphens, sometimes in camel case or with underscores."""
        first, *rest = name.split("-")
        kind = self.r.random()
        return first + "".join(x.capitalize() for x in rest) if kind < 0.15 else "_".join([first, *rest]) if kind < 0.25 else name

    def links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self.words(self.r.randint(1, 3))}</a>' for k in range(n)]
        form = self.r.random()
        if form < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def tag(self, special: tuple[str, ...], of: tuple[str, ...], inside: str) -> str:
        r = self.r
        t = r.choice([*special, "div", "section"]) if r.random() < 0.8 else "div"
        bare = t in special and r.random() < 0.5
        return f'<{t}{"" if bare else self.names(of)} data-content="0">{inside}</{t}>'

    def prose(self) -> str:
        return self.sentences(self.r.choice([1, 1, 2, 3, 5])) if self.r.random() < 0.7 else self.words(self.r.randint(2, 20))

    def noise(self, where: str) -> str:
        r = self.r
        if where == "menu":
            return self.tag(("nav", "nav", "ul"), MENU, self.links(r.randint(2, 9)))
        if where == "header":
            inside = r.choice([self.words(3), f"<h1>{self.words(3)}</h1><p>{self.prose()}</p>", self.noise("menu"), f"<a href=/>{self.words(2)}</a>"])
            return self.tag(("header", "header"), HEAD, inside)
        if where == "footer":
            inside = r.choice([f"&copy; {self.word()} &middot; {self.prose()}", f"<p>{self.prose()}</p>", self.links(4), f"<p>&copy; {self.words(3)}</p>{self.links(3)}"])
            return self.tag(("footer", "footer"), FOOT, inside)
        if where == "side":
            inside = r.choice([f"<h3>{self.words(2)}</h3>{self.links(5)}", f"<p>{self.prose()}</p>", f"<h2>{self.words(2)}</h2><p>{self.prose()}</p><p>{self.prose()}</p>", self.prose()])
            return self.tag(("aside", "aside"), SIDE, inside)
        if where in ("ad", "notice") and r.random() < 0.15:
            return f'<p{self.names(AD if where == "ad" else NOTE)} data-content="0">{self.prose()}</p>'
        if where == "notice":
            inside = r.choice([self.prose(), f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p><button>{self.word()}</button>"])
            return self.tag(("dialog",), NOTE, inside)
        if where == "ad":
            return self.tag((), AD, r.choice([self.prose(), f"<p>{self.prose()}</p>", f'<a href="/x">{self.words(4)}</a>', f"<span>{self.prose()}</span>"]))
        if where == "form":
            inside = f"<label>{self.words(2)}</label><input name=q><p>{self.prose()}</p><button>{self.word()}</button>"
            return f'<form{r.choice(["", self.names(("search", "login", "signup", "contact"))])} data-content="0">{inside}</form>'
        one = r.choice([lambda: f"<p>{self.prose()}</p>", lambda: f'<div class="comment"><b>{self.word()}</b> <p>{self.prose()}</p></div>', lambda: f"<li>{self.prose()}</li>", lambda: f'<article class="comment"><p>{self.prose()}</p></article>'])
        head = r.choice(["", f"<h2>{self.words(2)}</h2>", f"<h3>{self.word()}</h3>"])
        return self.tag(("section", "ol"), TALK, head + "".join(one() for _ in range(r.randint(1, 5))))

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            return f"<p>{self.prose()}</p>" if r.random() < 0.85 else f"<p>{self.prose()}"
        if kind < 0.66:  # a paragraph that is mostly, or all, a link
            return r.choice([f'<p><a href="/{self.word()}">{self.prose()}</a></p>', f'<p>{self.words(3)} <a href="/{self.word()}">{self.prose()}</a> {self.words(2)}.</p>'])
        if kind < 0.69:
            return "<ol>" + "".join(f"<li>{self.prose()}</li>" for _ in range(r.randint(2, 7))) + "</ol>"
        if kind < 0.71:
            name = self.spelt(f"{r.choice(SIDE + TALK + NOTE)}-{r.choice(PARTS)}")
            return f'<section class="{name}"><h2>{self.words(2)}</h2>' + "".join(f"<p>{self.prose()}</p>" for _ in range(r.randint(1, 3))) + "</section>"
        if kind < 0.72:
            return '<table class="infobox">' + "".join(f"<tr><th>{self.words(1)}</th><td>{self.words(r.randint(1, 5))}</td></tr>" for _ in range(r.randint(2, 6))) + "</table>"
        if kind < 0.78:
            return f"<p><b>{self.prose()}<br><p>{self.prose()}</p>"
        if kind < 0.83:
            return f"<h2>{self.words(r.randint(1, 6))}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if kind < 0.94:
            return f"<pre>{self.words(12)}</pre>"
        if kind < 0.97:
            return f"<table><tr><th>{self.word()}</th><th>{self.word()}</th></tr><tr><td>{self.word()}</td><td>{self.words(4)}</td></tr></table>"
        return f"<figure><img src=x><figcaption>{self.words(6)}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        if r.random() < 0.1:  # straight in the body
            blocks = [f'<h1 data-content="1">{self.words(r.randint(1, 9))}</h1>'] * (r.random() < 0.7)
            return "".join(blocks + [f'<p data-content="1">{self.prose()}</p>' for _ in range(r.choice([1, 2, 3, 5, 8]))])
        blocks = [self.block() for _ in range(r.choice([1, 2, 3, 5, 8, 14]))]
        if r.random() < 0.85:
            title = f"<h1>{self.words(r.randint(1, 9))}</h1>"
            blocks.insert(0, f"<header>{title}</header>" if r.random() < 0.1 else title)
        for where in ("ad", "side", "notice", "form", "menu", "comments"):
            if r.random() < 0.13:
                blocks.insert(r.randint(1, len(blocks)), self.noise(where))
        inside = "".join(blocks)
        if r.random() < 0.15:
            inside = f'<div{self.names(WRAP)}>{inside}</div>'
        kind = r.random()
        if kind < 0.06:  # columns by a table
            side = f'<td{r.choice(["", self.names(SIDE + MENU)])} data-content="0">{self.links(r.randint(2, 8))}</td>'
            body = f'<td{r.choice(["", self.names(BODY)])} data-content="1">{inside}</td>'
            cells = r.choice([side + body, body + side, side + body + side])
            return f'<table{r.choice(["", " width=100%", self.names(WRAP)])}><tr>{cells}</tr></table>'
        if kind < 0.6:
            name = "" if r.random() < 0.6 else self.names(BODY)
            return f'<article{name} data-content="1">{inside}</article>'
        if kind < 0.75:
            return f'<main data-content="1">{inside}</main>'
        return f'<{r.choice(["div", "section"])}{self.names(BODY)} data-content="1">{inside}</div>'

    def page(self) -> str:
        r = self.r
        pick = lambda w, p: self.noise(w) if r.random() < p else ""
        inside = "".join(
            [pick("notice", 0.2), pick("header", 0.4), pick("menu", 0.7), pick("ad", 0.4), pick("side", 0.15), self.article(),
             pick("comments", 0.3), pick("side", 0.3), pick("form", 0.2), pick("ad", 0.2), pick("footer", 0.8), pick("notice", 0.1)]
        )
        if r.random() < 0.4:
            inside = f"<div{self.names(WRAP)}>{inside}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(5)}</title><style>p{{}}</style></head><body>{inside}</body></html>"


def labelled_pages(pages: int = 240, seed: int = 5) -> Iterator[str]:
    """``pages`` generated pages; the same for the same seed."""
    for k in range(pages):
        yield Page(seed * 1_000_003 + k).page()
