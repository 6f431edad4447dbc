"""Made-up web pages whose every element is labelled, to train the extractor on.

Labels: 0 holds main text and other things, 1 main text, 2 anything else.
"""

from __future__ import annotations

import random

SYLLABLES = "an re th on er in st ou ly ble ha nd ti es or at en sh wh ing ed the of to ge ver ung keit ción ado mente que eau aux ñ é ü ß ö".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def says(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, max(low, high)))]
        for k in range(0, len(words), self.r.randint(6, 14)):
            words[k] = words[k].capitalize()
            if k:
                words[k - 1] += self.r.choice([".", ".", ",", ". &amp;", " &quot;"])
        return " ".join(words) + (self.r.choice(["", "", ".", "?", "!"]) if len(words) < 16 else ".")

    def title(self) -> str:
        """A heading; some are the beginning of a text, cut off."""
        text = self.says(1, 14)
        return text[: self.r.randint(20, 70)].strip(" &") if self.r.random() < 0.4 and "&" not in text else text

    def tag(self, name: str, label: int, inner: str, attrs: str = "", close: bool = True) -> str:
        return f'<{name} data-label="{label}"{attrs}>{inner}' + (f"</{name}>" if close else "")

    def named(self, *names: str) -> str:
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}{self.r.choice(["", "", "-" + self.word(), " " + self.word()])}"'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(low, high)))}</a>'

    def links(self, n: int) -> str:
        if self.r.random() < 0.7:
            return self.tag("ul", 2, "".join(self.tag("li", 2, self.link(), close=self.r.random() < 0.8) for _ in range(n)))
        return self.r.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def paragraph(self, label: int, low: int = 3, high: int = 90) -> str:
        text = self.says(low, high)
        if self.r.random() < 0.25:
            text = f"<b>{text}" + ("</b>" if self.r.random() < 0.6 else "") + ("<br>" if self.r.random() < 0.5 else "")
        if self.r.random() < 0.2:
            text += " " + self.link() + " " + self.says(2, 12)
        return self.tag(self.r.choice(["p", "p", "p", "p", "div"]), label, text, close=self.r.random() < 0.8)

    def nav(self) -> str:
        name, attrs = self.r.choice([("nav", ""), ("nav", self.named("menu", "main-nav")), ("div", self.named("nav", "menu", "navbar", "breadcrumbs")), ("ul", self.named("menu", "nav")), ("div", "")])
        return self.tag(name, 2, self.links(self.r.randint(3, 12)), attrs)

    def header(self) -> str:
        name, attrs = self.r.choice([("header", ""), ("header", self.named("site-header")), ("div", self.named("header", "masthead", "topbar", "banner"))])
        inner = self.tag(self.r.choice(["h1", "div", "p"]), 2, self.says(1, 5)) + (self.tag("p", 2, self.says(3, 12)) if self.r.random() < 0.5 else "")
        return self.tag(name, 2, inner + (self.nav() if self.r.random() < 0.5 else ""), attrs)

    def ad(self) -> str:
        name, attrs = self.r.choice([("div", self.named("ad", "advert", "sponsored", "promo", "ads", "advertisement")), ("aside", self.named("ad", "promo")), ("section", self.named("sponsored"))])
        text = self.says(4, 40)
        return self.tag(name, 2, text if self.r.random() < 0.6 else self.paragraph(2, 4, 40), attrs)

    def notice(self) -> str:
        attrs = self.named("cookie", "cookie-notice", "notice", "consent", "alert", "popup", "newsletter", "banner-notice")
        return self.tag(self.r.choice(["div", "div", "section", "aside"]), 2, self.paragraph(2, 5, 50) + (self.tag("button", 2, "OK") if self.r.random() < 0.5 else ""), attrs)

    def share(self) -> str:
        return self.tag("div", 2, self.links(self.r.randint(2, 6)), self.named("share", "social", "tags"))

    def related(self) -> str:
        title = self.tag(self.r.choice(["h2", "h3", "h4"]), 2, self.says(1, 3))
        return self.tag(self.r.choice(["div", "section", "aside"]), 2, title + self.links(self.r.randint(2, 8)), self.named("related", "recommended", "more"))

    def form(self) -> str:
        inner = "".join(self.tag("label", 2, self.says(1, 4)) + '<input name="x">' for _ in range(self.r.randint(1, 4))).replace("<label data-label=\"2\">", "<label>")
        return self.tag("form", 2, self.tag("p", 2, self.says(2, 20)) + inner + self.tag("button", 2, self.word()), self.r.choice(["", self.named("search", "login", "signup", "newsletter")]))

    def comments(self) -> str:
        rows = []
        for _ in range(self.r.randint(1, 8)):
            name, attrs = self.r.choice([("li", ""), ("div", self.named("comment", "reply")), ("article", self.named("comment")), ("li", self.named("comment"))])
            rows.append(self.tag(name, 2, self.tag("p", 2, self.says(1, 4)) + "".join(self.paragraph(2, 3, 60) for _ in range(self.r.randint(1, 3))), attrs))
        inner = self.tag("h3", 2, self.says(1, 3)) + (self.tag("ol", 2, "".join(rows), self.r.choice(["", self.named("comment-list")])) if self.r.random() < 0.5 else "".join(rows))
        return self.tag(self.r.choice(["div", "section"]), 2, inner + (self.form() if self.r.random() < 0.4 else ""), self.named("comments", "discussion", "responses-comments", "respond"))

    def sidebar(self) -> str:
        name, attrs = self.r.choice([("aside", ""), ("aside", self.named("sidebar")), ("div", self.named("sidebar", "rail", "widget-area", "secondary"))])
        parts = [self.r.choice([self.related, self.ad, self.nav, self.notice, lambda: self.tag("div", 2, self.tag("h3", 2, self.says(1, 3)) + self.paragraph(2, 5, 40), self.named("widget"))])() for _ in range(self.r.randint(1, 4))]
        return self.tag(name, 2, "".join(parts), attrs)

    def footer(self) -> str:
        name, attrs = self.r.choice([("footer", ""), ("footer", self.named("site-footer")), ("div", self.named("footer", "copyright", "legal"))])
        text = f"&copy; {self.word()}.example.net &middot; " + self.says(3, 25)
        return self.tag(name, 2, (text if self.r.random() < 0.6 else self.tag("p", 2, text)) + (self.nav() if self.r.random() < 0.4 else ""), attrs)

    def content(self) -> str:
        parts = []
        if self.r.random() < 0.85:
            parts.append(self.tag(self.r.choice(["h1", "h1", "h2"]), 1, self.title()))
        many = self.r.choice([1, 2, 4, 8, 16, 30])
        for _ in range(self.r.randint(1, many)):
            parts.append(self.paragraph(1, self.r.choice([1, 3, 10]), self.r.choice([4, 30, 120, 300])))
            x = self.r.random()
            if x < 0.06:
                parts.append(self.tag(self.r.choice(["h2", "h3"]), 1, self.title()))
            elif x < 0.10:
                parts.append(self.tag(self.r.choice(["ul", "ol"]), 1, "".join(self.tag("li", 1, self.says(2, 25), close=self.r.random() < 0.8) for _ in range(self.r.randint(2, 6)))))
            elif x < 0.12:
                parts.append(self.tag("blockquote", 1, self.paragraph(1)))
            elif x < 0.13:
                parts.append(self.tag("pre", 1, self.says(3, 40)))
            elif x < 0.14:
                rows = "".join(self.tag("tr", 1, "".join(self.tag("td", 1, self.says(1, 4)) for _ in range(3))) for _ in range(self.r.randint(1, 4)))
                parts.append(self.tag("table", 1, rows))
            elif x < 0.22:
                parts.append(self.r.choice([self.ad, self.share, self.notice, self.related, self.form])())
            elif x < 0.26:
                parts.append(self.tag("section", 1, self.tag("h2", 1, self.says(1, 8)) + "".join(self.paragraph(1) for _ in range(self.r.randint(1, 4)))))
        if self.r.random() < 0.2:
            parts.append(self.r.choice([self.share, self.related, self.comments])())
        name, attrs = self.r.choice([("article", ""), ("article", ""), ("article", self.named("post", "story")), ("div", self.named("article", "post", "entry-content", "story-body", "content", "text")), ("section", self.named("article", "post-body")), ("main", "")])
        return self.tag(name, 1, "".join(parts), attrs)

    def page(self) -> str:
        top = [f for f, p in ((self.header, 0.5), (self.nav, 0.7), (self.notice, 0.3), (self.ad, 0.5)) if self.r.random() < p]
        self.r.shuffle(top)
        before = "".join(f() for f in top)
        core = self.content() if self.r.random() < 0.96 else ""
        extra = [f for f, p in ((self.comments, 0.3), (self.related, 0.2), (self.ad, 0.2), (self.share, 0.1), (self.form, 0.15)) if self.r.random() < p]
        inner = core + "".join(f() for f in extra)
        label = 0 if core else 2
        side = self.sidebar() if self.r.random() < 0.3 else ""
        inner = inner + side if self.r.random() < 0.7 else side + inner
        if self.r.random() < 0.4:
            name, attrs = self.r.choice([("main", ""), ("div", self.named("content", "main", "page", "wrapper", "container")), ("div", "")])
            inner = self.tag(name, label, inner, attrs)
        foot = "".join(f() for f, p in ((self.footer, 0.85), (self.notice, 0.1)) if self.r.random() < p)
        body = before + inner + foot
        if self.r.random() < 0.2:
            body = self.tag("div", label, body, self.r.choice(["", self.named("page", "wrapper", "site")]))
        return f'<!DOCTYPE html><html><head><title>{self.says(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body data-label="{label}">{body}</body></html>'
