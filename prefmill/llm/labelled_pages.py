"""Labelled pages to train the extraction from: generated layouts whose elements say whether they are content.

Words are made up; what varies by rule is the layout, the tags, the names of classes and the length of texts.
"""

from __future__ import annotations

from random import Random

_SYLLABLES = "ba co di fer ga lin mo na per qui ro sta tu vel wen zo ark est ion ul".split()
_ARTICLE = ("article", "post", "entry-content", "story-body", "article-text", "main-content", "content", "post-body", "text", "page-content", "blog-post", "body-copy")
_MENU = ("nav", "menu", "main-menu", "navbar", "navigation", "topnav", "breadcrumbs", "breadcrumb", "pagination", "pager", "toc-links", "site-nav", "skip-links")
_HEADER = ("header", "site-header", "masthead", "top-bar", "banner", "branding", "logo-row", "page-top")
_FOOTER = ("footer", "site-footer", "bottom", "copyright", "colophon", "legal", "foot-links")
_SIDE = ("sidebar", "side-column", "widget", "related", "related-posts", "recommended", "popular", "trending", "most-read", "author-box", "tags", "categories", "right-rail", "secondary", "teaser-list", "see-also", "more-stories")
_NOTICE = ("cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "notice", "popup", "modal", "overlay", "paywall", "announcement", "disclaimer", "notification", "message-bar", "privacy-notice")
_ADVERT = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsbox", "banner-ad", "sponsor", "partner-offer", "ad-slot", "commercial")
_FORM = ("newsletter", "subscribe", "signup", "search", "search-form", "login", "contact-form", "poll", "feedback")
_COMMENT = ("comments", "comment-list", "comment", "discussion", "responses", "replies", "disqus_thread", "user-comments", "reader-comments", "reviews")
_SHARE = ("share", "social", "share-buttons", "social-links", "follow-us", "toolbar", "print-tools")

#: Words of the names above that may be part of a longer one.
STEMS = tuple(
    sorted({w.removesuffix("s") for names in (_MENU, _HEADER, _FOOTER, _SIDE, _NOTICE, _ADVERT, _FORM, _COMMENT, _SHARE) for name in names for w in name.replace("_", "-").split("-") if len(w) > 4})
)


class _Writer:
    def __init__(self, seed: int):
        self.r = Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 2, 2, 3, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 18) + self.r.choice(("...", "?", "!", ".", ".", ".", ".")).replace("...", ".") for _ in range(self.r.randint(low, high)))

    def links(self, low: int, high: int, tag: str = "li") -> str:
        one = lambda: f'<a href="/{self.word()}">{self.words(1, self.r.choice((2, 3, 8)))}</a>'
        n = self.r.randint(low, high)
        if self.r.random() < 0.3:
            return self.r.choice((" | ", " &middot; ", " ")).join(one() for _ in range(n))
        return "<ul>" + "".join(f"<{tag}>{one()}</{tag}>" for _ in range(n)) + "</ul>"

    def named(self, tags: tuple[str, ...], names: tuple[str, ...], y: int, inner: str, bare: float = 0.0, role: str = "") -> str:
        tag = self.r.choice(tags)
        if tag == "p" and any(x in inner for x in ("<ul", "<p", "<h4")):
            tag = "div"  # a paragraph ends where a block begins
        name = self.r.choice(names)
        if tag not in ("div", "section", "p", "ul", "span", "ins") and self.r.random() < 0.5:
            key = ""
        elif self.r.random() < bare:
            key = ""
        else:
            key = f' {self.r.choice(("class", "class", "id"))}="{name}{self.r.choice(("", "", "-1", " wide", " clearfix"))}"'
        if role and self.r.random() < 0.3:
            key += f' role="{role}"'
        return f'<{tag}{key} data-y="{y}">{inner}</{tag}>'

    # what is not content
    def menu(self) -> str:
        return self.named(("nav", "nav", "div", "ul"), _MENU, 0, self.links(3, 9), role="navigation")

    def header(self) -> str:
        inner = self.r.choice((f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(3, 9)}</p>", self.sentences(1, 2), f"<div>{self.words(1, 4)}</div><p>{self.sentences(1, 1)}</p>"))
        return self.named(("header", "header", "div"), _HEADER, 0, inner + (self.menu() if self.r.random() < 0.4 else ""), role="banner")

    def footer(self) -> str:
        inner = self.r.choice(("&copy; ", "© 2020 ", "Copyright ", "")) + self.r.choice((self.words(2, 8), self.sentences(1, 3), self.links(2, 6), f"<p>{self.sentences(1, 2)}</p>", f"<div>{self.links(2, 5)}</div><p>{self.words(3, 9)}</p>"))
        return self.named(("footer", "footer", "div"), _FOOTER, 0, inner, role="contentinfo")

    def side(self) -> str:
        parts = [f"<h3>{self.words(1, 4)}</h3>", self.r.choice((self.links(2, 7), f"<p>{self.sentences(1, 4)}</p>", f"<div>{self.sentences(1, 3)}</div>", self.links(2, 5) + f"<p>{self.sentences(1, 2)}</p>"))]
        return self.named(("aside", "aside", "div", "section"), _SIDE, 0, "".join(parts[self.r.randint(0, 1) :]), role="complementary")

    def notice(self) -> str:
        inner = self.sentences(1, 4) + self.r.choice(("", f' <a href="/ok">{self.words(1, 2)}</a>', f"<button>{self.words(1, 2)}</button>"))
        return self.named(("div", "div", "section", "aside", "dialog"), _NOTICE, 0, self.r.choice((inner, f"<p>{inner}</p>")), role="alert")

    def advert(self) -> str:
        inner = self.r.choice((self.sentences(1, 3), f'<a href="/buy">{self.sentences(1, 2)}</a>', f"<p>{self.sentences(1, 2)}</p>", f"<h4>{self.words(2, 6)}</h4><p>{self.sentences(1, 2)}</p>", self.words(1, 6)))
        return self.named(("div", "div", "div", "aside", "section", "p", "span", "ins"), _ADVERT, 0, inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name='q'><p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>"
        whole = self.named(("form", "form"), _FORM, 0, inner, role="search")
        return whole if self.r.random() < 0.6 else self.named(("div", "section"), _FORM, 0, f"<h4>{self.words(2, 5)}</h4>" + whole)

    def comments(self) -> str:
        def one() -> str:
            by = self.r.choice((f"<cite>{self.words(1, 2)}</cite>", f'<span class="author">{self.words(1, 2)}</span>', f"<b>{self.words(1, 2)}</b>", ""))
            said = self.r.choice((f"<p>{self.sentences(1, 5)}</p>", self.sentences(1, 4)))
            tag = self.r.choice(("div", "li", "article", "section"))
            name = self.r.choice((" class=comment", " class=reply", "" if tag != "article" else " class=comment", " class=comment-body"))
            return f"<{tag}{name}>{by}{said}</{tag}>"

        inner = self.r.choice((f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.r.randint(1, 50)} {self.words(1, 1)}</h2>", "")) + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.named(("section", "div", "div", "ol", "aside"), _COMMENT, 0, inner)

    def share(self) -> str:
        return self.named(("div", "ul", "p"), _SHARE, 0, self.links(2, 5))

    def hidden(self) -> str:
        tag, how = self.r.choice(("div", "section", "p")), self.r.choice(("hidden", 'style="display: none"', 'style="color:red;display:none"', 'hidden=""'))
        inner = self.sentences(1, 4)
        return f'<{tag} {how} data-y="0">{inner if tag == "p" else f"<p>{inner}</p>"}</{tag}>'

    # content
    def paragraph(self) -> str:
        inner = self.sentences(1, self.r.choice((1, 3, 6, 9)))
        if self.r.random() < 0.2:
            inner = f"<b>{self.words(1, 6)}</b> " + inner
        if self.r.random() < 0.25:
            inner += f' <a href="/x">{self.words(1, 4)}</a> ' + self.words(2, 9) + "."
        if self.r.random() < 0.15:
            inner += "<br>" + self.sentences(1, 2)
        if self.r.random() < 0.12:
            inner = self.words(2, 8)
        tag = self.r.choice(("p", "p", "p", "p", "p", "div"))
        return f"<{tag}>{inner}" + ("" if tag == "p" and self.r.random() < 0.1 else f"</{tag}>")

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.7:
            return self.paragraph()
        if kind < 0.8:
            return f"<h{(k := self.r.choice((2, 3, 4)))}>{self.words(2, 7)}</h{k}>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{self.r.choice((self.words(2, 9), self.sentences(1, 2)))}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{self.r.choice((self.sentences(1, 2), f'<p>{self.sentences(1, 2)}</p>'))}</blockquote>"
        if kind < 0.94:
            return f"<pre><code>{self.words(3, 12)}</code></pre>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        return f'<figure><img src="x.png"><figcaption>{self.sentences(1, 1)}</figcaption></figure>'

    def article(self) -> str:
        inner = f"<h1>{self.words(2, 9)}</h1>" if self.r.random() < 0.8 else ""
        if inner and self.r.random() < 0.15:
            inner = f"<header>{inner}</header>"
        for _ in range(self.r.choice((1, 2, 4, 6, 9, 14))):
            inner += self.block()
            if self.r.random() < 0.12:
                inner += self.r.choice((self.advert, self.share, self.side, self.form, self.notice, self.hidden))()
        if self.r.random() < 0.25:
            inner += self.r.choice((self.share, self.comments, self.side, self.advert, self.footer))()
        whole = self.named(("article", "article", "div", "main", "section"), _ARTICLE, 1, inner, bare=0.3)
        for _ in range(self.r.randint(0, 2)):
            whole = self.named(("div", "main", "section"), ("content", "wrapper", "container", "main", "column", "inner", "page"), 1, whole, bare=0.5, role="main")
        return whole

    def page(self) -> str:
        top = [f() for f in (self.header, self.menu, self.notice, self.advert, self.form, self.menu, self.share) if self.r.random() < 0.45]
        bottom = [f() for f in (self.comments, self.side, self.side, self.advert, self.share, self.form, self.footer, self.notice, self.hidden) if self.r.random() < 0.45]
        inner = "".join(top) + self.article() + "".join(bottom)
        if self.r.random() < 0.4:
            inner = f'<div class="{self.r.choice(("container", "wrapper", "page", "site", "layout", "row"))}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body data-y=\"0\">{inner}</body></html>"


def labelled_pages(n: int = 900, seed: int = 5) -> list[str]:
    """The training pages, the same on every call."""
    return [_Writer(seed * 100_003 + i).page() for i in range(n)]
