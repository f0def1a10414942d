"""Pages whose parts are known, to train the main-text model on.

Every page comes from a made-up site, which has a way of marking up (semantic elements, divs only, table layout, bare text),
a way of naming (usual words, usual words with affixes, opaque tokens, no names) and an order of parts. Elements say in
data-gold whether they are main text ("in") or not ("out")."""

from __future__ import annotations

import random

#: Names that sites use for their parts; they only occur in pages made here, the model hashes whatever names it meets.
NAMES = {
    "main": "article main content post entry story body text prose chapter".split(),
    "menu": "nav navbar navigation menu breadcrumb tabs toc pagination pager sitemap".split(),
    "advert": "ad ads advert advertisement banner sponsor sponsored promo adsense".split(),
    "comment": "comment comments reply replies respond discussion thread feedback".split(),
    "foot": "footer foot copyright legal colophon credits".split(),
    "head": "header masthead topbar logo branding hero".split(),
    "aside": "aside sidebar related recommended widget rail trending teaser".split(),
    "notice": "notice cookie consent gdpr popup modal alert newsletter subscribe".split(),
    "form": "form login search register signin contact".split(),
    "share": "share social sharing follow byline print".split(),
}
_ELEMENTS = {"main": "article", "menu": "nav", "foot": "footer", "head": "header", "aside": "aside", "form": "form"}
_SYLLABLES = "ka lo mi ter on sa re vi du pol an ek tur ish ne ba ço hé ül gra".split()


class Site:
    """One made-up site: how it names and marks up its parts."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.naming = rng.choices(("usual", "affixed", "opaque", "none"), (4, 2, 4, 1))[0]
        self.markup = rng.choices(("semantic", "mixed", "divs", "table"), (4, 3, 4, 1))[0]
        self.paragraphs = rng.choices(("p", "div", "br", "open"), (6, 2, 1, 1))[0]
        self.opaque = {k: self.token() for k in NAMES}
        self.prefix = rng.choice(("site-", "js-", "c-", "page_", ""))
        self.suffix = rng.choice(("-wrap", "_1", "-box", " clearfix", "Block", ""))

    @property
    def clear(self) -> bool:
        """Whether names or elements tell parts apart, whatever their texts."""
        return self.naming in ("usual", "affixed") or self.markup == "semantic"

    def token(self) -> str:
        return "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=self.rng.randint(2, 7)))

    def words(self, n: int) -> str:
        rng, out, size = self.rng, [], 0
        for _ in range(n):
            w = "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
            size += 1
            out.append(w.title() if size == 1 else w)
            if size > rng.randint(4, 18):
                out[-1] += rng.choice(".....!?")
                size = 0
            elif rng.random() < 0.08:
                out[-1] += ","
        return " ".join(out) + rng.choice(("", ".", "."))

    def attrs(self, topic: str, gold: str = "") -> str:
        mark = f' data-gold="{gold}"' if gold else ""
        if self.naming == "none":
            return mark
        if self.naming == "opaque":
            word = self.opaque[topic] if self.rng.random() < 0.9 else self.token()
        else:
            word = self.rng.choice(NAMES[topic])
            if self.naming == "affixed":
                word = f"{self.prefix}{word}{self.suffix}"
        return f' {self.rng.choice(("class", "class", "id"))}="{word.title() if self.rng.random() < 0.05 else word}"{mark}'

    def block(self, topic: str, inner: str, gold: str = "") -> str:
        usual = _ELEMENTS.get(topic)
        known = usual and (self.markup == "semantic" or self.markup == "mixed" and self.rng.random() < 0.5)
        tag = usual if known else self.rng.choice(("div", "div", "section")) if self.markup != "divs" else "div"
        bare = known and self.rng.random() < 0.5
        return f"<{tag}{f' data-gold={chr(34)}{gold}{chr(34)}' if bare and gold else '' if bare else self.attrs(topic, gold)}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        rng = self.rng
        items = [f'<a href="/{k}">{self.words(rng.randint(1, 5))}</a>' for k in range(n)]
        style = rng.randrange(4)
        if style < 2:
            return "<ul>" + "".join(f"<li>{x}{rng.choice(('</li>', ''))}" for x in items) + "</ul>"
        return rng.choice((" | ", " ", " &middot; ")).join(items) if style == 2 else "".join(f"<div>{x}</div>" for x in items)

    def noise(self, topic: str) -> str:
        """A part that isn't main text."""
        rng, words = self.rng, self.words
        if topic == "menu":
            inner = self.links(rng.randint(3, 14))
        elif topic == "advert":
            inner = rng.choice((words(rng.randint(3, 25)), f"<p>{words(rng.randint(3, 25))}</p>", f'<a href="/ad">{words(rng.randint(2, 12))}</a><img src="x">'))
        elif topic == "comment":
            one = rng.choice(("<p>{}</p>", "<b>{n}</b> <span>{d}</span><p>{}</p>", "<div>{n}</div><div>{}</div>"))
            inner = "".join(f'<div{self.attrs("comment")}>{one.format(words(rng.randint(4, 60)), n=words(1), d=rng.randint(1, 30))}</div>' for _ in range(rng.randint(1, 8)))
            inner = rng.choice(("", f"<h3>{words(2)}</h3>")) + inner
        elif topic == "foot":
            inner = rng.choice(("&copy; ", "&copy; ", "", "<p>")) + words(rng.randint(3, 30)) + (self.links(rng.randint(2, 8)) if rng.random() < 0.5 else "")
        elif topic == "head":
            inner = rng.choice((f"<h1>{words(3)}</h1>", f'<a href="/">{words(2)}</a>', f"<h2>{words(2)}</h2><p>{words(rng.randint(3, 12))}</p>")) + (self.links(4) if rng.random() < 0.4 else "")
        elif topic == "aside":
            inner = f"<h3>{words(2)}</h3>" + rng.choice((self.links(rng.randint(2, 8)), "".join(f'<p>{words(rng.randint(5, 25))} <a href="/m">{words(2)}</a></p>' for _ in range(rng.randint(1, 4)))))
        elif topic == "notice":
            inner = rng.choice((f"<p>{words(rng.randint(5, 40))}</p><button>{words(1)}</button>", f'{words(rng.randint(5, 30))} <a href="/ok">{words(1)}</a>'))
        elif topic == "form":
            inner = f"<label>{words(2)}</label><input name=q><input type=submit>" + (f"<p>{words(rng.randint(2, 15))}</p>" if rng.random() < 0.5 else "")
            inner = inner if self.markup == "semantic" else f"<form>{inner}</form>"
        else:
            inner = self.links(rng.randint(2, 5))
        return self.block(topic, inner, "out")

    def article(self) -> str:
        rng, words = self.rng, self.words
        parts = [rng.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<h1>{}</h1>", "")).format(words(rng.randint(2, 14)))]
        count, sizes = (rng.choice((1, 1, 2, 3, 5, 8, 12, 20)), (1, 1, 2, 3, 8, 30, 60, 120, 250)) if self.clear else (rng.choice((2, 3, 5, 8, 12, 20)), (25, 40, 60, 90, 120, 250))
        for _ in range(count):
            body = words(rng.choice(sizes))
            if rng.random() < 0.15:
                body = body.replace(" ", f' <a href="/l">{words(2)}</a> ', 1)
            if rng.random() < 0.15:
                body = f"<b>{body}" + rng.choice(("</b>", "</b><br>"))
            parts.append({"p": f"<p>{body}</p>", "open": f"<p>{body}", "div": f"<div>{body}</div>", "br": f"{body}<br><br>"}[self.paragraphs])
            kind = rng.random()
            if kind < 0.06:
                parts.append(f"<h3>{words(rng.randint(1, 6))}</h3>")
            elif kind < 0.1:
                parts.append("<ul>" + "".join(f"<li>{words(rng.randint(4, 20))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.13:
                parts.append(f"<blockquote><p>{words(rng.randint(5, 40))}</p></blockquote>")
            elif kind < 0.15:
                parts.append("<table>" + "".join(f"<tr><td>{words(1)}</td><td>{words(4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.24 and self.naming in ("usual", "affixed"):
                parts.append(self.noise(rng.choice(("advert", "advert", "share", "aside", "notice", "form", "comment", "menu"))))
            elif kind < 0.2:
                parts.append(self.noise(rng.choice(("share", "menu", "form"))))
        return "".join(parts)

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.05:  # no parts at all
            body = "".join(rng.choice((f"<p>{self.words(rng.randint(8, 80))}</p>", f"{self.words(rng.randint(8, 80))}\n\n")) for _ in range(rng.randint(1, 6)))
            return f'<body data-gold="in">{body}' if rng.random() < 0.7 else f'<html><head><title>{self.words(3)}</title></head><body data-gold="in">{body}</body></html>'
        body = self.block("main", self.article(), "in") if rng.random() < 0.96 else ""
        if rng.random() < 0.4:
            inner = [body, self.noise("comment") if rng.random() < 0.5 else ""]
            body = f"<div{self.attrs('main') if rng.random() < 0.5 and self.naming != 'opaque' else ''}>{''.join(inner)}</div>"
        before = [self.noise(x) for x in rng.sample(("head", "menu", "advert", "notice", "form"), rng.randint(0, 4))]
        after = [self.noise(x) for x in rng.sample(("comment", "aside", "foot", "share", "advert", "form", "menu"), rng.randint(0, 5))]
        if self.markup == "table":
            side = "".join(self.noise(x) for x in rng.sample(("menu", "aside", "advert"), rng.randint(0, 2)))
            body = f"<table><tr><td>{side}</td><td>{body}</td></tr></table>"
        inner = "".join([*before, body, *after])
        if rng.random() < 0.3:
            inner = f"<div id={self.token()}>{inner}</div>"
        return f"<html><head><title>{self.words(4)}</title></head><body>{inner}{rng.choice(('</body></html>', ''))}"


def made_page(rng: random.Random) -> str:
    return Site(rng).page()
