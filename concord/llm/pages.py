"""Labelled pages from which the extraction model learns.

Pages are composed at random from the parts that web pages have. Whoever adds a part says whether it is main text, so
every node has a label. Words are invented: the model can only learn from structure and names, in any language.
"""

from __future__ import annotations

import random

from concord.llm.html import Node, parse

# Names that sites commonly give to the parts of a page.
NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager toc skip links tabs",
    "header": "header masthead site-header page-header topbar top-bar logo branding banner",
    "footer": "footer site-footer page-footer colophon copyright legal bottom credits",
    "aside": "sidebar side-bar aside widget rail right-column secondary related recommended trending popular more-stories",
    "notice": "notice cookie cookies cookie-banner cookie-notice consent gdpr alert popup modal overlay message warning paywall announcement privacy disclaimer",
    "ad": "ad ads advert adverts advertisement advertising ad-slot sponsored sponsor promo promotion banner-ad teaser-ad dfp outbrain taboola",
    "form": "form search search-form newsletter subscribe signup sign-up login contact-form register poll survey",
    "comments": "comments comment comment-list commentlist discussion replies responses reader-comments user-comments disqus reviews respond feedback thread",
    "share": "share social sharing share-buttons social-links toolbar tools tags tag-list print",
}
GOOD = "content article post entry main body story text main-content article-body entry-content post-content article-content page-content story-body prose".split()
PLAIN = "container wrapper row col inner block box layout wrap section group outer page site grid".split()


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            if r.random() < 0.12:
                out[i] += r.choice(".,.,!?")
        return " ".join(out).capitalize()

    def named(self, tag: str, names: list[str], chance: float = 0.85) -> str:
        r = self.rng
        if r.random() > chance:
            return tag
        name = r.choice(names)
        if r.random() < 0.2:
            name = f"{r.choice(['site', 'js', 'c', 'm', 'block', 'page', 'x'])}-{name}"
        if r.random() < 0.15:
            name = f"{name} {r.choice(PLAIN)}"
        return f'{tag} {r.choice(["class", "class", "class", "id"])}="{name}"'

    def el(self, opening: str, inner: str, label: int) -> str:
        """An element whose node carries its label in an attribute that is not a feature."""
        return f'<{opening} data-y="{label}">{inner}</{opening.split()[0]}>'

    def inline(self, text: str) -> str:
        r = self.rng
        parts = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(parts))
            t = r.choice(["a href='/x'", "b", "em", "span", "strong", "code"])
            parts[i] = f"<{t}>{parts[i]}</{t.split()[0]}>"
        return " ".join(parts)

    def junk(self, kind: str) -> str:
        r, names = self.rng, NAMES[kind].split()
        links = lambda a, b: "".join(self.el("li", f'<a href="/{i}">{self.words(1, 3)}</a>', 0) for i in range(r.randint(a, b)))
        para = lambda a, b: self.el(r.choice(["p", "div", "p"]), self.inline(self.words(a, b)), 0)
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            inner = links(2, 9) if tag == "ul" else self.el("ul", links(2, 9), 0)
            return self.el(self.named(tag, names, 0.5 if tag == "nav" else 1), inner, 0)
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            inner = r.choice([self.el(r.choice(["h1", "div", "p"]), self.words(1, 6), 0), f"<a href='/'>{self.words(1, 3)}</a>", self.words(2, 8)])
            return self.el(self.named(tag, names, 0.4 if tag == "header" else 1), inner + (self.junk("nav") if r.random() < 0.5 else ""), 0)
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            inner = r.choice(["&copy; " + self.words(2, 40), para(3, 40), self.el("ul", links(2, 6), 0) + para(2, 20)])
            return self.el(self.named(tag, names, 0.4 if tag == "footer" else 1), inner, 0)
        if kind == "aside":
            tag = r.choice(["aside", "aside", "div", "section"])
            inner = self.el(r.choice(["h2", "h3", "div"]), self.words(1, 4), 0) * r.randint(0, 1) + r.choice([self.el("ul", links(2, 8), 0), para(4, 60), para(4, 40) + para(4, 40), self.words(3, 30)])
            return self.el(self.named(tag, names, 0.5 if tag == "aside" else 1), inner, 0)
        if kind == "comments":
            one = lambda: self.el(self.named(r.choice(["div", "li", "article"]), names, 1), r.choice([para(3, 60), self.el("p", self.words(1, 3), 0) + para(3, 60), self.words(3, 40)]), 0)
            inner = self.el(r.choice(["h2", "h3"]), self.words(1, 3), 0) * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 5)))
            return self.el(self.named(r.choice(["section", "div", "ol", "aside"]), names, 1), inner, 0)
        if kind == "form":
            inner = r.choice([para(2, 20), self.el("label", self.words(1, 3), 0), self.words(2, 15)]) + "<input type=text><button>" + self.words(1, 2) + "</button>"
            form = self.el(self.named("form", names, 0.5), inner, 0)
            return self.el(self.named("div", names, 1), r.choice(["", para(3, 20)]) + form, 0) if r.random() < 0.4 else form
        tag = r.choice(["div", "div", "section", "aside", "p", "p", "ul" if kind == "share" else "div"])
        inner = links(2, 5) if tag == "ul" else self.words(1, 40) if tag == "p" else r.choice([self.words(1, 40), para(2, 40), para(3, 30) + para(2, 20), f"<a href='/go'>{self.words(2, 12)}</a>"])
        opening = self.named(tag, names, 1)
        if kind == "notice" and r.random() < 0.2:
            opening = f'{tag} role="{r.choice(["alert", "dialog", "alertdialog", "status"])}"'
        return self.el(opening, inner, 0)

    def story(self) -> str:
        r = self.rng
        parts = []
        if r.random() < 0.8:
            title = self.el("h1", self.words(2, 12), 1)
            parts.append(self.el("header", title, 1) if r.random() < 0.15 else title)
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            k = r.random()
            if k < 0.72:
                parts.append(self.el("p", self.inline(self.words(*r.choice([(1, 4), (5, 40), (20, 120), (20, 120)]))), 1))
            elif k < 0.8:
                parts.append(self.el(r.choice(["h2", "h3"]), self.words(1, 8), 1))
            elif k < 0.86:
                parts.append(self.el(r.choice(["ul", "ol"]), "".join(self.el("li", self.inline(self.words(2, 20)), 1) for _ in range(r.randint(1, 5))), 1))
            elif k < 0.9:
                parts.append(self.el("blockquote", self.el("p", self.words(5, 40), 1) if r.random() < 0.5 else self.words(5, 40), 1))
            elif k < 0.93:
                parts.append(self.el("pre", self.words(3, 30), 1))
            elif k < 0.96:
                parts.append(self.el("figure", "<img src=x>" + self.el("figcaption", self.words(3, 15), 1), 1))
            elif k < 0.98:
                rows = "".join(self.el("tr", "".join(self.el("td", self.words(1, 4), 1) for _ in range(3)), 1) for _ in range(r.randint(1, 4)))
                parts.append(self.el("table", rows, 1))
            else:
                parts.append(self.el(self.named("div", PLAIN, 0.5), self.el("p", self.words(5, 60), 1), 1))
        for kind in r.choices(["ad", "share", "aside", "form", "comments", "notice", "nav", "footer"], k=r.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(r.randint(1, len(parts)), self.junk(kind))
        return "".join(parts)

    def page(self) -> str:
        r = self.rng
        story = self.story()
        shape = r.random()
        if shape < 0.5:
            story = self.el(self.named("article", GOOD, 0.3), story, 1)
        elif shape < 0.65:
            story = self.el(self.named("main", GOOD, 0.3), story, 1)
        elif shape < 0.9:
            story = self.el(self.named("div", GOOD, 0.9), story, 1)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            aside = "".join(self.junk(k) for k in r.choices(["aside", "comments", "ad", "nav", "share"], k=r.choice([0, 0, 1])))
            tag = r.choice(["main", "div", "div", "section"])
            story = self.el(self.named(tag, PLAIN + GOOD, 0.7), r.choice([story + aside, aside + story]), 1)
        first = "".join(self.junk(k) for k in r.sample(["nav", "header", "notice", "ad", "form", "share"], r.choice([0, 1, 2, 3, 4])))
        last = "".join(self.junk(k) for k in r.sample(["comments", "aside", "footer", "ad", "form", "notice", "share", "nav"], r.choice([0, 1, 2, 3, 4])))
        head = f"<head><title>{self.words(1, 6)}</title><style>p{{}}</style><script>var x='</p>'</script></head>" if r.random() < 0.7 else ""
        return f'<!DOCTYPE html><html>{head}<body data-y="1">{first}{story}{last}</body></html>'


def labels(nodes: list[Node]) -> list[int]:
    """The labels that a composed page's nodes carry; those without one are like their parents."""
    out = [1]
    for n in nodes[1:]:
        at = n.attributes.find('data-y="')
        out.append(int(n.attributes[at + 8]) if at >= 0 else out[n.parent])
    return out


def labelled_pages(n: int = 900, seed: int = 3) -> list[tuple[list[Node], list[int]]]:
    found = []
    for i in range(n):
        nodes, _ = parse(Maker(seed * 1_000_003 + i).page())
        found.append((nodes, labels(nodes)))
    return found
