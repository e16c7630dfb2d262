"""Labelled pages to learn extraction weights from: made pages whose every region is known to be article or not.

Regions are put together from the ways in which sites commonly mark them. Texts are random words, so nothing about the wording can be
learnt, only markup. A training page is a list of (html, is_article) pieces in page order; the joined pieces are the page.
"""

from __future__ import annotations

import random

# Common class and id words of regions that are not the article.
OTHER_NAMES = {
    "menu": "nav navbar navigation menu topnav mainmenu submenu breadcrumb breadcrumbs pagination pager toc tabs skip links",
    "header": "header masthead topbar branding logo site siteheader pageheader hero toolbar",
    "footer": "footer siteinfo copyright colophon bottom legal credits imprint",
    "sidebar": "sidebar aside widget rail secondary related recommended trending popular more tags archive recent",
    "notice": "notice cookie cookies consent gdpr banner alert modal popup overlay paywall subscribe message warning disclaimer",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp adslot",
    "form": "form login signup newsletter search searchbox register contact survey",
    "comments": "comment comments discussion disqus replies reply respond feedback thread commentlist reactions",
    "share": "share social sharing follow buttons",
}
# Common class and id words of the article.
ARTICLE_NAMES = "article content post entry main story body text articlebody postcontent entrycontent maincontent page single".split()
TAGS = {
    "menu": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
    "notice": ["div", "section", "aside", "dialog"], "advert": ["div", "aside", "section", "ins"], "form": ["form", "div", "section"],
    "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "section"],
}
INSIDE = ["advert", "sidebar", "share", "notice", "form"]


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choices("abcdefgilmnoprstu", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))


def _filler(rng: random.Random, kind: str) -> str:
    if kind in ("menu", "share"):
        return "<ul>" + "".join(f'<li><a href="/x">{_words(rng, 1, 3)}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"
    if kind == "comments":
        made = [f"<p>{_words(rng, 5, 60)}</p>" for _ in range(rng.randint(1, 6))]
        wrap = rng.choice(["<article>{}</article>", '<div class="comment">{}</div>', "<li>{}</li>"])
        return f"<h3>{_words(rng, 1, 3)}</h3>" + "".join(wrap.format(m) for m in made)
    if kind == "form":
        return f'<label>{_words(rng, 1, 4)}</label><input name="q"><button>{_words(rng, 1, 2)}</button><p>{_words(rng, 3, 20)}</p>'
    if kind == "sidebar":
        return f"<h3>{_words(rng, 1, 4)}</h3>" + rng.choice([f"<p>{_words(rng, 8, 50)}</p>", _filler(rng, "menu")])
    if kind == "footer":
        return rng.choice([f"&copy; {_words(rng, 2, 12)}", f"<p>{_words(rng, 4, 30)}</p>", _filler(rng, "menu")])
    return rng.choice([_words(rng, 3, 25), f"<p>{_words(rng, 5, 40)}</p>", f'<a href="/y">{_words(rng, 2, 8)}</a>'])


def _other(rng: random.Random, kind: str) -> str:
    tag = rng.choice(TAGS[kind])
    plain = {"nav": 0.5, "header": 0.5, "footer": 0.5, "aside": 0.5, "form": 0.5}.get(tag, 0.0)
    name = "" if rng.random() < plain else f' {rng.choice(["class", "id"])}="{rng.choice(OTHER_NAMES[kind].split())}"'
    return f"<{tag}{name}>{_filler(rng, kind)}</{tag}>"


def _article(rng: random.Random) -> list[tuple[str, bool]]:
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    name = f' {rng.choice(["class", "id"])}="{rng.choice(ARTICLE_NAMES)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    pieces = [(f"<{tag}{name}>", True), (rng.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>", "{}"]).format(_words(rng, 2, 10)), True)]
    for _ in range(rng.randint(1, 9)):
        shape = rng.random()
        text = _words(rng, 1, 90)
        if shape < 0.7:
            pieces.append((rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p>{}<br></p>"]).format(text), True))
        elif shape < 0.8:
            pieces.append(("<ul>" + "".join(f"<li>{_words(rng, 3, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", True))
        elif shape < 0.9:
            pieces.append((rng.choice(["<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", '<p>{} <a href="/z">link</a></p>']).format(text), True))
        else:
            pieces.append((rng.choice(["<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>"]).format(text), True))
        if rng.random() < 0.15:
            pieces.append((_other(rng, rng.choice(INSIDE)), False))
    return [*pieces, (f"</{tag}>", True)]


def labelled_pages(count: int = 600, seed: int = 11) -> list[list[tuple[str, bool]]]:
    rng = random.Random(seed)
    pages = []
    for _ in range(count):
        before = [k for k in ("header", "menu", "notice", "advert", "share", "form") if rng.random() < 0.5]
        after = [k for k in ("sidebar", "share", "comments", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        page = [("<html><head><title>t</title></head><body>", False), *((_other(rng, k), False) for k in before)]
        wrap = rng.choice(["", "", '<div class="wrapper">', '<div id="container">'])
        page += [(wrap, False), *_article(rng), *((_other(rng, k), False) for k in after), ("</div>" if wrap else "", False)]
        pages.append([*page, ("</body></html>", False)])
    return pages
