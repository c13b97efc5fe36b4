"""Annotated pages for training the extractor: invented sites with known main parts.

Every element of the main text carries data-m="1"; the parser reads the mark as the label and hides it from the features.
Words are random letters, so that nothing but structure, tags and attribute words can be learned.
"""

from __future__ import annotations

import random

# Attribute words by the part of a page that they are found on.
MAIN_WORDS = "article post content entry main story body text post-content entry-content article-body page-content main-content richtext prose blog-post hentry markdown".split()
PARTS = {
    "menu": "nav menu navbar navigation main-nav topnav breadcrumb breadcrumbs tabs pagination pager skip-links site-nav dropdown".split(),
    "header": "header masthead top-bar site-header banner logo branding search-bar hero-nav".split(),
    "footer": "footer site-footer bottom copyright legal colophon footer-links imprint".split(),
    "side": "sidebar aside widget related recommended popular trending right-rail secondary tags archive toc rail more-stories read-next".split(),
    "notice": "cookie cookie-banner consent notice alert gdpr popup modal newsletter subscribe paywall announcement toast privacy-notice".split(),
    "advert": "ad ads advert advertisement banner-ad sponsored promo adsbox google-ad ad-slot sponsor promotion affiliate".split(),
    "form": "form search-form login signup contact-form newsletter-form register feedback".split(),
    "comment": "comments comment-list discussion responses reader-comments disqus comment-thread replies comment respond".split(),
    "share": "share social sharing share-buttons follow-us social-links like-button author-bio byline-links meta-links print-link".split(),
}


def annotated(seed: int) -> str:
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("aeioutnrsldchmpgbv") for _ in range(r.randint(2, 9)))

    def words(a: int, b: int) -> str:
        out = [word() for _ in range(r.randint(a, b))]
        return " ".join(w + ("," if r.random() < 0.08 else ". " if r.random() < 0.06 else "") for w in out).strip().capitalize() + ("." if r.random() < 0.8 else "")

    def attr(pool: list[str], chance: float = 0.8) -> str:
        if r.random() > chance:
            return ""
        name = r.choice(("class", "class", "class", "id", "role"))
        value = " ".join(r.sample(pool, min(len(pool), r.choice((1, 1, 1, 2)))))
        if r.random() < 0.3:
            value = value + r.choice(("-1", "-wrapper", "-box", "__inner", "-container", " col-8", " clearfix", "-section"))
        return f' {name}="{value}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a>' + ("</li>" if r.random() < 0.8 else "") for _ in range(n))

    def boiler(kind: str) -> str:
        pool = PARTS[kind]
        if kind == "menu":
            tag = r.choice(("nav", "nav", "div", "ul", "header"))
            inside = f"<ul>{links(r.randint(2, 12))}</ul>" if tag != "ul" else links(r.randint(2, 12))
        elif kind == "header":
            tag, inside = r.choice(("header", "header", "div")), f'<a href="/"><img src="x.png">{words(1, 3)}</a>' + (f"<p>{words(2, 8)}</p>" if r.random() < 0.5 else "")
        elif kind == "footer":
            tag, inside = r.choice(("footer", "footer", "div")), f"&copy; {word()}.example.com &middot; {words(2, 14)}" + (f"<p>{words(3, 20)}</p>" if r.random() < 0.4 else "") + (f"<ul>{links(r.randint(1, 6))}</ul>" if r.random() < 0.5 else "")
        elif kind == "side":
            tag, inside = r.choice(("aside", "aside", "div", "section")), f"<h3>{words(1, 4)}</h3><ul>{links(r.randint(2, 8))}</ul>" if r.random() < 0.7 else f"<h4>{words(1, 4)}</h4><p>{words(5, 40)}</p>"
        elif kind == "notice":
            tag, inside = r.choice(("div", "section", "p")), f"{words(6, 30)} <button>{word()}</button>" if r.random() < 0.6 else f"<p>{words(6, 30)}</p><a href='#'>{word()}</a>"
        elif kind == "advert":
            tag, inside = r.choice(("div", "div", "aside", "p", "section")), r.choice((f"{words(2, 14)}", f'<a href="http://{word()}.example.net">{words(2, 12)}</a>', f"<p>{words(3, 18)}</p>"))
        elif kind == "form":
            tag, inside = r.choice(("form", "form", "div")), f'<label>{word()}</label><input name="{word()}"><select><option>{word()}<option>{word()}</select><button>{words(1, 2)}</button>'
            inside = inside if tag == "form" else f"<form>{inside}</form>"
        elif kind == "comment":
            one = lambda: f"<{c}{attr(pool, 0.5)}><b>{word()}</b> <p>{words(3, 45)}</p></{c}>"
            c = r.choice(("li", "div", "article"))
            tag, inside = r.choice(("section", "div", "ol")), f"<h3>{r.randint(1, 99)} {word()}</h3>" + "".join(one() for _ in range(r.randint(1, 8)))
            return f"<{tag}{attr(pool, 1)}>{inside}</{tag}>"
        else:
            tag, inside = "div", "".join(f'<a href="/{word()}">{word()}</a> ' for _ in range(r.randint(2, 6)))
        known = tag in ("nav", "header", "footer", "aside", "form")
        return f"<{tag}{attr(pool, 0.5 if known else 1)}>{inside}</{tag}>"

    m = ' data-m="1"'

    def block() -> str:
        k = r.random()
        if k < 0.66:
            return f"<p{m}>{words(1, 90)}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.72:
            return f"<p{m}><b>{words(3, 40)}<br><p{m}>{words(4, 60)}</p>"
        if k < 0.80:
            return f"<h{(n := r.randint(2, 4))}{m}>{words(1, 8)}</h{n}>"
        if k < 0.86:
            return f"<{(t := r.choice(('ul', 'ol')))}{m}>" + "".join(f"<li{m}>{words(2, 18)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if k < 0.90:
            return f"<blockquote{m}><p{m}>{words(5, 40)}</p></blockquote>"
        if k < 0.94:
            return f"<table{m}><tr{m}><td{m}>{words(1, 5)}</td><td{m}>{words(1, 5)}</td></tr></table>"
        if k < 0.97:
            return f"<pre{m}>{words(3, 25)}</pre>"
        return f'<figure{m}><img src="y.png"><figcaption{m}>{words(3, 15)}</figcaption></figure>'

    article = [f"<h1{m}>{words(1, 12)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20))):
        article.append(block())
        if r.random() < 0.06:
            article.append(boiler(r.choice(("advert", "share", "side", "notice", "form", "menu"))))
    if r.random() < 0.2:
        article.append(boiler(r.choice(("share", "comment", "side", "form"))))
    body = "".join(article)
    kind = r.random()
    if kind < 0.45:
        body = f"<article{m}{attr(MAIN_WORDS, 0.4)}>{body}</article>"
    elif kind < 0.65:
        body = f"<main{m}{attr(MAIN_WORDS, 0.4)}>{body}</main>"
    elif kind < 0.95:
        body = f"<{(t := r.choice(('div', 'div', 'section')))}{m}{attr(MAIN_WORDS, 1)}>{body}</{t}>"
    if r.random() < 0.4:
        body = f"<{(t := r.choice(('main', 'div', 'section')))}{m}{attr(MAIN_WORDS, 0.5)}>{body}</{t}>"
    before = [boiler(k) for k in ("notice", "header", "menu", "advert", "form", "menu") if r.random() < 0.4]
    after = [boiler(k) for k in ("share", "comment", "side", "advert", "form", "notice", "menu") if r.random() < 0.35]
    inside = "".join(before) + body + "".join(after)
    if r.random() < 0.3:
        inside = f'<div{m} class="{r.choice(("container", "wrapper", "page", "layout", "row", "site"))}">{inside}</div>'
    foot = boiler("footer") if r.random() < 0.8 else ""
    head = f"<head><meta charset='utf-8'><title>{words(2, 9)}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.9 else ""
    return f"<!DOCTYPE html><html{m}>{head}<body{m}>{inside}{foot}" + ("</body></html>" if r.random() < 0.85 else "")
