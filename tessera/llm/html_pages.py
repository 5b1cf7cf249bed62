"""Labelled pages for training the page model, made from rules: every text run is marked as content or not.

Content runs are wrapped in U+E000 .. U+E001 (private characters that no real page needs), so the labels survive
any parser. The generator varies containers, class names, order, lengths, missing end tags and boilerplate; odd pages
have names that mislead, lists of links that are content, and menus without a name.
"""

from __future__ import annotations

import random

OPEN, CLOSE = "", ""

# Containers of articles and of everything else that pages carry.
ARTICLES = ["<article>", '<main>', '<article class="post">', '<div class="article-body">', '<div id="content">', '<div class="post-content">', '<div class="entry">', '<main id="main"><article>', '<div class="story">', '<section class="article">', '<div>', '<div role="main">', "<td>"]
AROUND = {
    "nav": ["<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<div class="breadcrumbs">', '<div role="navigation">', '<nav class="main-nav">'],
    "header": ["<header>", '<div class="header">', '<div id="masthead">', '<div class="top-bar">', '<div role="banner">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="site-info copyright">', '<div role="contentinfo">'],
    "aside": ["<aside>", '<div class="sidebar">', '<div class="related-posts">', '<div class="widget">', '<aside class="recommended">', '<div role="complementary">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advertisement">', '<div id="sponsored">', '<div class="promo">', '<div class="banner-ad">', '<aside class="ad">'],
    "notice": ['<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="consent">', '<div class="notice">', '<div role="alert">', '<div class="popup">', '<div class="newsletter">', '<div class="paywall">'],
    "form": ["<form>", '<form class="search">', '<div class="login-form"><form>', '<form id="subscribe">'],
    "comments": ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">', '<section class="reader-comments">', '<div id="disqus_thread">', '<ul class="replies">'],
    "share": ['<div class="share">', '<div class="social">', '<ul class="share-buttons">', '<div class="tags">'],
}
# Names that content carries now and then though they are words of boilerplate.
MISLEADING = ["more", "widget", "side", "share", "tags", "notice", "warning", "alert", "top", "header", "site", "form", "contact", "menu", "copyright", "dialog"]


def _vocabulary(n: int, letters: list[str], low: int, high: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(map(rng.choice, letters[: rng.randint(low, high)])) for _ in range(n)]


_SPOKEN = _vocabulary(3000, ["bcdfgklmnprst", "aeiou"] * 5, 1, 9)
_LABELS = _vocabulary(2000, ["aeioubcdfglmnrst"] * 8, 2, 8)


def _end(opening: str) -> str:
    names = [x.split()[0].strip("<>") for x in opening.split("<")[1:]]
    return "".join(f"</{x}>" for x in reversed(names))


def page(rng: random.Random, odd: bool = False) -> str:
    """One page with its content runs marked. odd: names may mislead, and lists of links may be content."""

    def prose(low: int, high: int) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            w = rng.choices(_SPOKEN, k=rng.randint(1, 14))
            w[0] = w[0].capitalize()
            out.append(" ".join(w) + rng.choice("...!?"))
        return " ".join(out)

    def words(low: int, high: int) -> str:
        return " ".join(rng.choices(_LABELS, k=rng.randint(low, high)))

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(low, high))) + "</ul>"

    def other(kind: str) -> str:
        opening = rng.choice(AROUND[kind])
        list_like = opening.startswith(("<ul", "<ol"))
        if kind in ("nav", "share"):
            inner = links(2, 8)[4:-5] if list_like else rng.choice([links(2, 8), words(1, 3), " | ".join(f"<a href='#'>{words(1, 2)}</a>" for _ in range(rng.randint(2, 6)))])
        elif kind == "aside":
            inner = f"<h3>{words(1, 4)}</h3>" + rng.choice([links(3, 8), f"<p>{prose(1, 3)}</p>", f"<div>{prose(1, 2)}</div>"])
        elif kind == "comments":
            tag = "li" if list_like else rng.choice(["div", "p", "article"])
            inner = "" if list_like else f"<h3>{words(1, 3)}</h3>"
            inner += "".join(f"<{tag}>{rng.choice(['', f'<b>{words(1, 2)}</b> '])}{prose(1, 4)}</{tag}>" for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input type=text><p>{prose(1, 1)}</p>"
        elif kind == "header":
            inner = rng.choice([f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 4)}</div>", f"<p>{words(2, 6)}</p>"]) + rng.choice(["", links(2, 6), other("nav")])
        else:
            inner = rng.choice([prose(1, 3), f"<p>{prose(1, 3)}</p>", f"<p>{words(3, 9)}</p>", f"&copy; {words(1, 2)} &middot; {prose(1, 2)}", f"<div><p>{prose(1, 2)}</p></div>", prose(2, 6)])
        return opening + inner + _end(opening)

    def mark(text: str) -> str:
        return f"{OPEN}{text}{CLOSE}"

    def misled(tag: str) -> str:
        name = rng.choice(MISLEADING)
        return f'<{tag} class="{rng.choice([name, f"{name}-{words(1, 1)}", f"{words(1, 1)} {name}", f"{words(1, 1)}-{name} {rng.choice(MISLEADING)}"])}">'

    def mathematics() -> str:
        return f"<math><mi>{words(1, 1)}</mi><mo>=</mo><mn>{rng.randint(1, 99)}</mn></math>"

    container = rng.choice(ARTICLES)
    odd_blocks = [
        lambda: f"<ul>{''.join(f'<li><a href=/x>{mark(words(1, 5))}</a></li>' for _ in range(rng.randint(1, 5)))}<li>{mark(words(1, 4))}</li></ul>",
        lambda: f"<ol>{''.join(f'<li><a href=/x>{mark(words(2, 6))}</a>' for _ in range(rng.randint(2, 6)))}</ol>",
        lambda: f"<p>{mark(prose(1, 2))} {OPEN}{mathematics()}{CLOSE}</p>",
        lambda: f"<p><a href=/x>{mark(words(2, 6))}</a></p>",
        lambda: f"{misled('p')}{mark(prose(1, 3))}</p>",
        lambda: f"{misled('h2')}{mark(words(1, 5))}</h2>",
    ]
    body = [rng.choice(["", f"<h1>{mark(words(2, 9))}</h1>", f"<header><h1>{mark(words(2, 9))}</h1></header>", f"<h2>{mark(prose(1, 1))}</h2>"])]
    blocks = [
        *[lambda: f"<p>{mark(prose(1, 8))}</p>"] * 6,
        lambda: f"<p>{mark(prose(1, 1))}</p>",
        lambda: f"<p>{mark(words(1, 2))}",
        lambda: f"<p><b>{mark(words(2, 5))}<br>",
        lambda: f"<p>{mark(prose(2, 5))}",
        lambda: f"<h2>{mark(words(1, 5))}</h2>",
        lambda: f"<blockquote>{mark(prose(1, 3))}</blockquote>",
        lambda: f"<pre>{mark(words(3, 20))}</pre>",
        lambda: f"<figure><figcaption>{mark(prose(1, 1))}</figcaption></figure>",
        lambda: f"<div>{mark(prose(2, 6))}</div>",
        lambda: f"<section><h2>{mark(words(1, 4))}</h2><p>{mark(prose(1, 4))}</p></section>",
        lambda: "<ul>" + "".join(f"<li>{mark(prose(1, 2))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>",
        lambda: f"<table><tr><td>{mark(words(1, 3))}</td><td>{mark(words(1, 3))}</td></tr></table>",
    ]
    for _ in range(rng.randint(1, 9)):
        body.append(rng.choice(blocks)())
        if odd and rng.random() < 0.25:
            body.append(rng.choice(odd_blocks)())
    if odd and rng.random() < 0.25:  # a wrapper inside the article that is called something else
        tag = rng.choice(["div", "section"])
        body = [rng.choice([misled(tag), f"<{tag}>"]) + "".join(body[1:]) + f"</{tag}>"] if rng.random() < 0.5 else [body[0], misled(tag) + "".join(body[1:]) + f"</{tag}>"]
    if rng.random() < 0.35:
        body.insert(rng.randint(1, len(body)), other(rng.choice(["ad", "share", "aside", "form", "notice"])))
    if rng.random() < 0.3:
        body.append(other(rng.choice(["comments", "share", "aside"])))
    table = container == "<td>"
    article = (container if not table else '<table><tr><td>') + "".join(body) + (_end(container) if not table else "</td></tr></table>")
    if container == "<div>" and not any("<p>" in x for x in body[1:3]):
        article = article.replace("<div>", '<div class="content">', 1)
    if odd and container.startswith(("<article>", "<main>")) and rng.random() < 0.15:
        article = misled(container[1:-1].split("><")[0]) + article[article.index(">") + 1 :]
    plain = [links(3, 9), f"<div>{links(2, 6)}</div>", "<div>" + " | ".join(f"<a href='#'>{words(1, 2)}</a>" for _ in range(rng.randint(3, 6))) + "</div>"]
    before = [other(k) for k in ("header", "nav", "ad", "notice", "form", "aside") if rng.random() < 0.45]
    after = [other(k) for k in ("aside", "comments", "share", "ad", "footer", "notice", "form") if rng.random() < 0.45]
    for side in (before, after):
        if odd and container != "<div>" and rng.random() < 0.15:
            side.insert(0, rng.choice(plain))
    rng.shuffle(before)
    middle = "".join(before) + article + "".join(after[:-1])
    if rng.random() < 0.3:
        middle = f'<div class="{rng.choice(["wrapper", "container", "page", "row"])}">{middle}</div>'
    elif odd and rng.random() < 0.2:
        middle = rng.choice([f'<form id="{words(1, 1)}" method=post>{middle}</form>', f"{misled('div')}{middle}</div>"])
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{middle}{''.join(after[-1:])}</body></html>"


def pages(n: int, seed: int = 11, odd: float = 0.0) -> list[str]:
    """n pages, of which about the share `odd` are odd ones."""
    rng = random.Random(seed)
    return [page(rng, odd > 0 and rng.random() < odd) for _ in range(n)]
