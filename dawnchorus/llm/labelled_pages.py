"""Labelled pages from which the content model of ``dom_marginals`` is trained.

Each page is put together by rule from the parts that pages have: a main text in one
of several containers, and menus, headers, footers, sidebars, notices, adverts, forms
and reader comments around and inside it.  ``data-label`` names the kind of the text
below; nothing else in the page tells it.  The words are invented, so that the model
learns from structure alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

CONTENT_FRAMES = (
    "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<article class='post'>{}</article>",
    "<div class='content'>{}</div>", "<div id='content'><div class='entry-content'>{}</div></div>",
    "<section class='story'>{}</section>", "<div id='main'><div class='article-body'>{}</div></div>",
    "<div class='post-text'>{}</div>", "<div>{}</div>", "<section>{}</section>", "{}", "{}", "{}", "{}",
)
MENUS = ("<nav>{}</nav>", "<nav class='menu'>{}</nav>", "<div class='menu'>{}</div>", "<div class='navbar'>{}</div>",
         "<ul class='nav'>{}</ul>", "<div id='navigation'>{}</div>", "<div class='breadcrumb'>{}</div>", "<menu>{}</menu>")
HEADERS = ("<header>{}</header>", "<div class='header'>{}</div>", "<div id='masthead'>{}</div>",
           "<header class='site-header'>{}</header>", "<div class='banner'>{}</div>")
FOOTERS = ("<footer>{}</footer>", "<div class='footer'>{}</div>", "<div id='footer'>{}</div>",
           "<footer class='site-footer'>{}</footer>", "<div class='copyright'>{}</div>")
SIDEBARS = ("<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div id='sidebar'>{}</div>", "<aside class='related'>{}</aside>",
            "<div class='related-links'>{}</div>", "<div class='widget'>{}</div>", "<section class='recommended'>{}</section>", "<div class='teaser'>{}</div>",
            "<div class='share'>{}</div>", "<div class='social'>{}</div>", "<div class='more-stories'>{}</div>")
NOTICES = ("<div class='cookie-notice'>{}</div>", "<div class='cookie'>{}</div>", "<div class='notice'>{}</div>",
           "<div id='consent'>{}</div>", "<div class='alert'>{}</div>", "<div class='popup'>{}</div>", "<dialog>{}</dialog>",
           "<section class='newsletter'>{}</section>", "<p class='notice'>{}</p>", "<div class='gdpr-banner'>{}</div>")
ADVERTS = ("<div class='ad'>{}</div>", "<div class='ads'>{}</div>", "<div class='advert'>{}</div>", "<div id='ad-top'>{}</div>",
           "<div class='advertisement'>{}</div>", "<div class='promo'>{}</div>", "<aside class='sponsored'>{}</aside>",
           "<p class='ad'>{}</p>", "<section class='sponsor'>{}</section>")
FORMS = ("<form>{}</form>", "<form class='search'>{}</form>", "<div class='login'><form>{}</form></div>", "<fieldset>{}</fieldset>",
         "<form id='subscribe'>{}</form>")
COMMENTS = ("<section class='comments'>{}</section>", "<div class='comments'>{}</div>", "<div id='comments'>{}</div>",
            "<ol class='comment-list'>{}</ol>", "<div class='discussion'>{}</div>", "<section id='replies'>{}</section>",
            "<div class='comment'>{}</div>", "<aside class='comments'>{}</aside>", "<div class='reviews'>{}</div>")


def _words(rng: random.Random, low: int, high: int) -> str:
    n = int(low * (high / low) ** rng.random())
    return " ".join("".join(rng.choice(("ba", "ko", "li", "mer", "tun", "sa", "er", "vo")) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def _sentence(rng: random.Random, low: int, high: int) -> str:
    text = _words(rng, low, high).capitalize()
    return text + rng.choice((".", ".", ".", ".", "!", "?", "", ":"))


def _links(rng: random.Random) -> str:
    links = [f"<a href='/'>{_words(rng, 1, 4)}</a>" for _ in range(rng.randint(1, 9))]
    if rng.random() < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
    return rng.choice((" ", " | ", "<br>")).join(links)


def _prose(rng: random.Random) -> str:
    text = _sentence(rng, 2, 60)
    return rng.choice(("{}", "<p>{}</p>", "<span>{}</span>", "<p><a href='/'>{}</a></p>", "<h3>" + _words(rng, 1, 5) + "</h3><p>{}</p>")).format(text)


def _form(rng: random.Random) -> str:
    return f"<label>{_words(rng, 1, 4)}</label><input><p>{_sentence(rng, 2, 20)}</p><button>{_words(rng, 1, 2)}</button>"


def _comments(rng: random.Random) -> str:
    shape = rng.choice(("<div class='comment'><p>{}</p></div>", "<p>{}</p>", "<li class='comment'>{}</li>", "<article class='comment'><p>{}</p></article>",
                        "<div><b>" + _words(rng, 1, 2) + "</b><p>{}</p></div>"))
    title = f"<h2>{_words(rng, 1, 3)}</h2>" if rng.random() < 0.5 else ""
    return title + "".join(shape.format(_sentence(rng, 3, 80)) for _ in range(rng.randint(1, 5)))


def _paragraph(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.75:
        text = _sentence(rng, 1, 200)
        if rng.random() < 0.2:
            text += f" <a href='/x'>{_words(rng, 1, 4)}</a> {_sentence(rng, 3, 40)}"
        return f"<p>{text}</p>"
    if kind < 0.83:
        return f"<h2>{_words(rng, 1, 9)}</h2>"
    if kind < 0.90:
        return "<ul>" + "".join(f"<li>{_sentence(rng, 1, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
    if kind < 0.94:
        return f"<blockquote><p>{_sentence(rng, 5, 60)}</p></blockquote>"
    if kind < 0.97:
        return "<table>" + "".join(f"<tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 3)}</td></tr>" for _ in range(3)) + "</table>"
    return rng.choice(("<pre>{}</pre>", "<div>{}</div>", "<figure><figcaption>{}</figcaption></figure>")).format(_sentence(rng, 3, 40))


def _labelled(label: str, frame: str, inner: str) -> str:
    """The frame with ``data-label`` on its outermost element."""
    if frame.startswith("<p "):
        inner = re.sub("<[^>]+>", " ", inner)  # a paragraph holds no blocks
    whole = frame.format(inner)
    head, mark, rest = whole.partition(">")
    return f"{head} data-label='{label}'{mark}{rest}"


def labelled_pages(count: int = 600, seed: int = 7) -> list[str]:
    """``count`` pages, the same for the same seed."""
    rng = random.Random(seed)
    parts: list[tuple[tuple[str, ...], Callable[[random.Random], str], float]] = [
        (MENUS, _links, 0.7), (HEADERS, lambda r: r.choice((_links, _prose))(r), 0.5), (ADVERTS, _prose, 0.5),
        (NOTICES, _prose, 0.4), (FORMS, _form, 0.35), (SIDEBARS, lambda r: r.choice((_links, _prose))(r), 0.45)]
    after: list[tuple[tuple[str, ...], Callable[[random.Random], str], float]] = [
        (COMMENTS, _comments, 0.45), (ADVERTS, _prose, 0.2), (NOTICES, _prose, 0.15), (FORMS, _form, 0.15),
        (SIDEBARS, lambda r: r.choice((_links, _prose))(r), 0.35), (FOOTERS, lambda r: r.choice((_links, _prose))(r), 0.8)]

    def some(choices: list) -> list[str]:
        return [_labelled("other", rng.choice(frames), make(rng)) for frames, make, share in choices if rng.random() < share]

    pages = []
    for _ in range(count):
        blocks = [f"<h1>{_words(rng, 1, 12)}</h1>"] if rng.random() < 0.8 else []
        blocks += [_paragraph(rng) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.5:  # a part that is not main text inside the main container
            inner = rng.choice(((ADVERTS, _prose), (SIDEBARS, _links), (SIDEBARS, _prose), (NOTICES, _prose), (COMMENTS, _comments),
                                (COMMENTS, _comments), (FORMS, _form)))
            blocks.insert(rng.randint(1, len(blocks)), _labelled("other", rng.choice(inner[0]), inner[1](rng)))
        frame = rng.choice(CONTENT_FRAMES)
        if frame == "{}":
            main = "".join(b if "data-label" in b else _labelled("main", b.replace("{", "").replace("}", ""), "") for b in blocks)
        else:
            main = _labelled("main", frame, "".join(blocks))
        alone = rng.random() < 0.3  # nothing but the main text
        before, behind = ([], []) if alone else (some(parts), some(after))
        if rng.random() < 0.12:  # cells of a table as columns of the page
            cells = [_labelled("other", "<td>{}</td>", _links(rng)), f"<td>{main}</td>"]
            if rng.random() < 0.4:
                cells.append(_labelled("other", "<td>{}</td>", rng.choice((_links, _prose))(rng)))
            main = f"<table><tr>{''.join(cells)}</tr></table>"
        body = "".join([*before, main, *behind])
        if rng.random() < 0.3:
            body = rng.choice(("<div id='wrapper'>{}</div>", "<div class='container'>{}</div>", "<div class='page'>{}</div>",
                               "<div>{}</div>", "<center>{}</center>")).format(body)
        pages.append(body if rng.random() < 0.2 else f"<html><body>{body}</body></html>")
    return pages
