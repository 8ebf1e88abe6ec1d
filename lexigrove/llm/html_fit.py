"""Labelled pages for the classifier of the HTML operator, and its fit.

sample() writes pages of seventeen shapes with texts of its own, so that each block's label is known; `pages` of each shape
bound it. fitted() is a logistic regression with a ridge on their blocks, by Newton's method. The weights in html.py are
those of fitted(sample()), rounded; held_out() fits without a shape and reads its pages, for the figures in the README.
"""

from __future__ import annotations

import random

import numpy as np

from . import html

SYLLABLES = "ka lo mi ren tas vor del shu pra nim ost el ba quo fin gar hul".split()


class _Page:
    """A page under way; `main` marks what is content as it is written."""

    def __init__(self, rng: random.Random):
        self.rng, self.want = rng, []

    def words(self, low: int, high: int) -> list[str]:
        return ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(low, high))]

    def sentence(self, low: int = 6, high: int = 18) -> str:
        text = " ".join(self.words(low, high))
        return text.capitalize() + self.rng.choice("...?!")

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, 6)))

    def main(self, text: str) -> str:
        self.want.append(text)
        return text

    def body(self, level: int = 2, plain: bool = False) -> str:
        """Content: paragraphs, headings, lists, quotations and tables, some of links and numbers alone."""
        out = []
        for _ in range(self.rng.randint(2, 6)):
            kind = self.rng.random()
            if plain or kind < 0.55:
                out.append(f"<p>{self.main(self.paragraph())}</p>")
            elif kind < 0.67:
                out.append(f"<h{level}>{self.main(' '.join(self.words(1, 5)).title())}</h{level}><p>{self.main(self.paragraph())}</p>")
            elif kind < 0.77:
                out.append("<ul>" + "".join(f"<li>{self.main(self.sentence(2, 9))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f'<li><a href="/x">{self.main(" ".join(self.words(2, 6)))}</a></li>' for _ in range(2)) + f"</ul><p>{self.main(self.paragraph())}</p>")
            elif kind < 0.93:
                out.append(f"<blockquote>{self.main(self.sentence())}</blockquote><p>{self.main(self.paragraph())}</p>")
            else:
                out.append("<table><tr>" + "".join(f"<td>{self.main(str(self.rng.randint(1, 9999)))}</td>" for _ in range(3)) + f"</tr></table><p>{self.main(self.paragraph())}</p>")
        return "".join(out)

    def title(self) -> str:
        return f"<h1>{self.main(' '.join(self.words(3, 8)).capitalize())}</h1>"

    def menu(self, tag: str = "div") -> str:
        return f"<{tag}><ul>" + "".join(f'<li><a href="/{i}">{" ".join(self.words(1, 2)).title()}</a></li>' for i in range(self.rng.randint(3, 8))) + f"</ul></{tag}>"

    def cookies(self) -> str:
        say = self.rng.choice(["We use cookies to improve this site. See our privacy policy.", "This website uses cookies. By going on you accept our terms of use.", "We value your consent: accept all cookies to continue."])
        return f"<div><p>{say}</p><button>OK</button></div>"

    def rights(self, tag: str = "div") -> str:
        say = self.rng.choice(["\u00a9 2020 {}. All rights reserved.", "Copyright 2019 {}", "All rights reserved, {}."])
        return f"<{tag}><p>{say.format(' '.join(self.words(1, 3)).title())}</p></{tag}>"

    def remarks(self, outer: str = "div", heading: str = "h3") -> str:
        title = self.rng.choice(["Comments", "3 comments", "Leave a reply", "Reader comments", "Responses (2)"])
        said = "".join(f"<div><p>{self.words(1, 1)[0].title()} {self.rng.choice(['says:', 'wrote:', '2 days ago', 'commented on 3 May 2019'])}</p><p>{self.sentence(3, 14)}</p></div>" for _ in range(self.rng.randint(1, 4)))
        return f"<{outer}><{heading}>{title}</{heading}>{said}</{outer}>"

    def advert(self) -> str:
        return f"<p>Advertisement</p><p>{self.sentence(3, 9)}</p>" if self.rng.random() < 0.5 else f'<p><a href="/buy">{" ".join(self.words(2, 7))}</a></p>'


def _shapes() -> dict:
    """Shapes by name: each writes a page."""
    wrap = lambda head, *rest: f"<html><head><title>t</title></head><body>{head}{''.join(rest)}</body></html>"
    classed = lambda name, text: f'<div class="{name}">{text}</div>'
    return {
        "article": lambda p: wrap(p.menu("nav"), f"<header><p>{p.sentence(2, 5)}</p></header>", f"<article>{p.title()}{p.body()}</article>", f"<aside>{p.paragraph()}</aside>", p.rights("footer")),
        "article of classes": lambda p: wrap(p.menu("nav"), f'<article class="{p.rng.choice(["post tag-politics hentry", "post legal", "entry has-share", "story"])}">{p.title()}{p.body()}<div class="share">Share this on {p.words(1, 1)[0]}</div></article>', classed("comments", p.remarks())),
        "article beside plain parts": lambda p: wrap(p.menu(), f"<article>{p.title()}{p.body()}</article>", p.remarks("section", "h2"), p.cookies(), p.rights()),
        "main": lambda p: wrap(p.menu("header"), f'<main>{p.title()}<div class="{p.rng.choice(["legal", "alerts", "row", "section"])}">{p.body()}</div>{p.remarks()}</main>', p.rights("footer")),
        "content class": lambda p: wrap(classed("header", f"<p>{p.sentence()}</p>"), classed("menu", p.menu()), classed("content-with-sidebar", classed(p.rng.choice(["content", "post has-share tag meta", "entry-content", "article body"]), p.title() + p.body()) + classed("sidebar", f"<p>{p.paragraph()}</p>")), classed("footer", p.rights())),
        "advert classes": lambda p: wrap(classed("ad", p.sentence(3, 14)), classed("search", f"<p>{p.sentence(3, 9)}</p>"), classed("story", p.title() + p.body() + classed("ad-box", f"<p>{p.sentence(3, 14)}</p>") + f"<p>{p.main(p.paragraph())}</p>"), classed("disclaimer", f"<p>{p.sentence()}</p>"), classed("newsletter", p.advert())),
        "plain": lambda p: wrap(p.menu(), f"<div>{p.title()}{p.body(plain=True)}</div>", p.remarks(), p.cookies(), p.rights()),
        "plain, notice first": lambda p: wrap(p.cookies(), p.menu(), p.title(), p.body(plain=True), p.remarks("section", "h2"), p.rights("p")),
        "table layout": lambda p: wrap(f"<table><tr><td>{p.menu()}</td><td>{p.title()}{p.body(plain=True)}</td><td>{p.advert()}</td></tr></table>", p.rights("center")),
        "line breaks": lambda p: wrap(p.menu(), f"<div>{p.title()}<div>{p.main(p.paragraph())}<hr>{p.main(p.paragraph())}</div></div>", p.advert(), p.rights("div")),
        "one form": lambda p: wrap(f'<form id="aspnet">{p.menu()}<main>{p.title()}{p.body()}</main>{p.cookies()}</form>'),
        "remarks as articles": lambda p: wrap(p.menu("nav"), f"<article>{p.title()}{p.body()}" + classed("post-sidebar", f"<p>{p.paragraph()}</p>") + "</article>", '<div id="comments">' + "".join(f'<article class="comment-body"><p>{p.paragraph()}</p></article>' for _ in range(3)) + "</div>", p.rights("footer")),
        "page in a form": lambda p: wrap(f'<form id="aspnetForm" method="post"><input type="hidden" name="state" value="x">{p.menu()}<div><input name="q"><button>Go</button></div><div>{p.title()}{p.body(plain=True)}</div>{p.cookies()}{p.rights()}</form>'),
        "compound classes": lambda p: wrap(p.menu("nav"), classed(p.rng.choice(["post comments-open", "entry comments-closed", "notice-board", "related-work", "share-price", "lunch-menu", "story-comments-off"]), p.title() + p.body(plain=True)), classed("main-menu", p.menu()), classed("comment-list", f"<p>{p.paragraph()}</p>"), p.rights("footer")),
        "remarks without a title": lambda p: wrap(p.menu(), f"<div>{p.title()}{p.body(plain=True)}<p>{p.main(p.paragraph())}</p><p>{p.main(p.paragraph())}</p></div>", "".join(f"<div><p>{p.words(1, 1)[0].title()}, {p.rng.choice(['3 May 2020', 'May 12, 2019', '2021-04-05', '3.5.2020 12:30'])}</p><p>{p.sentence(3, 10)}</p></div>" for _ in range(p.rng.randint(1, 2))), p.rights()),
        "titles as topics": lambda p: wrap(p.menu("nav"), f"<article>{p.title()}" + "".join(f"<h2>{p.main(p.rng.choice(['Related', 'Popular', 'Responses', 'Comment', 'Trending', 'Sponsors']))}</h2><p>{p.main(p.paragraph())}</p>" for _ in range(3)) + f"<h2>Related articles</h2>{p.menu()}</article>", p.rights("footer")),
        "sections": lambda p: wrap(p.menu(), "".join(f"<section><h2>{p.main(' '.join(p.words(1, 5)).title())}</h2><p>{p.main(p.paragraph())}</p><p>{p.main(p.paragraph())}</p></section>" for _ in range(3)), f"<section><h2>Related articles</h2>{p.menu()}</section>", p.remarks(), p.rights()),
    }


def sample(pages: int = 40, seed: int = 1) -> dict[str, list[tuple[str, list[str]]]]:
    """For each shape, `pages` pages and the texts of their content blocks."""
    out = {}
    for name, write in _shapes().items():
        out[name] = []
        for i in range(pages):
            page = _Page(random.Random(f"{seed}/{name}/{i}"))
            out[name].append((write(page), page.want))
    return out


def fitted(labelled: dict[str, list[tuple[str, list[str]]]], ridge: float = 0.5, rounds: int = 30) -> dict[str, float]:
    """Weights of the logistic regression on the blocks that HTML itself does not rule out."""
    rows, marks = [], []
    for pages in labelled.values():
        for page, want in pages:
            blocks, wanted = html.blocks_of(page), set(want)
            for block, row in zip(blocks, html.features(blocks)):
                if not block.ruled_out:
                    rows.append(row)
                    marks.append(block.text in wanted)
    x, y = np.array(rows), np.array(marks, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return {name: round(float(v), 1) for name, v in zip(html.FEATURES, w)}


def held_out(pages: int = 40) -> dict[str, tuple[float, float]]:
    """Precision and recall by shape, of weights that were fitted on all other shapes."""
    labelled, told, out = sample(pages), dict(html.WEIGHTS), {}
    try:
        for name in labelled:
            html.WEIGHTS.update(fitted({k: v for k, v in labelled.items() if k != name}))
            out |= figures({name: labelled[name]})
    finally:
        html.WEIGHTS.update(told)
    return out


def figures(labelled: dict[str, list[tuple[str, list[str]]]]) -> dict[str, tuple[float, float]]:
    """Precision and recall of the blocks of content by shape."""
    out = {}
    for name, pages in labelled.items():
        right = found = wanted = 0
        for page, want in pages:
            got = html.content(page)
            left = list(want)
            for text in got:
                if text in left:
                    left.remove(text)
                    right += 1
            found, wanted = found + len(got), wanted + len(want)
        out[name] = right / max(1, found), right / max(1, wanted)
    return out
