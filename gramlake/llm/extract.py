"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks (dom.blocks). Features of a block are its
ancestors' tags and class words and its text's shape; transitions are learned
between neighbouring labels (main, other). The field is trained by maximum
likelihood on labelled pages (page source and main text) and decoded by Viterbi.
The labelled pages are made here, from seeded page patterns, as the data have no
labels; fit() takes any others.

Defined cases: a null or empty page, or one without text, gives an empty text and
0 characters; script, style, form controls and head titles are never text; blocks
are joined by one newline; nothing is cut from long pages; repeated pages give
repeated results; an empty table an empty result.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Block, blocks

# Class and id words by what they tell of a block.
HINTS = {
    "menu": "nav navbar navigation menu submenu breadcrumb breadcrumbs toolbar topbar skip pagination pager tabs toc",
    "head": "header masthead banner branding logo site top hero",
    "foot": "footer bottom colophon copyright legal",
    "side": "sidebar aside side rail widget widgets related recommended trending popular more teaser",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted dfp outbrain taboola affiliate",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay toast disclaimer paywall privacy",
    "form": "form login signin signup subscribe subscription newsletter search contact register",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback review reviews thread",
    "share": "share sharing social follow like tweet facebook twitter tags tag meta byline author date timestamp",
    "main": "article content main post entry story body text page single prose markdown",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "ul", "ol", "table", "p", "h1", "h2", "h3", "li", "div", "blockquote", "pre", "figure", "figcaption", "dl", "address", "button", "fieldset", "dialog", "menu", "details", "td", "body")


#: An element with more of a page's text than this is a frame: its class words say nothing
#: about its blocks, unless they name it the main part.
FRAME = 0.65
BOXES = ("div", "section", "td", "article", "main", "aside", "header", "footer", "nav", "ul", "ol", "dl", "form", "table", "li", "body")


def features(page: list[Block]) -> list[list[str]]:
    """Names of the active features of every block of a page."""
    chars, linked = Counter(), Counter()
    for b in page:
        for e in b.path:
            chars[id(e)] += len(b.text)
            linked[id(e)] += b.link_chars
    whole = sum(len(b.text) for b in page)
    tags_of_page = {e.tag for b in page for e in b.path}
    has = [t for t in ("article", "main") if t in tags_of_page]
    out = []
    seen_main = False
    for b in page:
        path_tags = [e.tag for e in b.path]
        f = ["bias"]
        if path_tags:
            f.append("leaf:" + path_tags[-1] if path_tags[-1] in TAGS else "leaf:other")
        f += [f"in:{t}" for t in {*path_tags} if t in TAGS]
        inner = -1
        for k, t in enumerate(path_tags):
            if t in ("article", "main"):
                inner = k
        for k, e in enumerate(b.path):
            where = "inner" if k > inner >= 0 else "outer"
            if e.tag in ("nav", "header", "footer", "aside", "form", "section", "button", "dialog"):
                f.append(f"{where}:{e.tag}")
            for w in e.marks:
                if w == "!hidden":
                    f.append("hidden")
                h = _HINT.get(w)
                if h and e.tag not in ("html", "body") and (h == "main" or chars[id(e)] <= FRAME * whole):
                    f += [f"{where}:{h}", f"hint:{h}"]
        inside = inner >= 0
        seen_main |= inside
        for t in has:
            f.append(f"page-has:{t}:{'in' if t in path_tags else 'out'}")
        if has and not inside:
            f.append("after" if seen_main else "before")
        box = next((e for e in reversed(b.path) if e.tag in BOXES), None)
        if box is not None:
            share = linked[id(box)] / chars[id(box)]
            f.append("box-links:" + ("0" if not share else "low" if share < 0.3 else "mid" if share < 0.7 else "high"))
            f.append("box-part:" + next((str(k) for k in (5, 15, 40) if 100 * chars[id(box)] < k * whole), "most"))
        n = b.text.count(" ") + 1
        f.append("words:" + ("1" if n == 1 else "2-4" if n < 5 else "5-9" if n < 10 else "10-24" if n < 25 else "25-59" if n < 60 else "60+"))
        share = b.link_chars / len(b.text)
        f.append("links:" + ("0" if not share else "low" if share < 0.3 else "mid" if share < 0.7 else "high"))
        if b.text[-1] in ".!?…:;\"”»。":
            f.append("stop")
        if "©" in b.text or "copyright" in b.text[:60].lower():
            f.append("copyright")
        out.append([*dict.fromkeys(f)])
    return out


class Field:
    """Weights of a two-label linear-chain field; label 1 is main text."""

    def __init__(self, names: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.index = {n: k for k, n in enumerate(names)}
        self.names, self.weights, self.trans, self.start = names, weights, trans, start
        self._rows = [tuple(map(float, w)) for w in weights]

    def decode(self, page: list[Block]) -> list[int]:
        """Most likely labels, by Viterbi; ties go to label 0."""
        if not page:
            return []
        (t00, t01), (t10, t11) = self.trans.tolist()
        get, rows = self.index.get, self._rows
        back: list[tuple[int, int]] = []
        s0, s1 = self.start.tolist()
        for k, fs in enumerate(features(page)):
            e0 = e1 = 0.0
            for f in fs:
                i = get(f)
                if i is not None:
                    a, b = rows[i]
                    e0 += a
                    e1 += b
            if k:
                from0, from1 = int(s1 + t10 > s0 + t00), int(s1 + t11 > s0 + t01)
                s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11)
                back.append((from0, from1))
            s0, s1 = s0 + e0, s1 + e1
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def text(self, html: str) -> str:
        page = blocks(html)
        return "\n".join(b.text for b, y in zip(page, self.decode(page)) if y)


def labels_of(page: list[Block], main: str) -> list[int]:
    """Labels from a page's main text: its lines, aligned with the blocks in order; a line
    that no block has does not cost the lines after it."""
    out = [0] * len(page)
    for _, at, n in SequenceMatcher(None, main.split("\n"), [b.text for b in page], autojunk=False).get_matching_blocks():
        out[at : at + n] = [1] * n
    return out


def fit(labelled: list[tuple[str, str]], rounds: int = 120, l2: float = 1e-3, rate: float = 0.15) -> Field:
    """Maximum-likelihood training by Adam on forward-backward gradients."""
    pages = [(p, labels_of(p, main)) for p, main in ((blocks(h), m) for h, m in labelled) if p]
    feats = [features(p) for p, _ in pages]
    names = sorted({f for fs in feats for x in fs for f in x})
    index = {n: k for k, n in enumerate(names)}
    longest = max(map(len, feats))
    n, d = len(pages), len(names)
    x = np.zeros((n, longest, d), np.float32)
    y = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, (fs, (_, ys)) in enumerate(zip(feats, pages)):
        for k, (f, label) in enumerate(zip(fs, ys)):
            x[i, k, [index[name] for name in f]] = 1
            y[i, k], mask[i, k] = label, True
    gold = np.stack([1 - y, y], -1) * mask[..., None]
    flat = x.reshape(-1, d)
    theta = np.zeros(2 * d + 4 + 2)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for r in range(1, rounds + 1):
        w, trans, start = theta[: 2 * d].reshape(d, 2), theta[2 * d : 2 * d + 4].reshape(2, 2), theta[-2:]
        e = (flat @ w.astype(np.float32)).reshape(n, longest, 2)
        a = np.zeros((n, longest, 2))
        a[:, 0] = start + e[:, 0]
        for k in range(1, longest):
            step = lse(a[:, k - 1, :, None] + trans, 1) + e[:, k]
            a[:, k] = np.where(mask[:, k, None], step, a[:, k - 1])
        z = lse(a[:, -1], 1)
        b = np.zeros((n, longest, 2))
        for k in range(longest - 2, -1, -1):
            step = lse(trans + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
            b[:, k] = np.where(mask[:, k + 1, None], step, 0.0)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        g_w = flat.T @ (p - gold).reshape(-1, 2).astype(np.float32)
        both = mask[:, 1:, None, None]
        pair = np.exp(a[:, :-1, :, None] + trans + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both
        gold_pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        g_t = (pair - gold_pair).sum((0, 1))
        g_s = (p[:, 0] - gold[:, 0]).sum(0)
        g = np.concatenate([g_w.ravel(), g_t.ravel(), g_s]) / n + l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta - rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return Field(names, theta[: 2 * d].reshape(d, 2), theta[2 * d : 2 * d + 4].reshape(2, 2), theta[-2:])


class _Maker:
    """Seeded pages with their main text, over the common page patterns."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(("an", "er", "th", "on", "re", "in", "es", "ti", "ou", "la")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice(("." * 9) + "!?") for _ in range(self.r.randint(low, high)))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def cls(self, kind: str) -> str:
        w = self.r.choice(HINTS[kind].split()[:8])
        w += self.r.choice(("", "", "-box", "-wrap", "-1", "_area"))
        return self.r.choice((f'class="{w}"', f'class="{w} {self.words(1, 1)}"', f'id="{w}"'))

    def menu(self) -> str:
        ul = f"<ul>{self.links(self.r.randint(3, 8))}</ul>"
        return self.r.choice((f"<nav>{ul}</nav>", f"<nav {self.cls('menu')}>{ul}</nav>", f"<div {self.cls('menu')}>{ul}</div>", f"<header><nav>{ul}</nav></header>"))

    def head(self) -> str:
        inner = self.r.choice((f"<a href='/'>{self.words(1, 4)}</a>", f"<h1>{self.words(1, 4)}</h1><p>{self.words(3, 9)}</p>", f"<p>{self.sentences(1, 2)}</p>", f"<div>{self.words(1, 4)}</div>"))
        return self.r.choice((f"<header>{inner}</header>", f"<div {self.cls('head')}>{inner}</div>", f"<header {self.cls('head')}>{inner}</header>"))

    def foot(self) -> str:
        inner = self.r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>Copyright {self.words(2, 6)}</p><ul>{self.links(3)}</ul>", f"<p>{self.sentences(1, 3)}</p>", f"{self.sentences(1, 3)}", f"<ul><li>{self.sentences(1, 1)}</li><li>{self.words(2, 6)}</li></ul>", f"<address>{self.words(2, 6)}</address>"))
        return self.r.choice((f"<footer>{inner}</footer>", f"<div {self.cls('foot')}>{inner}</div>", f"<footer {self.cls('foot')}>{inner}</footer>"))

    def side(self) -> str:
        inner = self.r.choice((f"<h3>{self.words(1, 3)}</h3><ul>{self.links(4)}</ul>", f"<p>{self.sentences(1, 3)}</p>", f"<h2>{self.words(1, 3)}</h2><p>{self.sentences(1, 4)}</p>"))
        return self.r.choice((f"<aside>{inner}</aside>", f"<div {self.cls('side')}>{inner}</div>", f"<aside {self.cls('side')}>{inner}</aside>", f"<section {self.cls('side')}>{inner}</section>"))

    def ad(self) -> str:
        inner = self.r.choice((self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f"<a href='/x'>{self.words(2, 8)}</a>"))
        return f"<div {self.cls('ad')}>{inner}</div>" if self.r.random() < 0.8 else f"<section {self.cls('ad')}>{inner}</section>"

    def notice(self) -> str:
        inner = self.r.choice((f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>", self.sentences(1, 2)))
        return self.r.choice((f"<div {self.cls('notice')}>{inner}</div>", f'<div role="dialog" {self.cls("notice")}>{inner}</div>', f"<section {self.cls('notice')}>{inner}</section>", f"<p {self.cls('notice')}>{self.sentences(1, 2)}</p>"))

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q><p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>"
        return self.r.choice((f"<form>{inner}</form>", f"<form {self.cls('form')}>{inner}</form>", f"<div {self.cls('form')}><form>{inner}</form></div>"))

    def comments(self) -> str:
        one = lambda: self.r.choice((f"<p>{self.sentences(1, 4)}</p>", f"<div {self.cls('comment')}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></div>", f"<li>{self.sentences(1, 3)}</li>", f"<article {self.cls('comment')}><p>{self.sentences(1, 4)}</p></article>"))
        inner = f"<h3>{self.words(1, 3)}</h3>" * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.r.choice((f"<section {self.cls('comment')}>{inner}</section>", f"<div {self.cls('comment')}>{inner}</div>", f"<ul {self.cls('comment')}>{inner}</ul>"))

    def share(self) -> str:
        return f"<div {self.cls('share')}>{self.words(1, 5)}</div>"

    def article(self) -> tuple[str, list[str]]:
        """Source and lines of an article's own blocks, with foreign parts inside."""
        r, out, lines = self.r, [], []
        title = self.words(2, 10).capitalize() + r.choice((".", "", ""))
        heading = r.choice((f"<h1>{title}</h1>", f"<h1 class=title>{title}</h1>", f"<h2>{title}</h2>"))
        out.append(f"<header>{heading}<p {self.cls('share')}>{self.words(2, 5)}</p></header>" if r.random() < 0.12 else heading)
        lines.append(title)
        if r.random() < 0.15:
            out.append(self.share())
        for _ in range(r.choice((r.randint(1, 4), r.randint(1, 14)))):
            kind = r.random()
            if kind < 0.7:
                t = self.sentences(1, r.choice((1, 4, 7)))
                link = r.random() < 0.15
                out.append(f"<p>{t}" + (f' <a href="/a">{self.words(1, 3)}</a> on.' if link else "") + ("</p>" if r.random() < 0.9 else ""))
                if link:
                    t = " ".join(out[-1].replace('<a href="/a">', "").replace("</a>", "").replace("<p>", "").replace("</p>", "").split())
                lines.append(t)
            elif kind < 0.78:
                t = self.words(2, 8).capitalize()
                out.append("<h{0}>{1}</h{0}>".format(r.choice("23"), t))
                lines.append(t)
            elif kind < 0.86:
                ts = [self.words(1, 14).capitalize() for _ in range(r.randint(2, 5))]
                out.append("<ul>" + "".join(f"<li>{t}</li>" for t in ts) + "</ul>")
                lines += ts
            elif kind < 0.9:
                t = self.sentences(1, 3)
                out.append(f"<blockquote>{t}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{t}</p></blockquote>")
                lines.append(t)
            elif kind < 0.93:
                ts = [self.words(1, 3) for _ in range(4)]
                out.append(f"<table><tr><td>{ts[0]}</td><td>{ts[1]}</td></tr><tr><td>{ts[2]}</td><td>{ts[3]}</td></tr></table>")
                lines += ts
            elif kind < 0.95:
                t = self.sentences(1, 2)
                out.append(f"<p><b>{t}<br>" if r.random() < 0.7 else f"<pre>{t}</pre>")
                lines.append(t)
            elif kind < 0.97:
                made, more = r.choice((self.terms, self.figure, self.details, self.place, self.broken))()
                out.append(made)
                lines += more
            else:
                out.append(r.choice((self.ad, self.side, self.share, self.form, self.notice, self.hidden))())
        # parts of an article in sections or boxes of their own
        if r.random() < 0.35 and len(out) > 1:
            cuts = sorted(r.sample(range(1, len(out)), min(len(out) - 1, r.randint(1, 3))))
            parts = ["".join(out[a:b]) for a, b in zip([0, *cuts], [*cuts, len(out)])]
            tag = r.choice(("section", "section", "div"))
            first = r.randint(0, 1)
            out = [p if k < first else f"<{tag}{self.plain()}>{p}</{tag}>" for k, p in enumerate(parts)]
        if r.random() < 0.12:
            out.append(f"<footer>{r.choice((self.sentences(1, 2), f'<p>{self.words(2, 8)}</p>'))}</footer>")
        return "".join(out), lines

    def plain(self) -> str:
        """No mark, or one that tells nothing."""
        return self.r.choice(("", "", f' class="{self.words(1, 1)}"', f' id="{self.words(1, 1)}"', f' class="{self.r.choice(("container", "row", "col-8", "inner", "wrapper", "block", "section"))}"'))

    def terms(self) -> tuple[str, list[str]]:
        ts = [(self.words(1, 3), self.sentences(1, 2)) for _ in range(self.r.randint(2, 4))]
        return "<dl>" + "".join(f"<dt>{a}</dt><dd>{b}</dd>" for a, b in ts) + "</dl>", [x for t in ts for x in t]

    def figure(self) -> tuple[str, list[str]]:
        t = self.words(3, 12).capitalize()
        return f"<figure><img src=a.png><figcaption>{t}</figcaption></figure>", [t]

    def details(self) -> tuple[str, list[str]]:
        a, b = self.words(1, 4), self.sentences(1, 3)
        return f"<details><summary>{a}</summary><p>{b}</p></details>", [a, b]

    def place(self) -> tuple[str, list[str]]:
        t = self.words(3, 8).capitalize()
        return f"<address>{t}</address>", [t]

    def broken(self) -> tuple[str, list[str]]:
        """Paragraphs made by line breaks."""
        ts = [self.sentences(1, 3) for _ in range(self.r.randint(2, 4))]
        return "<div>" + "<br><br>".join(ts) + "</div>", ts

    def hidden(self) -> str:
        t = self.sentences(1, 3)
        return self.r.choice((f"<div hidden>{t}</div>", f'<p style="display:none">{t}</p>', f'<div aria-hidden="true"><p>{t}</p></div>', f'<div style="display: none"><p>{t}</p></div>', f"<p hidden>{t}</p>"))

    def bar(self) -> str:
        """Links in a row or column without a list."""
        at = [f'<a href="/{k}">{self.words(1, 2)}</a>' for k in range(self.r.randint(2, 7))]
        return self.r.choice((f"<p>{' | '.join(at)}</p>", f"<div>{' '.join(at)}</div>", f"<div>{'<br>'.join(at)}</div>", f"<table><tr><td>{'<br>'.join(at)}</td></tr></table>", "<table><tr>" + "".join(f"<td>{a}</td>" for a in at) + "</tr></table>"))

    def page(self) -> tuple[str, str]:
        r = self.r
        body, lines = self.article()
        tail = self.comments() if r.random() < 0.25 else ""
        wrap = r.random()
        if wrap < 0.4:
            core = f"<article{' ' + self.cls('main') if r.random() < 0.3 else ''}>{body}{tail if r.random() < 0.3 else '</article>' + tail}"
            core = core if "</article>" in core[-len(tail) - 12 :] else core + "</article>"
        elif wrap < 0.55:
            core = f"<main>{body}{tail}</main>" if r.random() < 0.5 else f"<main><article>{body}</article>{tail}</main>"
        elif wrap < 0.65:
            core = f"<section {self.cls('main')}>{body}</section>{tail}"
        elif wrap < 0.72:
            core = f"<{r.choice(('div', 'section'))}{self.plain()}>{body}</div>{tail}"
        elif wrap < 0.79:
            core = body + tail
        else:
            core = f"<div {self.cls('main')}>{body}</div>{tail}"
        if wrap < 0.65 and r.random() < 0.3:  # boxes within the main part
            opened, closed = core.split(">", 1)[0] + ">", core.split(">", 1)[1]
            tag = r.choice(("section", "div"))
            core = f"{opened}<{tag}{self.plain()}>{closed}</{tag}>" if not tail else core
        before = [f() for f in (self.head, self.menu, self.bar, self.notice, self.ad, self.form, self.side, self.hidden) if r.random() < 0.3]
        after = [f() for f in (self.side, self.ad, self.comments, self.form, self.notice, self.bar, self.hidden, self.foot, self.foot) if r.random() < 0.3]
        r.shuffle(before)
        if r.random() < 0.12:  # a table as the frame of the page
            side = r.choice((self.bar(), "<br>".join(f'<a href="/{k}">{self.words(1, 2)}</a>' for k in range(r.randint(2, 6)))))
            inside = f"{''.join(before)}<table><tr><td>{side}</td><td>{core}</td></tr></table>{''.join(after)}"
        else:
            for _ in range(r.choice((0, 0, 1, 2))):  # boxes around the main part alone
                tag = r.choice(("div", "section", "div"))
                core = f"<{tag}{self.plain()}>{core}</{tag}>"
            inside = f"{''.join(before)}{core}{''.join(after)}"
        for _ in range(r.choice((0, 0, 1, 2))):  # and around everything
            inside = f"<div{r.choice((self.plain(), ' ' + self.cls(r.choice(('main', 'head', 'side', 'menu')))))}>{inside}</div>"
        marks = " ".join(r.choice(HINTS[r.choice(list(HINTS))].split()) for _ in range(r.randint(1, 4)))
        start = r.choice(("<body>", "<body>", f'<body class="{marks}">', f'<body class="has-{marks}">'))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head>{start}{inside}</body></html>", "\n".join(lines)


def made_pages(n: int = 1200, seed: int = 11) -> list[tuple[str, str]]:
    """Labelled pages from the patterns; n is the bound of the training sample."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(made_pages())


_OUT = "text string, n_chars long"


def main_text(pages: DataFrame, model: Field | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every page: one narrow pass; the field's
    size is fixed by its feature names."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_field())
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [own.text(h or "") for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, f"{schema}, {_OUT}")
