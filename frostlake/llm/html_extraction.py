"""Main text of web pages: a linear-chain conditional random field over the pages' leaf blocks.

Features of a block are the elements it stands in (tags, and words of their classes, ids and roles) and its text
(length, links, punctuation, capitals, telling words), all of it. Neighbouring labels have weights of their own: where
the markup tells nothing, a short line belongs to what stands around it. The model is trained on labelled
pages, by default those of `training_pages`, which vary how sites mark up the same parts, or leave them
unmarked; pages are decoded by Viterbi.

Defined cases: a null or empty page, and one without article, has an empty text; unclosed and stray tags are read
as browsers do, at any depth of nesting in time that grows with the page's length; white space inside a block (also what references decode to) becomes one space; repeated
identifiers are rows of their own; an empty table gives no rows; further columns are left alone, whatever their
names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.llm.common import text_of
from frostlake.llm.html_blocks import Block, Element, blocks

EPOCHS = 160
RATE = 0.1
DECAY = 2e-6
TRAINING_PAGES = 900

#: Words, in the languages at hand, that menus, notices and the like are full of.
_TELLING = re.compile(r"\b(cookies?|subscribe|newsletter|sign up|log ?in|copyright|all rights reserved|privacy|terms|advertisement|sponsored|read more|share|comments?|repl(?:y|ies)|posted by|related|menu|search|home|contact|licen[sc]e|follow us)\b|[©®·»›|]", re.I)

#: What sites call the parts of a page, in classes, ids and roles, and the elements made for them.
GROUPS = {
    "article": "article post entry story content main text body articlebody prose",
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs toc pager pagination",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer foot colophon copyright legal bottom contentinfo",
    "side": "aside sidebar side widget widgets rail secondary related recommended recommendations trending popular complementary more",
    "ad": "ad ads advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promoted promotion promotions dfp outbrain taboola",
    "notice": "cookie cookies notice notices alert consent gdpr popup modal newsletter subscribe warning message notification overlay dialog alertdialog note status disclaimer paywall toast ~hidden",
    "form": "form search signup login contact subscribe-form button input select label fieldset legend",
    "comments": "comment comments commentlist disqus responses response reply replies discussion feedback reader respond",
    "share": "share social sharing follow tags tools meta byline author toolbar",
}
_GROUP = {name: group for group, names in GROUPS.items() for name in names.split()}


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # (features + 1, 2); the last row is the bias
    moves: np.ndarray  # (2, 2), from label to label
    opening: np.ndarray


def _group(element: Element) -> str | None:
    """The part of a page that the element's names, or its kind, tell of."""
    if element.tag == "body":
        return None
    named = [_GROUP[m] for m in element.marks if m in _GROUP]
    return next((g for g in named if g != "article"), None) or _GROUP.get(element.tag) or (named[0] if named else None)


_OUTER = frozenset(("article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "ul", "ol", "table"))
_NOWHERE: tuple = (frozenset(), (), ())


def _held(element: Element | None, known: dict[str, int] | None) -> tuple[frozenset, tuple, tuple]:
    """What a block has of the elements around it: features of all of them, the last three parts and the last two outer
    kinds. Worked out once an element from its parent's; features that the model does not know are
    left out, so that sets stay small however deep a page is."""
    chain = []
    while element is not None and element.held is None:
        chain.append(element)
        element = element.parent
    held = _NOWHERE if element is None else element.held
    for e in reversed(chain):
        found, near, outer = held
        group = _group(e)
        names = ["in:" + e.tag, *["mark:" + m for m in e.marks], *(["group:" + group] if group else [])]
        new = [f for f in names if f not in found and (known is None or f in known)]
        held = e.held = (found.union(new) if new else found, (*near, group)[-3:] if group else near, (*outer, e.tag)[-2:] if e.tag in _OUTER else outer)
    return held


def _path_features(element: Element | None, known: dict[str, int] | None) -> list[str]:
    found, near, outer = _held(element, known)
    out = [*found, "near:" + (near[-1] if near else "none"), "path:" + ">".join(near)]
    if element is not None:
        out += ["at:" + element.tag, "in2:" + ">".join(outer), *["own:" + m for m in element.marks]]
    return out


def _text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    out = ["words:%d" % min(7, words.bit_length()), "links:%d" % min(4, 4 * block.linked // max(1, n))]
    out.append("stops:%d" % min(4, sum(map(text.count, ".!?"))))
    if text[-1] in ".!?…\"”'":
        out.append("ends")
    if text[0].isupper():
        out.append("capital")
    digits = sum(map(text.count, "0123456789"))
    if digits:
        out.append("digits:%d" % min(3, 20 * digits // n))
    found = len(_TELLING.findall(text))
    if found:
        # In a long text a few such words tell little.
        out.append("telling:%d" % min(3, found) + ":short" if words < 12 else "telling:%d" % min(3, 60 * found // words))
    return out


def features(page: list[Block], known: dict[str, int] | None = None) -> list[list[str]]:
    """Of every block; with known only features of elements that are in it."""
    n = len(page)
    return [[*_path_features(b.element, known), *_text_features(b), "place:%d" % (3 * i // n)] for i, b in enumerate(page)]


def _indexed(rows: list[list[str]], index: dict[str, int]) -> list[list[int]]:
    bias = len(index)
    return [[*[index[f] for f in row if f in index], bias] for row in rows]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS) -> Model:
    """(features of blocks, labels) of pages: maximum likelihood with decay, all pages at once, by Adam."""
    seen: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    pages = [p for p in pages if p[0]]
    size, longest = len(pages), max(len(p[0]) for p in pages)
    flat, first, place, gold = [], [0], [], []
    for k, (rows, labels) in enumerate(pages):
        for i, row in enumerate(_indexed(rows, index)):
            flat += row
            first.append(len(flat))
            place.append((k, i))
            gold.append(labels[i])
    flat_a, first_a, where, gold_a = np.array(flat), np.array(first), tuple(np.array(place).T), np.array(gold)
    owner = np.repeat(np.arange(len(gold_a)), np.diff(first_a))
    live = np.zeros((size, longest), bool)
    live[where] = True
    label = np.zeros((size, longest), int)
    label[where] = gold_a
    shapes = [(len(index) + 1, 2), (2, 2), (2,)]
    params = [np.zeros(s) for s in shapes]
    m1, m2 = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, epochs + 1):
        w, moves, opening = params
        own = np.stack([np.bincount(owner, w[flat_a, c], len(gold_a)) for c in (0, 1)], axis=1)
        u = np.zeros((size, longest, 2))
        u[where] = own
        ahead = np.zeros_like(u)
        ahead[:, 0] = u[:, 0] + opening
        for i in range(1, longest):
            new = _logsum(ahead[:, i - 1, :, None] + moves[None], 1) + u[:, i]
            ahead[:, i] = np.where(live[:, i, None], new, ahead[:, i - 1])
        total = _logsum(ahead[:, -1], 1)
        back = np.zeros_like(u)
        pair = np.zeros((2, 2))
        for i in range(longest - 1, 0, -1):
            both = moves[None] + (u[:, i] + back[:, i])[:, None, :]
            joint = np.exp(ahead[:, i - 1, :, None] + both - total[:, None, None])
            pair += joint[live[:, i]].sum(axis=0)
            back[:, i - 1] = np.where(live[:, i, None], _logsum(both, 2), 0.0)
        p = np.exp(ahead + back - total[:, None, None])
        err = p[where].copy()
        err[np.arange(len(gold_a)), gold_a] -= 1
        g_w = np.stack([np.bincount(flat_a, np.repeat(err[:, c], np.diff(first_a)), len(index) + 1) for c in (0, 1)], axis=1)
        told = np.zeros((2, 2))
        follows = live[:, 1:]
        np.add.at(told, (label[:, :-1][follows], label[:, 1:][follows]), 1)
        g_open = p[:, 0].sum(axis=0) - np.bincount(label[:, 0], minlength=2)
        for j, g in enumerate((g_w, pair - told, g_open)):
            g = g / size + DECAY * params[j] * longest
            m1[j] = 0.9 * m1[j] + 0.1 * g
            m2[j] = 0.99 * m2[j] + 0.01 * g * g
            params[j] = params[j] - RATE * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.99**step)) + 1e-8)
    return Model(index, *params)


def decode(model: Model, rows: list[list[str]]) -> list[int]:
    """The likeliest labels of a page's blocks, by Viterbi."""
    if not rows:
        return []
    index, w, bias = model.index, model.weights, model.weights[-1]
    (m00, m01), (m10, m11) = model.moves.tolist()
    a, b = model.opening.tolist()
    came: list[tuple[int, int]] = []
    for i, row in enumerate(rows):
        u0, u1 = (w[[index[f] for f in row if f in index]].sum(axis=0) + bias).tolist()
        if i == 0:
            a, b = a + u0, b + u1
            continue
        to0, to1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 > b + m11 else 1)
        a, b = max(a + m00, b + m10) + u0, max(a + m01, b + m11) + u1
        came.append((to0, to1))
    out = [0 if a > b else 1]
    for step in reversed(came):
        out.append(step[out[-1]])
    return out[::-1]


def extract(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, y in zip(found, decode(model, features(found, model.index)), strict=True) if y)


# Labelled pages ------------------------------------------------------------------------------------------------


def training_pages(n: int = TRAINING_PAGES, seed: int = 5, unmarked: float = 0.15) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of the article's blocks) of invented pages: the same parts under the names, elements and orders
    that sites give them. Article and surroundings are made of the same words, so that only markup, place and
    shape tell them apart. A share of the pages, unmarked, has nothing but equal elements without names: lines of
    a menu, an article of long paragraphs with such lines in it, and lines of a footer."""
    r = random.Random(seed)
    syllables = "ka lo mi ter en ra sto vel du por an ish ge lu bra co nes ti mon ba re lis ou fa".split()
    vocabulary = ["".join(r.choices(syllables, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(900)]

    def words(low: int, high: int) -> str:
        return " ".join(r.choices(vocabulary, k=r.randint(low, high)))

    def sentence(low: int = 4, high: int = 16) -> str:
        return words(low, high).capitalize() + r.choice(("." * 6 + "?!"))

    def prose(low: int = 1, high: int = 6) -> str:
        """Sentences; now and then what real texts hold too, anywhere on a page: capitals, marks, lists in a line, numbers,
        addresses, licence lines, single words, no full stop."""
        text = " ".join(sentence() for _ in range(r.randint(low, high)))
        kind = r.random()
        if kind < 0.05:
            return text.upper().replace(" ", "!! ")
        if kind < 0.09:
            return text.replace(" ", " | ")
        if kind < 0.13:
            return "".join(w + r.choice(("*** ", "%%% ", "### ")) for w in text.split())
        if kind < 0.17:
            return " ".join([vocabulary[r.randrange(900)].capitalize()] * r.randint(3, 40))
        if kind < 0.24:
            return r.choice((words(1, 1).capitalize() + ".", words(1, 3), words(1, 2).capitalize()))
        if kind < 0.30:
            return f"{words(2, 9)} {r.choice(('+1 (555) 010-7777', 'a.b@mail.example.com', '10.2.3.4', '4111111111111111', 'Licensed under the terms.', 'Copyright 2020, all rights reserved.', 'Read more.', 'Contact us.'))} {words(1, 9)}"
        return text[:-1] if kind < 0.36 else text

    def inline(text: str) -> str:
        if r.random() < 0.3:
            bits = text.split(" ")
            i = r.randrange(len(bits))
            tag = r.choice(("b", "i", "em", "strong", "span", "code", 'a href="/x"'))
            bits[i] = f"<{tag}>{bits[i]}" + ("" if tag in ("b", "i") and r.random() < 0.2 else f"</{tag.split()[0]}>")
            text = " ".join(bits)
        return text.replace(" ", r.choice((" ", " ", "\n  ", " &amp; ")), 1) if r.random() < 0.1 else text

    def links(low: int, high: int, wrap: str = "ul") -> str:
        items = [f'<a href="/{r.randrange(99)}">{words(1, 3).capitalize()}</a>' for _ in range(r.randint(low, high))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if wrap == "ul" else r.choice((" | ", " ", " &middot; ")).join(items)

    def box(names: str, inner: str, tags: str = "div section aside") -> str:
        name, tag = r.choice(names.split()), r.choice(tags.split())
        mark = r.choice((f'class="{name}"', f'id="{name}"', f'class="box {name} wide"', f"class='{name}-{r.choice(('box', 'wrap', 'inner', 'area'))}'"))
        return f"<{tag} {mark}>{inner}</{tag}>"

    def para(texts: int = 2) -> str:
        return "".join(f"<p>{prose(1, 3)}</p>" for _ in range(r.randint(1, texts))) if r.random() < 0.6 else prose(1, 2)

    part: dict[str, Callable[[], str]] = {
        "menu": lambda: r.choice((f"<nav>{links(3, 8, r.choice(('ul', '')))}</nav>", box("menu nav navbar navigation topnav breadcrumb breadcrumbs", links(3, 8), "div ul nav"), f'<div role="navigation">{links(3, 7)}</div>')),
        "header": lambda: r.choice((f"<header><h1>{words(1, 3)}</h1><p>{sentence(2, 6)}</p></header>", f'<header class="site-header"><a href="/">{words(1, 2)}</a><p>{sentence(2, 8)}</p></header>', box("header masthead banner topbar site-title", f"<h2>{words(1, 3)}</h2><p>{sentence(2, 8)}</p>", "div header"), f"<header>{words(1, 4)}</header>")),
        "footer": lambda: r.choice((f"<footer>&copy; {words(1, 3)} &middot; {sentence()}</footer>", f"<footer><p>{prose(1, 2)}</p>{links(2, 5, r.choice(('ul', '')))}</footer>", box("footer foot copyright colophon bottom legal", f"<p>{r.choice(('&copy; 2024 ', 'Copyright ', ''))}{prose(1, 2)}</p>", "div footer section"))),
        "aside": lambda: r.choice((f"<aside>{para()}</aside>", box("sidebar side widget widgets rail secondary related recommended trending", f"<h3>{words(1, 3)}</h3>{links(2, 6) if r.random() < 0.5 else para()}"), f'<div role="complementary"><p>{prose(1, 2)}</p></div>')),
        "ad": lambda: r.choice((box("ad ads advert advertisement sponsor sponsored promo promotion adsense dfp", r.choice((prose(1, 2), f"<p>{prose(1, 2)}</p>", f'<a href="/buy">{sentence()}</a>'))), f'<ins class="adsbygoogle">{prose(1, 2)}</ins>')),
        "notice": lambda: r.choice((box("cookie cookies notice alert consent gdpr banner popup modal newsletter warning message notification overlay", f"<p>{r.choice(('We use cookies. ', 'Subscribe to our newsletter. ', '', ''))}{prose(1, 2)}</p>" + ("<button>OK</button>" if r.random() < 0.5 else "")), f'<div role="{r.choice(("alert", "dialog", "alertdialog", "note", "status"))}">{prose(1, 2)}</div>', f'<div style="display:none">{prose(1, 2)}</div>', f"<dialog>{prose(1, 2)}</dialog>")),
        "form": lambda: r.choice((f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>', f'<form class="{r.choice(("search", "signup", "login", "contact"))}"><p>{sentence()}</p><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button type="submit">{words(1, 2)}</button></form>', f"<form><fieldset><legend>{words(1, 3)}</legend><p>{prose(1, 2)}</p></fieldset></form>")),
        "comments": lambda: (lambda name, tag, item: f'<{tag} {r.choice(("class", "id"))}="{name}">' + (f"<h{r.choice('234')}>{r.choice(('Comments', words(1, 3)))}</h3>" if r.random() < 0.6 else "") + "".join(f'<{item} class="{r.choice(("comment", "comment-body", "reply", "response"))}"><b>{words(1, 2)}</b> {r.choice(("", "<br>"))}<p>{prose(1, 4)}</p></{item}>' if r.random() < 0.6 else f"<{item}><p>{prose(1, 4)}</p></{item}>" for _ in range(r.randint(1, 5))) + f"</{tag}>")(r.choice(("comments", "commentlist", "disqus_thread", "responses", "discussion", "replies", "user-comments", "comment-section", "reader-comments", "feedback")), r.choice(("div", "section", "ol", "aside", "article")), r.choice(("div", "li", "article", "p"))),
        "share": lambda: box("share social sharing follow tags tools meta byline author", r.choice((links(2, 4, ""), words(2, 5))), "div p ul span"),
    }
    for _ in range(n):
        content: set[str] = set()

        def say(text: str) -> str:
            content.add(" ".join(text.split()))
            return text

        if r.random() < unmarked:
            tag = r.choice(("div", "p", "td"))
            line = lambda: words(1, 4).capitalize()
            lines = [line() for _ in range(r.randint(0, 9))]
            for _ in range(r.randint(2, 6)):
                lines += [say(" ".join(sentence(6, 18) for _ in range(r.randint(3, 7)))), *[say(line()) for _ in range(r.choice((0, 0, 1, 2)))]]
            lines.append(say(" ".join(sentence(6, 18) for _ in range(4))))
            lines += [line() for _ in range(r.randint(0, 9))]
            yield f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(f'<{tag}>{x}</{tag}>' for x in lines)}</body></html>", content
            continue
        body: list[str] = []
        if r.random() < 0.85:
            title = say(words(3, 9).capitalize())
            head = f"<h{r.choice('1112')}>"
            body.append(f"{head}{title}</{head[1:]}" if r.random() < 0.8 else f"<header>{head}{title}</{head[1:]}{part['share']() if r.random() < 0.5 else ''}</header>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.66:
                tag = r.choice(("p", "p", "p", "p", "div"))
                body.append(f"<{tag}>{inline(say(prose(1, 7)))}" + (f"</{tag}>" if tag == "div" or r.random() < 0.85 else "<br>"))
            elif kind < 0.74:
                body.append(f"<h{r.choice('234')}>{say(words(1, 6).capitalize())}</h3>")
            elif kind < 0.82:
                tag = r.choice(("ul", "ol"))
                body.append(f"<{tag}>" + "".join(f"<li>{say(sentence(3, 14))}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.86:
                body.append(f"<blockquote>{say(prose(1, 2))}</blockquote>")
            elif kind < 0.89:
                body.append(f"<figure><img src='x.png'><figcaption>{say(sentence(3, 10))}</figcaption></figure>")
            elif kind < 0.92:
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{say(words(1, 4) + ' ' + str(r.randrange(10**6)))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.94:
                body.append(f"<pre>{say(words(3, 12))}</pre>")
            else:
                body.append(part[r.choice(("ad", "notice", "share", "form", "aside"))]())
        text = "\n".join(body) if r.random() < 0.5 else "".join(body)
        wrap = r.choice(("article", "article", "article", "main", "div class", "div class", "div id", "plain", "main>article", "section"))
        name = r.choice("content post entry article story main post-content entry-content article-body text body-text page-content".split())
        main = {"article": f"<article>{text}</article>", "main": f"<main>{text}</main>", "div class": f'<div class="{name}">{text}</div>', "div id": f'<div id="{name}">{text}</div>', "plain": f"<div>{text}</div>", "main>article": f'<main><article class="{name}">{text}</article></main>', "section": f'<section class="{name}">{text}</section>'}[wrap]
        before = [part[k]() for k in ("header", "menu", "notice", "ad", "form", "aside") if r.random() < 0.45]
        after = [part[k]() for k in ("share", "ad", "aside", "comments", "notice", "form", "menu") if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(part["footer"]())
        inner = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            inner = f'<div {r.choice(("id", "class"))}="{r.choice(("wrapper", "page", "container", "site"))}">{inner}</div>'
        if r.random() < 0.06:
            inner, content = "".join(before) + "".join(after), set()
        head = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        yield f"{head}<body>{inner}" + ("</body></html>" if r.random() < 0.9 else ""), content


@lru_cache(maxsize=2)
def default_model(n: int = TRAINING_PAGES) -> Model:
    pages = []
    for page, content in training_pages(n):
        found = blocks(page)
        pages.append((features(found), [int(b.text.replace(" & ", " ") in content or b.text in content) for b in found]))
    return train(pages)


def main_text(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    held = df.sparkSession.sparkContext.broadcast(model or default_model())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(page.as_py(), held.value) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string())], names=["id", "url", "text"])

    source = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    got = source.mapInArrow(rows, source.select("id", "url").schema.add("text", "string"))
    return got.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
