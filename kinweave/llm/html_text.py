"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

A tolerant tokenizer builds the tree of block elements. Each node is described by its tag,
attribute tokens, depth, siblings, and the text, link and tag density of its subtree; boosted
trees give the probability that it belongs to the article. Decoding picks the likeliest labelling in which nothing is
kept below a dropped node. The model is trained at first use on a bounded number of pages that a
seeded generator writes from varied templates, so every node's label is known."""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.boosting import Boosted
from kinweave.llm.common import fresh, map_texts

#: Pages the generator writes for training, and for the held-out test.
TRAIN_PAGES = 400

# Element kinds of the public HTML standard, and common attribute words.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select".split())
BLOCK = frozenset(
    "html head body article section main aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset figure figcaption blockquote pre address details summary hr dialog center hgroup menu search option".split()
)
CLOSES_P = BLOCK - {"option"}
GROUPS = (
    ("article", "main"),
    ("nav", "menu"),
    ("header",),
    ("footer",),
    ("aside",),
    ("form", "fieldset", "dialog", "search", "button", "label", "select", "option"),
    ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("ul", "ol", "dl"),
    ("li", "dt", "dd"),
    ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"),
    ("div", "section", "center"),
    ("head",),
)
GOOD_WORDS = frozenset("article body content entry main post story text page hentry prose".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navigation navbar menu breadcrumb breadcrumbs header masthead footer copyright sidebar aside widget "
    "related recommended share social cookie consent notice alert popup modal gdpr newsletter subscribe signup login search form comment comments reply replies disqus respond tags pagination".split()
)
_STOP = re.compile("[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/>])|display\s*:\s*none", re.I)
_WORD = re.compile("[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Tags:
    """Finds where the tags of a page end, each character being passed a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.quotes = source, {'"', "'"}

    def end(self, at: int) -> int:
        """Behind the `>` of the tag that begins at `at`; -1 if there is none. A `>` in a value in quotes doesn't end a tag."""
        here = at
        while m := _STOP.search(self.source, here):
            if m[0] == ">":
                return m.end()
            here = m.end()
            if m[0] in self.quotes and self.source[max(at, m.start() - 64) : m.start()].rstrip().endswith("="):
                close = self.source.find(m[0], here)
                if close < 0:
                    # Neither does a later quote of this kind close.
                    self.quotes.discard(m[0])
                else:
                    here = close + 1
        # The quotes went on to the end of the page: from here on they are characters like others.
        self.quotes.clear()
        return self.source.find(">", at) + 1 or -1


class Page:
    """The block elements of a page as parallel lists, parents first, and its text blocks (node, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.hidden = ["html"], [-1], [()], [False]
        self.own, self.links, self.inline = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        open_nodes, held, linked, at, body = [0], [], 0, 0, None
        source = source.removeprefix("\ufeff")
        tags, opened = Tags(source), Counter()

        def add(name: str, words: tuple = (), hidden: bool = False) -> None:
            self.tag.append(name)
            self.parent.append(open_nodes[-1])
            self.words.append(words)
            self.hidden.append(hidden)
            for column in (self.own, self.links, self.inline):
                column.append(0)
            open_nodes.append(len(self.tag) - 1)
            opened[name] += 1

        def close() -> str:
            name = self.tag[open_nodes.pop()]
            opened[name] -= 1
            return name

        def say(text: str) -> None:
            held.append(text)
            if linked and text.strip():
                self.links[here()] += len(text.strip())

        def here() -> int:
            """The node that text belongs to; text directly under the root is the body's."""
            nonlocal body
            if open_nodes[-1]:
                return open_nodes[-1]
            if body is None:
                add("body")
                body = open_nodes[-1]
            return body

        def flush() -> None:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                node = here()
                self.blocks.append((node, text))
                self.own[node] += len(text)

        while at < len(source):
            start = source.find("<", at)
            if start != at:
                say(source[at : start if start >= 0 else len(source)])
                if start < 0:
                    break
            second = source[start + 1 : start + 2]
            if second and second in "!?":
                mark = "-->" if source.startswith("<!--", start) else ">"
                at = source.find(mark, start + len(mark) + 1)
                if at < 0:
                    break
                at += len(mark)
                continue
            if not _NAME.match(source, start + 1 + (second == "/")):
                say("<")
                at = start + 1
                continue
            at = tags.end(start)
            if at < 0:
                # No tag ends any more.
                say(source[start:])
                break
            token = source[start:at]
            closing = token[1] == "/"
            name = _NAME.match(token, 1 + closing)[0].lower()
            if name in BLOCK:
                flush()
                linked = 0
                if closing:
                    # An end tag closes up to its own start; without one it closes nothing.
                    while opened[name] and close() != name:
                        pass
                    continue
                top = self.tag[open_nodes[-1]]
                if top == "p" or (top == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")) or (top in ("td", "th") and name in ("td", "th")) or (top == "head" and name == "body"):
                    close()
                if name in ("html", "hr") or (name == "body" and opened["body"]):
                    continue
                words = tuple(w for a in _ATTR.findall(token) for w in _WORD.findall("".join(a).lower())) if "=" in token else ()
                add(name, words, bool(_HIDDEN.search(token)))
                if name == "body" and body is None:
                    body = open_nodes[-1]
            elif name in RAW:
                if not closing and not token.endswith("/>"):
                    # Contents aren't markup: they go on to the end tag, or to the end of the page.
                    end = _RAW_END[name].search(source, at)
                    at = end.end() if end else len(source)
            elif name == "br":
                flush()
            else:
                self.inline[open_nodes[-1]] += 1
                if name == "a":
                    linked = 0 if closing else 1
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        depth, order, children = np.zeros(n), np.zeros(n), np.zeros(n)
        text, links, tags, paragraphs = (np.array(x, float) for x in (self.own, self.links, self.inline, [t == "p" for t in self.tag]))
        tags += 1
        good, bad = np.zeros(n), np.zeros(n)
        group = np.zeros((n, len(GROUPS)))
        for i, (t, w) in enumerate(zip(self.tag, self.words)):
            if t in _GROUP_OF:
                group[i, _GROUP_OF[t]] = 1
            good[i], bad[i] = sum(x in GOOD_WORDS for x in w), sum(x in BAD_WORDS for x in w) + 2 * self.hidden[i]
        above = np.zeros((n, 4))
        for i in range(1, n):
            p = parent[i]
            depth[i], order[i] = depth[p] + 1, children[p]
            children[p] += 1
            above[i] = np.maximum(above[p], (group[p, 0], group[p, 1:6].max(), good[p] > 0, bad[p] > 0))
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            links[p] += links[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
        own = np.array(self.own, float)
        total = max(text[0], 1)
        siblings = np.where(parent >= 0, children[parent], 1)
        rest = np.stack([depth, order, siblings, children, np.log1p(own), np.log1p(text), text / total, text / tags, links / np.maximum(text, 1), paragraphs, good, bad], axis=1)
        return np.concatenate([group, above, rest], axis=1)

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The likeliest labels in which no node is kept below a dropped one; the root is kept."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = np.log(p), np.log(1 - p)
        for i in range(len(p) - 1, 0, -1):
            keep[self.parent[i]] += max(keep[i], drop[i])
            drop[self.parent[i]] += drop[i]
        out = np.zeros(len(p), bool)
        out[0] = True
        for i in range(1, len(p)):
            out[i] = out[self.parent[i]] and keep[i] > drop[i]
        return out

    def text(self, kept: np.ndarray) -> str:
        return "\n".join(t for i, t in self.blocks if i and kept[i])


_GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g}


def generate(rng: random.Random) -> tuple[str, str]:
    """A page from a random template, and its main text."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"
    attr = lambda words: rng.choice(['class="{}"', 'id="{}"', 'class="x-{} box"']).format(rng.choice(words))
    paragraph = lambda: f"<p>{phrase(3, 60)}</p>"
    noise = [
        lambda: f"<nav>{links()}</nav>",
        lambda: f"<div {attr(['menu', 'navbar', 'nav', 'breadcrumbs'])}>{links()}</div>",
        lambda: f"<header>{rng.choice([f'<h1>{phrase(1, 4)}</h1>', link()])}<p>{phrase(2, 8)}</p></header>",
        lambda: f"<footer><p>&copy; {phrase(3, 20)}</p></footer>",
        lambda: f"<footer>&copy; {phrase(3, 20)}</footer>",
        lambda: f"<div {attr(['footer', 'copyright'])}>{phrase(3, 20)}</div>",
        lambda: f"<aside><h3>{phrase(1, 3)}</h3>{rng.choice([links, paragraph])()}</aside>",
        lambda: f"<div {attr(['sidebar', 'widget', 'related'])}><h3>{phrase(1, 3)}</h3>{rng.choice([links, paragraph])()}</div>",
        lambda: f"<div {attr(['ad', 'ads', 'advert', 'banner', 'sponsored', 'promo'])}>{rng.choice([phrase(3, 25), paragraph()])}</div>",
        lambda: f"<div {attr(['cookie', 'consent', 'notice', 'alert', 'popup'])}><p>{phrase(4, 25)}</p></div>",
        lambda: f"<form><label>{phrase(1, 3)}</label><input><p>{phrase(2, 12)}</p><button>{word()}</button></form>",
        lambda: f"<div {attr(['newsletter', 'subscribe', 'share', 'social'])}>{phrase(2, 12)}</div>",
        lambda: f"<section {attr(['comments', 'replies'])}><h2>{word()}</h2>" + "".join(f"<div {attr(['comment', 'reply'])}><p>{phrase(3, 50)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>",
        lambda: f"<ol {attr(['comments', 'replies'])}>" + "".join(f'<li class="comment"><p>{phrase(3, 50)}</p></li>' for _ in range(rng.randint(1, 5))) + "</ol>",
    ]
    parts, text = [], []
    if rng.random() < 0.8:
        h = phrase(2, 9)
        parts.append(f"<h1>{h}</h1>")
        text.append(h)
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.12:
            parts.append(rng.choice(noise)())
            continue
        t = phrase(3, 90) if kind < 0.8 else phrase(1, 6)
        text.append(t)
        parts.append(
            f"<p>{t}</p>" if kind < 0.6 else f"<p><b>{t}<br>" if kind < 0.66 else f"<p>{t}" if kind < 0.72 else f"<blockquote><p>{t}</p></blockquote>" if kind < 0.8
            else f"<h2>{t}</h2>" if kind < 0.88 else f"<ul><li>{t}</li></ul>" if kind < 0.94 else f"<table><tr><td>{t}</td></tr></table>"
        )
    body = "".join(parts)
    body = rng.choice(
        [f"<article>{body}</article>", f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>", f"<div {attr(sorted(GOOD_WORDS))}>{body}</div>", f'<div role="main"><section>{body}</section></div>']
    )
    before, after = ("".join(rng.choice(noise)() for _ in range(rng.randint(0, 4))) for _ in range(2))
    if rng.random() < 0.3:
        before, after = f'<div class="wrap">{before}', f"{after}</div>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title><script>x('</p>')</script></head><body>{before}{body}{after}</body></html>", "\n".join(text)


def labels_of(page: Page, text: str) -> np.ndarray:
    """1 for nodes whose subtree holds main text (matched in order), 0 for others."""
    wanted, out, at = text.split("\n"), np.zeros(len(page.tag)), 0
    for node, t in page.blocks:
        if at < len(wanted) and t == wanted[at]:
            at += 1
            while node >= 0 and not out[node]:
                out[node] = 1
                node = page.parent[node]
    return out


@functools.lru_cache(1)
def model(seed: int = 5, pages: int = TRAIN_PAGES) -> Boosted:
    rng = random.Random(seed)
    made = [generate(rng) for _ in range(pages)]
    parsed = [Page(source) for source, _ in made]
    x = np.concatenate([p.features() for p in parsed])
    y = np.concatenate([labels_of(p, t) for p, (_, t) in zip(parsed, made)])
    return Boosted().fit(x, y)


def extract_all(sources: list[str | None], boosted: Boosted) -> list[str]:
    """The main text of each page; null is empty."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    scores = boosted.predict(np.concatenate([p.features() for p in pages]))
    cuts = np.cumsum([len(p.tag) for p in pages])[:-1]
    return [p.text(p.decode(s)) for p, s in zip(pages, np.split(scores, cuts))]


def extract(pages: DataFrame, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append text and n_chars (names that clash get a trailing _).

    Null, empty and text-free pages have an empty text. Rows pass through one to one,
    repeated rows too; long pages are read whole; an empty table stays empty. The model has a fixed
    size and is sent to all tasks."""
    keep = pages.columns if keep is None else keep
    text, n_chars = fresh(keep, "text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def kernel():
        return lambda sources: [extract_all(sources, shared.value)]

    out = map_texts(pages, source, [T.StructField(text, T.StringType())], kernel, keep)
    return out.withColumn(n_chars, F.char_length(text).cast("long"))
