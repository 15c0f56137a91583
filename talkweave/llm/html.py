"""Main text of web pages: flat text blocks, their words and link density and those of their
neighbours, and a decision tree that is grown from a small labelled table.

Menus, asides, footers, controls, reader comments and lists of related pages are left out by what
their elements say; the tree judges every other block. What class names hint at is one feature of
it among others, and an article or main element overrules the hints around it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from talkweave.llm.common import ship

#: Elements whose content is no text of the page: code, inert or alternative content, and controls.
RAW = frozenset({"script", "style", "textarea", "title", "iframe", "xmp", "template", "select"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new element of the same group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
BLOCKS_THAT_END_P = BLOCK - {"body", "html", "head"}
#: Elements whose blocks belong together.
BOX = frozenset("article aside body center dialog div fieldset footer form header main nav section td th".split())
#: Elements beside the article wherever they stand; a header only outside of one, a form unless one is in it.
APART = frozenset({"nav", "footer", "aside", "dialog", "menu", "button"})
#: Words in class, id or role that hint at something beside the article; article and main overrule them.
HINTS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies "
    "consent gdpr notice notices alert newsletter subscribe signup share sharing social breadcrumb breadcrumbs pagination pager copyright login search "
    "popup modal overlay toolbar widget skip complementary contentinfo".split()
)
#: Words of what readers wrote or could read next; an article in it is no main text either.
READERS = frozenset("comment comments reply replies respond disqus related recommended".split())
#: Words of a class that says how a whole page is built, and not what it holds.
STATES = frozenset("no not has with without is hide show wrap wrapper container layout page site open closed enabled disabled on off".split())
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())
HEADS = frozenset("article post entry story".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
ITEMS = frozenset({"li", "td", "th", "dt", "dd"})
NOTICE = re.compile(r"©|\(c\)|rights reserved|cookies", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "box_links", "box_share", "hinted", "inside", "elsewhere", "heading", "item", "sentence", "notice",
)


class Block:
    __slots__ = ("parts", "linked", "tag", "apart", "inside", "label", "box", "text", "words", "density")

    def __init__(self, tag, apart, inside, label, box):
        self.parts, self.linked, self.tag, self.apart, self.inside, self.label, self.box = [], 0, tag, apart, inside, label, box


class Place(NamedTuple):
    """An open element and where its text stands: apart is 0, 1 (hinted) or 2 (certain), inside is
    0, 1 (by a class) or 2 (article or main)."""

    name: str
    apart: int
    inside: int
    link: bool
    label: str | None
    box: int
    tag: str


def marked(found: dict[str, str]) -> tuple[int, bool, bool]:
    """What class, id and role say: apart (0 to 2), apart only as a header, and in the article."""
    apart, head, inside = 0, False, False
    for k in ("class", "id", "role"):
        for token in (found.get(k) or "").split():
            words = {w.lower() for w in WORDS.findall(token)}
            if words & STATES:
                continue
            if words & READERS:
                apart = 2
            elif hit := words & HINTS:
                if hit != {"header"}:
                    apart = max(apart, 1)
                elif not words & HEADS:
                    head = True
            elif words & ARTICLE_WORDS:
                inside = True
    return apart, head, inside


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. A block ends where a block element begins or ends; line
    breaks and all other elements stay inside it."""
    out: list[Block] = []
    stack = [Place("", 0, 0, False, None, 0, "")]
    open_: Counter[str] = Counter()
    now: Block | None = None
    at, n, end_known, boxes = 0, len(page), True, 0

    def text(run: str) -> None:
        nonlocal now
        if "&" in run:
            run = unescape(run)
        here = stack[-1]
        if now is None:
            if not run or run.isspace():
                return
            now = Block(here.tag, here.apart, here.inside, here.label, here.box)
            out.append(now)
        now.parts.append(run)
        if here.link:
            now.linked += len(run.split())

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.name] -= 1
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        if not (after.isalpha() and after.isascii() or after == "/"):
            text("<")
            at = lt + 1
            continue
        if end_known:
            end_known = page.find(">", lt) >= 0
        m = TAG.match(page, lt) if end_known else None
        if m is None:
            stop = page.find(">", lt) if end_known else -1
            if stop < 0 or after == "/" and not page[lt + 2 : lt + 3].isalpha():
                if stop < 0:
                    text(page[lt:])
                at = n if stop < 0 else stop + 1
                continue
            name, closing, attributes, at = re.split(r"[\s/>]", page[lt + 1 + (after == "/") : stop + 1], maxsplit=1)[0].lower(), after == "/", "", stop + 1
        else:
            closing, name, attributes, at = m[1] == "/", m[2].lower(), m[3], m.end()
        if not closing and name in RAW:
            tail = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at) if not attributes.endswith("/") else None
            if tail:
                at = tail.end()
            elif name in ("script", "style", "textarea", "title", "xmp"):
                at = n if not attributes.endswith("/") or name in ("script", "style") else at
            continue
        if name == "br" or name == "wbr":
            if now is not None and name == "br":
                now.parts.append(" ")
            continue
        if name in BLOCK:
            now = None
        if closing:
            if open_[name] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close(k)
                        break
                    if name not in BLOCK and stack[k].name in BLOCK:
                        break  # an inline end tag does not end a block
            continue
        if name in VOID:
            continue
        over = ENDS.get(name, set()) | ({"p"} if name in BLOCKS_THAT_END_P else set())
        if any(open_[x] > 0 for x in over):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in over:
                    close(k)
                    break
                if stack[k].name in BLOCK and stack[k].name not in ("p", "li", "dt", "dd", "td", "th", "tr"):
                    break
        up = stack[-1]
        apart, inside, label, box = up.apart, up.inside, up.label, up.box
        if name in BLOCK or attributes:
            found = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
            hint, head, content = marked(found) if found and name not in ("html", "body") else (0, False, False)
            if name == "main" or name == "article" and apart < 2:
                apart = 0
            if name in APART:
                apart = 2
            elif name == "form" or (name == "header" or head) and not inside:
                apart = max(apart, 1)
            if name != "main":
                apart = max(apart, hint if name != "article" or hint == 2 else 0)
            if name in ("article", "main"):
                inside = 2
            elif content and name in ("div", "section", "td"):
                inside = max(inside, 1)
            label = found.get("data-keep", label)
        if name in BOX:
            boxes += 1
            box = boxes
        stack.append(Place(name, apart, inside, up.link or name == "a", label, box, name if name in BLOCK else up.tag))
        open_[name] += 1
    kept = []
    for b in out:
        words = "".join(b.parts).split()
        if words:
            b.text, b.words, b.density = " ".join(words), len(words), min(1.0, b.linked / len(words))
            kept.append(b)
    return kept


def table(found: list[Block], hints: bool = True) -> np.ndarray:
    """One row of features for each block. Where a block has no neighbour on a side, its own words
    and links stand for it, so that ends of pages are like their middles."""
    out = np.zeros((len(found), len(FEATURES)))
    words, linked = Counter(), Counter()
    for b in found:
        words[b.box] += b.words
        linked[b.box] += b.density * b.words
    most = max((words[b.box] for b in found if b.apart < 2), default=1)
    article = any(b.inside == 2 and not b.apart for b in found)
    for k, b in enumerate(found):
        before, after = found[max(k - 1, 0)], found[min(k + 1, len(found) - 1)]
        out[k] = (
            b.words, b.density, before.words, before.density, after.words, after.density, linked[b.box] / words[b.box], words[b.box] / most,
            hints and b.apart > 0, b.inside, article and b.inside < 2, b.tag in HEADINGS, b.tag in ITEMS, b.text[-1] in ".!?:;”\"')…", bool(NOTICE.search(b.text)),
        )
    return out


def chosen(found: list[Block], tree: Tree) -> list[Block]:
    """The blocks of the main text: of those that do not certainly stand beside it, the ones that the
    tree takes. A page of which nothing would be left is judged again without the hints of classes."""
    free = [k for k, b in enumerate(found) if b.apart < 2]
    for hints in (True, False):
        keep = tree.predict(table(found, hints)[free])
        if keep.any():
            break
    return [found[k] for k, y in zip(free, keep) if y]


#: The labelled table: layouts whose blocks say by data-keep whether they belong to the main text.
#: {l} is a paragraph, {s} a sentence, {w} a word or two, {a} and {b} a short and a long link.
LAYOUTS = (
    '<nav data-keep=0><ul><li>{a}<li>{a}<li>{a}</ul></nav><div class="ad" data-keep=0>{s}</div><article data-keep=1><h1>{w}</h1><p>{l}<p>{s}<p>{w}<p>{l}<ul><li>{w}<li>{s}</ul></article><footer data-keep=0>© {w}</footer>',
    '<div data-keep=0>{a} {a} {a}</div><article data-keep=1><h1>{w}</h1><p>{s}</p><p>{l}</p><p>{w}</p></article>',
    '<header data-keep=0><h1>{w}</h1><p>{s}</p></header><main data-keep=1><h2>{w}</h2><p>{l}</p><ul><li>{w}<li>{w}<li>{a}</ul><table><tr><td>{w}<td>{w}</table><blockquote>{s}</blockquote></main><aside data-keep=0><p>{l}</p><p>{s}</p></aside>',
    '<nav data-keep=0>{a} {a}</nav><main data-keep=1><p>{s}</p><p>{a}</p><p>{s}</p></main>',
    '<div id="menu" data-keep=0>{a} {a}</div><div class="content" data-keep=1><h1>{w}</h1><p>{l}</p><p>{b}</p><p>{l}</p><p>{w}</p></div><div class="sidebar" data-keep=0><h3>{w}</h3><p>{l}</p></div><div id="comments" data-keep=0><p>{l}</p><p>{s}</p></div>',
    '<p data-keep=0>{a} | {a}</p><h1 data-keep=1>{w}</h1><p data-keep=1>{l}</p><p data-keep=1>{s}</p><p data-keep=1>{l} {l}</p><p data-keep=0>{a} {a}</p><p data-keep=0>© {s}</p>',
    '<div class="cookie-notice" data-keep=0><p>{l}</p><button>OK</button></div><form data-keep=0><p>{w}</p><p>{l}</p></form><article data-keep=1><header><h1>{w}</h1></header><p>{l}</p><pre>{w}</pre><p>{s}</p></article><section class="comments" data-keep=0><article class="comment"><p>{l}</p></article></section>',
    '<div data-keep=0>{a}</div><div data-keep=0>{a} {a}</div><div data-keep=1>{l}</div><div data-keep=1>{l} {s}</div><div data-keep=0>{a} {a}</div><div data-keep=0>© {w}</div>',
    '<ul data-keep=0><li>{a}<li>{b}<li>{b}</ul><h2 data-keep=1>{w}</h2><p data-keep=1>{l}</p><p data-keep=1>{l}</p><div class="newsletter" data-keep=0>{l}</div><div class="related" data-keep=0>{b} {b}</div>',
    '<div class="content-sidebar-wrap" data-keep=0><article data-keep=1><h1>{w}</h1><p>{l}</p><p>{s}</p></article><aside class="sidebar"><p>{l}</p><p>{a}</p></aside></div>',
    '<div id="page" class="site no-sidebar"><div data-keep=0>{a} {a} {a}</div><article data-keep=1><p>{s}</p><p>{s}</p><p>{l}</p><p>{s}</p></article></div>',
    '<table><tr><td data-keep=0>{a}<br>{a}<br>{a}<br>{a}<td data-keep=1><h1>{w}</h1><p>{l}<p>{s}<p>{l}<td data-keep=0>{b}<br>{b}</table>',
    '<article data-keep=1><h1>{w}</h1><p>{l}</p><p>{a}</p><ol><li>{b}<li>{b}<li>{a}</ol><blockquote>{s}</blockquote><p>{w}</p><pre>{w}</pre><div class="share" data-keep=0>{a} {a}</div><p>{w}</p></article>',
    '<form id="page-form"><div class="header" data-keep=0>{w} {a} {a}</div><article data-keep=1><h1>{w}</h1><p>{l}</p><p>{s}</p></article><div class="footer" data-keep=0>© {w}</div></form>',
    '<div class="site-nav" data-keep=0>{a} {a} {a}</div><div class="post" data-keep=1><div class="entry-header"><h1>{w}</h1><p>{w}</p></div><div class="entry-content"><p>{l}</p><p>{s}</p><h3>{w}</h3><p>{l}</p><p>{s}</p></div></div><div class="post-navigation" data-keep=0>{b} {b}</div><div id="respond" data-keep=0><h3>{w}</h3><p>{s}</p><p>{l}</p></div>',
    "<article data-keep=1><p>{s}</p></article>",
    "<p data-keep=1>{s}</p><p data-keep=1>{l}</p><p data-keep=1>{s}</p><p data-keep=1>{l}</p>",
    '<div data-keep=0>{a} {a} {a} {a}</div><div data-keep=0>{a} &gt; {a} &gt; {w}</div><div data-keep=1><h1>{w}</h1><p>{l}</p><p>{l}</p><p>{s}</p><p>{w}</p></div><div data-keep=0><h4>{w}</h4><ul><li>{b}<li>{b}<li>{b}</ul></div><div data-keep=0>© {s}</div>',
    '<aside data-keep=0><p>{l}</p><p>{l}</p></aside><section id="main" data-keep=1><h1>{w}</h1><p>{l}</p><p>{s}</p><p>{l}</p><ul><li>{s}<li>{s}</ul></section><div class="promo" data-keep=0><p>{l}</p></div>',
    '<div class="navbar" data-keep=0><ul><li>{a}<li>{a}</ul></div><main data-keep=1><h1>{w}</h1><dl><dt>{w}<dd>{s}<dt>{w}<dd>{l}</dl><table><tr><th>{w}<th>{w}<tr><td>{w}<td>{a}</table></main><footer data-keep=0><p>{l}</p><p>{s}</p><p>© {w}</p></footer>',
    '<nav data-keep=0><ul><li>{a}<ul><li>{a}<li>{a}</ul><li>{a}</ul></nav><main data-keep=1><h1>{w}</h1><p>{s}</p><pre>{l}</pre><h2>{w}</h2><p>{l}</p><p>{s}</p></main><div class="pager" data-keep=0>{a} {a}</div>',
    '<article data-keep=1><h1>{w}</h1><p>{l}</p><div class="advert" data-keep=0>{s}</div><p>{s}</p><aside data-keep=0><p>{l}</p></aside><p>{l}</p><form data-keep=0><p>{s}</p></form><footer data-keep=0><p>{s}</p></footer><section class="comments" data-keep=0><h2>{w}</h2><p>{s}</p><p>{l}</p></section></article>',
    '<div class="header" data-keep=0><h1>{w}</h1><p>{s}</p></div><div data-keep=1><h2>{w}</h2><p>{l}</p><p>{l}</p><p>{s}</p></div><ul data-keep=0><li>{a}<li>{a}<li>{a}</ul>',
    '<div class="menu" data-keep=0>{a} {a}</div><div data-keep=1><p>{l}</p><p>{s}</p><p>{l}</p></div><div class="widget" data-keep=0><h3>{w}</h3><p>{l}</p><p>{l}</p></div><div class="login" data-keep=0>{s}</div>',
    '<div data-keep=0>{w}</div><div data-keep=0>{a} {a} {a}</div><div data-keep=1><h1>{w}</h1><p>{l}</p><p>{s}</p><p>{l}</p><p>{w}</p></div><div data-keep=0><p>{w}</p></div><div data-keep=0>{w} {a}</div>',
    '<nav data-keep=0>{a}</nav><article data-keep=1><h1>{w}</h1><p>{l} © {w}</p><p>© {w}</p><p>Cookies {s}</p><p>{l}</p></article><div data-keep=0>© {w}</div>',
    '<div data-keep=0>{a} {a}</div><div class="content" data-keep=1><h1>{w}</h1><p>Cookies {l}</p><p>{s}</p><p>{l} All rights reserved</p></div><div data-keep=0>© {w} {a}</div>',
    '<div data-keep=0>{w}</div><div data-keep=0>{a} {a}</div><div data-keep=1>{l}</div><div data-keep=1>{s}</div><div data-keep=1>{l}</div><div data-keep=1>{w}</div><div data-keep=1>{l}</div><div data-keep=1>{l} {b}</div><div data-keep=0>{w}</div><div data-keep=0>{a}</div>',
    '<div data-keep=0>{b}</div><div data-keep=0>{b} {w}</div><div data-keep=1><p>{l} {a} {l}</p><p>{b} {s}</p><p>{l}</p></div><div data-keep=0>{s} {b}</div><div data-keep=0>{b}</div>',
    '<div class="banner" data-keep=0>{s}</div><div class="header-main"><p data-keep=0>{a} {a}</p></div><div data-keep=1><p>{l}</p><div class="box">{l} {l}</div><p>{l}</p></div><div class="sidebar" data-keep=0><p>{s}</p><p>{a}</p></div>',
    '<div data-keep=0><p>{l}</p></div><article data-keep=1><h1>{w}</h1><p>{l}</p><p>{s}</p><p>{a}</p></article><div data-keep=0><h3>{w}</h3><p>{l}</p><p>{l}</p><p>{s}</p></div>',
    '<div class="topbar" data-keep=0>{a}</div><div data-keep=0><p>{l}</p><p>{l}</p></div><main data-keep=1><p>{s}</p><p>{l}</p></main><div data-keep=0><p>{s}</p></div>',
    '<div data-keep=1><p>{l}</p><p>{l}</p><p>{s}</p><p>{l}</p></div><div class="newsletter" data-keep=0><p>{l}</p><p>{l}</p></div><div class="promo-box" data-keep=0><p>{l}</p><p>{l}</p><p>{s}</p></div>',
    '<p data-keep=1>{l}</p><p data-keep=1>Cookies {l}</p><p data-keep=1>{w}</p><p data-keep=1>{l} {a}</p><p data-keep=0>{a} {a} {a}</p>',
)
#: How often each layout is filled, with texts of other lengths each time.
FILLS = 4


@lru_cache(1)
def labelled() -> list[tuple[int, str]]:
    """The pages of the labelled table, each with its layout's number."""
    from string import Formatter

    rng = np.random.default_rng(11)
    syllables = "ba do ke li mu na po ra si tu ve wo".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(low, high)))

    made = {
        "l": lambda: ". ".join(words(8, 25).capitalize() for _ in range(rng.integers(2, 9))) + ".",
        "s": lambda: words(4, 14).capitalize() + ".",
        "w": lambda: words(1, 4).capitalize(),
        "a": lambda: f"<a href=/x>{words(1, 4)}</a>",
        "b": lambda: f"<a href=/x>{words(5, 14)}</a>",
    }
    return [(k, "<body>" + "".join(text + (made[field]() if field else "") for text, field, _, _ in Formatter().parse(layout))) for k, layout in enumerate(LAYOUTS) for _ in range(FILLS)]


class Tree:
    """A decision tree by Gini impurity; a leaf holds three blocks at least."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3):
        self.keep, self.at = bool(2 * y.sum() >= len(y)), None
        if depth == 0 or y.min() == y.max():
            return
        best = (1e-9, None, 0.0)
        whole = y.mean() * (1 - y.mean()) * len(y)
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for v in (values[1:] + values[:-1]) / 2:
                left = x[:, k] < v
                a, b = y[left], y[~left]
                if min(len(a), len(b)) < least:
                    continue
                gain = whole - a.mean() * (1 - a.mean()) * len(a) - b.mean() * (1 - b.mean()) * len(b)
                if gain > best[0] + 1e-12:
                    best = (gain, k, v)
        if best[1] is not None:
            _, self.at, self.cut = best
            left = x[:, self.at] < self.cut
            self.low, self.high = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.at is None or not len(x):
            return np.full(len(x), self.keep)
        left = x[:, self.at] < self.cut
        out = np.zeros(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def grow(pages: list[str]) -> Tree:
    """The tree of labelled pages; blocks that certainly stand beside the article need none."""
    rows = [(table(found)[free], np.array([b.label == "1" for b in found], float)[free]) for found in map(blocks, pages) if any(free := [b.apart < 2 for b in found])]
    return Tree(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


@lru_cache(1)
def grown() -> Tree:
    """The tree of the labelled table."""
    return grow([page for _, page in labelled()])


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The main text of one whole page; empty where there is none."""
    return "\n".join(b.text for b in chosen(blocks(page or ""), tree or grown()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages.

    A null or empty html gives an empty text; rows that repeat give a row each; ids and urls may
    be null; further columns are not read; an empty table gives no rows. Text of hidden, svg, math,
    object and noscript elements stays; that of templates and frames is no text of the page.
    """
    ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
