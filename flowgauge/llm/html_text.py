"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks, cut at block-level tags. A block is
described by its own word count and link density, those of its neighbours, and
what encloses it; a decision tree trained on the small labelled pages below
decides whether it belongs to the article.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowgauge.llm.common import append, bound_batches, grown, require

#: HTML elements by how they are treated, and words in class, id or role
#: attributes that name page furniture.
HIDDEN = frozenset("script style noscript template svg math head title textarea select option iframe object canvas audio video map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CHROME = frozenset("nav footer aside form button menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar "
    "navigation newsletter notice popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements whose names say nothing of furniture, elements that are furniture unless they hold an article, and words
#: after which a name tells what a page has or lacks.
WHOLE = frozenset("html body main article".split())
FRAME = frozenset("form fieldset header".split())
LAYOUT = frozenset("no not non has with without layout".split())
#: Furniture that holds articles of its own, readers' and others', and that also names inline elements; of it, what never holds the page's article.
BESIDE = frozenset("ad ads adv advert advertisement comment comments disqus promo promoted related reply replies share sharing sidebar social sponsor sponsored".split())
READERS = frozenset("comment comments disqus reply replies".split())
#: Words of a block that count as the text of a page without an article element.
PLAIN_WORDS = 8
# a quote that is never closed counts as any other sign, so every tag ends and pages are read in one pass
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)", re.S)
HIDDEN_END = re.compile(rf"</({'|'.join(sorted(HIDDEN))})\b[^>]*(?:>|\Z)", re.I)
BODY = re.compile(r"<body\b[^>]*>", re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Names of elements that hold an article, and signs of what is not shown.
ARTICLE = frozenset("article entry story".split())
UNSEEN = re.compile(r"(?<![-\w])hidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    text: str
    words: int
    linked: float
    content: bool
    chrome: bool
    heading: bool


def _names(attributes: str) -> set[str]:
    """Words of class, id and role values: site-header and siteHeader have site and header."""
    return {w.lower() for m in NAMED.finditer(attributes) for w in WORD.findall(next(g for g in m.groups() if g is not None))}


def _furniture(attributes: str) -> set[str]:
    """Furniture words of class, id and role values: not those of no-sidebar, has-comments or content-with-sidebar."""
    found = set()
    for m in NAMED.finditer(attributes):
        for value in next(g for g in m.groups() if g is not None).split():
            words = [w.lower() for w in WORD.findall(value)]
            if "layout" in words:
                continue
            found.update(words[: next((i for i, w in enumerate(words) if w in LAYOUT), None)])
    return found & FURNITURE


class _Frame:
    """A furniture element. An article found in it, or none elsewhere, may tell that it is no furniture after all."""

    __slots__ = ("around", "on", "beside", "readers", "holds", "within", "seen")

    def __init__(self, around: _Frame | None, beside: bool, readers: bool):
        self.around, self.on, self.beside, self.readers, self.holds = around, True, beside, readers, False
        # one of the second kind is here or around
        self.within = beside or around is not None and around.within
        self.seen = False


class _Ends:
    """End tags of hidden elements, found in one pass over the page when first asked for."""

    def __init__(self, page: str):
        self.page, self.of = page, None

    def after(self, name: str, at: int) -> int | None:
        if self.of is None:
            self.of = {}
            for m in HIDDEN_END.finditer(self.page):
                starts, ends = self.of.setdefault(m[1].lower(), ([], []))
                starts.append(m.start())
                ends.append(m.end())
        starts, ends = self.of.get(name, ([], []))
        k = bisect_left(starts, at)
        return ends[k] if k < len(ends) else None


def blocks_of(page: str) -> list[Block]:
    """All visible text blocks in page order; broken markup is read as far as it goes.

    What names an element as furniture holds for all in it. Wrappers that enclose an
    ``article`` or ``main`` are none, which is known at the end of the page only.
    Comments, related stories, sidebars, adverts and the like may hold articles of
    their own: they stay furniture if the page has an article elsewhere, or text in
    no article at all; an ``article`` that is named a comment or reply always is.
    Inline elements that are hidden or named so are left out of their block.
    """
    out: list[Block] = []
    frames: list[_Frame | None] = []  # innermost frame of each block
    made: list[_Frame] = []
    held: list[_Frame | None] = []  # innermost frame of each article
    open_: list[tuple[str, bool, bool, _Frame | None, int]] = []  # enclosing elements: name, content, chrome, frame around, muted
    counts: Counter[str] = Counter()  # open elements by name
    contents = chromes = 0  # open elements of either kind
    muted = 0  # open inline elements that are left out
    loose = False  # the last block element is not among the open ones
    frame: _Frame | None = None
    outside = False  # an article that is in no frame of the second kind
    parts: list[str] = []
    linked = 0
    in_link = heading = False
    ends = _Ends(page)

    def close() -> None:
        nonlocal linked, heading
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), contents > 0, chromes > 0, heading))
            frames.append(frame)
        parts.clear()
        linked, heading = 0, False

    def push(name: str, content: bool, chrome: bool, framed: _Frame | None, mute: int = 0) -> None:
        nonlocal contents, chromes, muted, frame
        open_.append((name, content, chrome, frame, mute))
        counts[name] += 1
        contents, chromes, muted = contents + content, chromes + chrome, muted + (mute > 0)
        if framed is not None:
            frame = framed
            made.append(framed)

    def pop() -> str:
        nonlocal contents, chromes, muted, frame
        name, content, chrome, frame, mute = open_.pop()
        counts[name] -= 1
        contents, chromes, muted = contents - content, chromes - chrome, muted - (mute > 0)
        return name

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not muted:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.split())

    at = 0
    while (found := TOKEN.search(page, at)) is not None:
        take(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(found[1]), found[3]
        if name in HIDDEN and not closing:
            if not attributes.endswith("/"):
                end = ends.after(name, at)
                # an unclosed head ends where the body begins, any other hidden element at its tag
                if end is None and name == "head":
                    body = BODY.search(page, at)
                    end = body.end() if body else None
                at = end if end is not None else len(page) if name in ("script", "style") else at
            close() if name not in ("svg", "math") else None
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if closing:
                if counts[name]:
                    while pop() != name:
                        pass
            elif name not in VOID and (muted or attributes and (_furniture(attributes) & BESIDE or UNSEEN.search(attributes))):
                # 2: ends with the loose block element that it is in
                push(name, False, False, None, 2 if loose else 1)
            continue
        close()
        in_link = False
        while loose and open_ and open_[-1][4] == 2:
            pop()
        if closing:
            if counts[name]:
                while pop() != name:
                    pass
            loose = False
            continue
        # start tags that end an element left open
        if open_ and (open_[-1][0] == "p" or open_[-1][0] == name and name in ("li", "dt", "dd", "td", "tr")):
            pop()
        heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        furniture = _furniture(attributes) if attributes else set()
        comment = name == "article" and bool(furniture & READERS)
        card = name == "article" and bool(furniture & BESIDE)
        content = not comment and (name in CONTENT or bool(attributes and _names(attributes) & ARTICLE))
        if name in CONTENT and not furniture:
            held.append(frame)
            outside = outside or frame is None or not frame.within
            around = frame
            while around is not None and not around.holds:
                around.holds, around = True, around.around
        # an article's own header holds its title
        inside = content or contents > 0
        if inside:
            furniture = furniture - {"header"}
        framed = bool(furniture) and (name not in WHOLE or card) or name in FRAME and not (name == "header" and inside)
        made_now = None
        if framed and name not in VOID:
            made_now = _Frame(frame, bool(furniture & BESIDE), bool(furniture & READERS))
            made_now.holds = card and not comment
        chrome = comment or name in CHROME and name not in FRAME or bool(attributes and UNSEEN.search(attributes))
        listed = name not in VOID and name != "p" and (content or chrome or framed or name in ("div", "section", "header", "ul", "ol", "td", "table"))
        loose = False
        if listed:
            push(name, content, chrome, made_now)
        elif (chrome or framed) and name not in VOID:
            push(name, False, chrome, made_now)
        else:
            loose = name not in VOID
    take(page[at:])
    close()
    # text that is in no frame and no article counts as the page's own
    plain = any(f is None and not b.chrome and not b.content and b.words >= PLAIN_WORDS and b.linked < 0.5 for b, f in zip(out, frames))
    for f in made:
        if f.beside and f.holds:
            f.on = outside or plain and f.readers
    # what encloses an article is no furniture, unless the article itself belongs to one
    for around in held:
        while around is not None and not around.seen and not (around.beside and around.on):
            around.seen, around.on, around = True, False, around.around
    known: dict[_Frame, bool] = {}
    for block, around in zip(out, frames):
        path = []
        while around is not None and around not in known and not around.on:
            path.append(around)
            around = around.around
        found = around is not None and known.get(around, around.on)
        known.update(dict.fromkeys(path, found))
        block.chrome = block.chrome or found
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Rows of content, chrome, heading, content on the page, then (words, link density) of block, previous and next."""
    if not blocks:
        return np.zeros((0, 10))
    own = np.array([(b.words, b.linked) for b in blocks], float)
    edge = np.zeros((1, 2))
    flags = np.array([(b.content, b.chrome, b.heading) for b in blocks], float)
    anywhere = np.full((len(blocks), 1), float(any(b.content and not b.chrome for b in blocks)))
    return np.hstack([flags, anywhere, own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])])


_LONG = "The committee met on Tuesday to discuss the plan in detail and agreed to publish a full report before the end of the year. "
_MID = "Residents said they had waited for years for the work to begin. "
#: Labelled pages: (html, one label per block, 1 for the article).
LABELLED: tuple[tuple[str, str], ...] = (
    (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div class=ad>Buy one today and save a lot of money now.</div><article><h1>A plan</h1><p>{_LONG}</p><p>Soon.</p><p>{_MID}</p></article><footer>&copy; 2020 Example, all rights reserved by the owners of this site.</footer>", "00011110"),
    (f"<header><a href=/>Site</a> <p>Daily news for everyone</p></header><main><h2>Bridge opens</h2><p>{_MID}</p><p>Yes.</p><ul><li>One</li><li>Two words</li></ul><p>{_LONG * 2}</p></main><aside><h3>More</h3><p>{_LONG}</p><a href=/x>Read on</a></aside>", "00111111000"),
    (f"<div class=menu><a href=/a>Start</a> <a href=/b>About</a></div><div id=content><h1>Title words here</h1><p>{_LONG * 2}</p><p>{_LONG}</p><p>{_MID}</p></div><div class=sidebar><p>{_MID}</p></div><div id=footer>Contact us at any time</div>", "0111100"),
    (f"<article><h1>Open letter</h1><p>{_LONG}</p><p>Short.</p><div class=comments><h3>Comments</h3><p>{_LONG * 2}</p><p>Great!</p></div></article>", "111000"),
    (f"<div class=cookie-banner><p>We use cookies to make this site work better for you and for us, as is usual.</p></div><article><p>{_MID}</p><p>{_MID}</p><p>No.</p></article><form><p>Leave your address to get our letter each week.</p><label>Mail</label></form>", "011100"),
    (f"<table><tr><td><a href=/1>One</a></td><td><a href=/2>Two</a></td></tr></table><p>{_LONG * 2}</p><p>{_LONG}</p><p>{_LONG * 3}</p><p><a href=/3>Next page of this long story</a></p><p>Terms of use</p>", "0011100"),
    (f"<p><a href=/1>Sport</a></p><p><a href=/2>Weather today</a></p><h1>Storm nears coast</h1><p>{_LONG}</p><p>{_LONG * 2}</p><p>All rights reserved</p>", "001110"),
    (f"<main><article><h1>Recipe</h1><p>Stir.</p><p>Wait.</p><p>{_MID}<a href=/s>See the source</a></p><aside><p>{_MID}</p></aside><p>Serve.</p></article></main>", "1111" + "01"),
    ("<nav><a href=/1>One</a> <a href=/2>Two</a></nav><article><h1>Brief</h1><p>Done.</p></article><footer>End of page</footer>", "0110"),
    (f"<article><p><a href=/l>A linked paragraph in the article which is quoted as a whole</a></p><p>{_MID}</p></article><div class=related><p><a href=/r>Other story about the same</a></p></div>", "110"),
    ("<div class=notice>This site will be down on Sunday for some hours of work.</div><div class=share>Share this</div>", "00"),
    (f"<p>Log in</p><article><p>{_MID}</p><p>It ends in few words.</p></article>", "011"),
    (f"<ul><li><a href=/1>One</a></li></ul><article><h2>Index</h2><p><a href=/x>Part one</a></p><p>{_LONG}</p><p>Signed by the editor and by all of the staff on Monday.</p></article>", "01111"),
    (f"<p>Published on Monday by staff</p><article><p>{_LONG}</p><ul><li><a href=/q>Source</a></li></ul><p>So it goes on and on.</p></article><p>Printed in three towns of this country</p>", "01110"),
    (f"<div>Skip to the text</div><main><p>Up.</p><p>{_MID}</p></main><div>Read also what others had to say about this</div>", "0110"),
    (f"<div><a href=/1>{_MID}</a></div><div><a href=/2>{_LONG}</a></div><div>{_LONG}</div>", "001"),
    (f"<section class=promo><p>{_LONG * 2}</p></section><div><p>{_LONG * 2}</p><p>{_LONG}</p></div>", "011"),
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page, marks in LABELLED:
        x = features(blocks_of(page))
        if len(x) != len(marks):
            raise ValueError(f"{len(marks)} labels for {len(x)} blocks: {page[:60]}")
        rows.append(x)
        labels.append(np.array([int(m) for m in marks]))
    return np.vstack(rows), np.concatenate(labels)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A decision tree: a label, or (feature, cut, below, above). Splits lower the Gini impurity most."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))

    def impurity(part: np.ndarray) -> float:
        share = part.mean() if len(part) else 0.0
        return len(part) * share * (1 - share)

    best = (impurity(y) - 1e-12, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for c in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= c
            best = min(best, (impurity(y[low]) + impurity(y[~low]), f, c), key=lambda b: b[0])
    _, f, c = best
    if f is None:
        return int(2 * y.sum() >= len(y))
    low = x[:, f] <= c
    return f, float(c), grow_tree(x[low], y[low], depth - 1), grow_tree(x[~low], y[~low], depth - 1)


def keep_of(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), bool(tree))
    f, c, below, above = tree
    low = x[:, f] <= c
    out = np.zeros(len(x), bool)
    out[low], out[~low] = keep_of(below, x[low]), keep_of(above, x[~low])
    return out


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b.text for b, k in zip(blocks, keep_of(tree, features(blocks))) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page.

    Null, empty and textless pages give an empty text. Pages are read whole; other
    columns stay, one named like the new one is replaced; repeated rows repeat.
    """
    require(pages, html)
    bound_batches(pages.sparkSession)
    tree = grow_tree(*labelled_table())
    work = pages.select(*[c for c in pages.columns if c != out])
    at = work.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(at).to_pylist()]
            yield append(batch, **{out: pa.array(texts, pa.string())})

    return work.mapInArrow(run, grown(work, f"`{out}` string"))
