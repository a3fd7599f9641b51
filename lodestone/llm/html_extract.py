"""Main text of web pages: flat text blocks and a decision tree over shallow features.

The markup is cut into text blocks at block-level tags; scripts, styles and
other raw elements, comments and the head hold no text.  A block has its number
of words, its link density, the same of the blocks before and after it, flags of
its own tag (a heading; a paragraph; a list item), and flags of where it stands:
inside an element whose tag, role, class or id speaks of page furniture, or of
content.  The innermost element that speaks decides; one that holds the page's
main heading or its article, and half of its words, is a layout and speaks of
nothing (a form with half of the words too).  A CART tree, grown on the labelled blocks of `labelled()` below, keeps
or drops each block; in that table many pages have no names to go by, or
misleading ones, so that sizes and links of neighbours decide there.  Kept blocks
are joined in page order by a blank line.

Defined results: null and empty html give the empty text; markup that is cut
off ends at the end of the page (a tag without its `>` is no text); unclosed
elements end with their parents (a head, where something else begins; a link,
with the block around it); a page of any length is read whole; rows with null or
repeated ids are pages like any other; no other column is read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote begins a value only after an equals sign.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
_WORDS = re.compile(r"[^\W_]+")
_HINT = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|style\s*=\s*[\"']?[^\"'>]*display\s*:\s*none", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select"}
#: Raw elements that a slash may close.
FOREIGN = {"svg", "math"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = set("nav footer aside form menu dialog button fieldset".split())
#: Words of classes, ids and roles.
FURNITURE = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline carousel comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus "
    "discussion footer footnav gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications pager pagination popup privacy promo "
    "promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar widget widgets".split()
)
#: Words that say of a name that it tells of a page's make, not of an element's role.
MAKE = set("closed count disabled enabled fixed free has hide is layout no not off on open page show with without wrapper".split())
CONTENT_TAGS = {"article", "main"}
CONTENT = set("article body content entry main post story text".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "content", "heading", "paragraph", "item")


class Element:
    """An open or closed element: what it speaks of (-1 furniture, 1 content, else 0), the words inside, and whether it holds a main heading or an article."""

    __slots__ = ("tag", "parent", "speaks", "named", "words", "head", "label")

    def __init__(self, tag: str, parent: Element | None, speaks: int = 0, named: bool = False, label: str = ""):
        self.tag, self.parent, self.speaks, self.named, self.words, self.head, self.label = tag, parent, speaks, named, 0, False, label


class Block:
    __slots__ = ("text", "words", "linked", "inside", "tag", "label")

    def __init__(self, text: str, linked: int, inside: Element):
        self.text, self.words, self.linked, self.inside, self.tag, self.label = text, len(_WORDS.findall(text)), linked, inside, inside.tag, inside.label


def _speaks(name: str, attributes: str, content: bool) -> tuple[int, bool]:
    """What an element speaks of, and whether by a name or form only, which may be a layout's; content: whether it stands in content."""
    names = [m for x in _HINT.finditer(attributes) for m in "".join(y or "" for y in x.groups()).split()] if "=" in attributes else []
    words = [[w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()) if w] for x in names]
    words = [w for w in words if w and not MAKE.intersection(w)]
    speaks_content = name in CONTENT_TAGS or any(CONTENT.intersection(w) for w in words)
    ends = {w for x in words for w in (x[0], x[-1])} & FURNITURE
    if "header" in ends and (content or speaks_content):
        ends.discard("header")
    if name in CONTENT_TAGS:
        return (-1, True) if any(x == ["comment"] for x in words) else (1, False)
    if name in FURNITURE_TAGS or (name == "header" and not content) or _HIDDEN.search(attributes):
        return -1, name == "form"
    return (-1, True) if ends else (1, True) if speaks_content else (0, False)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    top = Element("", None)
    stack = [top]
    every = [top]
    own = top
    # The number of open elements where a link began, if inside one.
    link_at = 0
    skip_to: str | None = None
    at = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                b = Block(text, linked, own)
                own.words += b.words
                out.append(b)
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link_at:
            linked += len(_WORDS.findall(text))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and skip_to is None:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if skip_to is not None:
            if name == "head" and closing:
                skip_to = None
                continue
            if closing or name in IN_HEAD:
                if name in RAW and not closing:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            skip_to = None
        if name == "head":
            close_block()
            if not closing:
                skip_to = "head"
            continue
        if name in RAW:
            if not closing and not (name in FOREIGN and m[3].endswith("/")):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            link_at = 0 if closing else len(stack)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            continue
        close_block()
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            if link_at > len(stack):
                link_at = 0
        else:
            if name == "p" and stack[-1].tag == "p" or name == "li" and stack[-1].tag == "li":
                stack.pop()
            content = any(e.speaks > 0 for e in stack)
            mark = re.search(r"data-keep=(\d)", m[3]) if "data-keep" in m[3] else None
            e = Element(name, stack[-1], *(_speaks(name, m[3], content) if name not in ("body", "html", "p") or m[3] and name == "p" else (0, False)), mark[1] if mark else stack[-1].label)
            if name == "h1" or name in CONTENT_TAGS and e.speaks > 0:
                for x in stack:
                    x.head = True
            stack.append(e)
            every.append(e)
        own = stack[-1]
    if at < len(page) and skip_to is None:
        add(page[at:])
    close_block()
    # Elements come after their parents, so that backwards each gives its words to its parent.
    for e in reversed(every[1:]):
        e.parent.words += e.words
    for e in every:
        if e.speaks < 0 and e.named and (e.head or e.tag == "form") and 2 * e.words >= top.words:
            e.speaks = 0
    return out


def _told(e: Element | None) -> int:
    """What the innermost element around that speaks of anything speaks of; furniture holds for what is unnamed inside it."""
    while e is not None:
        if e.speaks:
            return e.speaks
        e = e.parent
    return 0


def _in_furniture(e: Element | None) -> bool:
    """Furniture inside, and no article or main element within it."""
    while e is not None:
        if e.speaks < 0:
            return True
        if e.speaks > 0 and not e.named:
            return False
        e = e.parent
    return False


def features(found: list[Block]) -> np.ndarray:
    """One row a block, columns as in FEATURES."""
    own = [(min(b.words, 1000), min(1.0, b.linked / b.words) if b.words else 0.0) for b in found]
    edge = (0, 0.0)
    rows = []
    for i, b in enumerate(found):
        before, after = own[i - 1] if i else edge, own[i + 1] if i + 1 < len(own) else edge
        rows.append((*own[i], *before, *after, _in_furniture(b.inside), _told(b.inside) > 0, b.tag in HEADINGS, b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "dt", "dd")))
    return np.array(rows, float).reshape(-1, len(FEATURES))


_LONG = "The council met on Tuesday evening and agreed, after a long debate, to rebuild the old stone bridge over the river before the next winter floods arrive."
_MID = "Nobody expected the answer that came back from the laboratory."
_LINK = '<a href="/x">{}</a>'


def _links(*names: str, tag: str = "li") -> str:
    return "".join(f"<{tag}>{_LINK.format(n)}</{tag}>" for n in names)


#: What is main text: headings, paragraphs of any length, lists, quotations, plain blocks.
_BODIES = (
    f"<h1>Bridge to be rebuilt</h1><p>{_LONG}</p><p>Yes.</p><p>{_MID}</p><p>{_LONG} {_LONG}</p>",
    f"<h2>A short one</h2><p>It is.</p><ul><li>First point made here</li><li>Second</li></ul><p>{_LONG} {_LINK.format('Read the report')}</p><p>{_MID}</p>",
    f"<h1>Inside</h1><div>{_LONG}</div><div>{_MID}</div><div>{_LONG} {_MID}</div>",
    f"<p>{_LONG}</p><h3>Part two</h3><pre>x = 1</pre><blockquote>{_MID}</blockquote><p>{_LONG}</p><p>So.</p>",
    f"<h1>Plain page</h1><p>{_MID}</p><p>{_MID}</p><p>{_LONG}</p><ol><li>{_MID}</li><li>{_LONG}</li></ol>",
    f"<h2>Sources</h2><p>{_LONG}</p><p>See {_LINK.format('the first report')} and {_LINK.format('the second')} of that year.</p><p>{_MID}</p>",
    f"<p>It was so.</p><p>{_LONG}</p><p>{_MID}</p><p>A last word.</p>",
)
#: Furniture that can be told by its links and sizes, or by those of its neighbours.
_BEFORE = (
    f"<ul>{_links('Home', 'News', 'Sport')}</ul>",
    f"<div>{_LINK.format('Home')} | {_LINK.format('About us')} | {_LINK.format('Contact')}</div>",
    f"<ul>{_links('World', 'Local', 'Letters')}</ul><div>Buy two, get one free today only.</div>",
    f"<p>{_LINK.format('Skip to the text')}</p><table><tr>{_links('One', 'Two', tag='td')}</tr></table>",
)
_AFTER = (
    f"<div>{_LINK.format('Terms')} {_LINK.format('Privacy')} {_LINK.format('Imprint')}</div>",
    f"<div>Share</div><ul>{_links('Next', 'Previous')}</ul>",
    f"<h3>More</h3><ul>{_links('A story about bread', 'Another one about salt', 'Ten tips for a garden')}</ul>",
    f"<p>{_LINK.format('Back to the top')}</p><div>&copy; 2020 The Town Paper</div>",
)
#: Furniture that only a name can tell from main text.
_NAMED = (
    ("div class=cookie-notice", f"We use cookies to make this site better for you. {_LONG} <button>Accept</button>"), ("section id=comments", f"<h3>Two comments</h3><p>{_LONG}</p><p>Great read, thanks!</p>"), ("div class='ad'", _MID),
    ("aside", f"<h3>Most read</h3><p>{_LONG}</p><p>{_MID}</p>"), ("footer", f"&copy; 2020 The Town Paper, all rights reserved. {_LONG}"), ("form", f"<p>Your e-mail</p><p>{_MID}</p>"), ("div class='widget sidebar'", f"<p>{_LONG}</p><p>{_MID}</p>"),
)
#: Around main text: articles, plain blocks, and names that mislead.
_AROUND = ("article", "div", "main", "div class=post-content", "div class='layout has-sidebar'", "div class='inhalt'", "form id=aspnet", "article class='post comments-open'")


@functools.cache
def labelled() -> tuple[str, ...]:
    """The labelled table: small pages whose elements say whether their blocks are main text; every piece above stands in several of them."""

    def within(around: str, body: str, keep: int) -> str:
        return f"<{around} data-keep={keep}>{body}</{around.split()[0]}>"

    pages = []
    for i, around in enumerate(_AROUND):
        for j, body in enumerate(_BODIES):
            k = i + j
            tag, text = _NAMED[k % len(_NAMED)]
            before, after = within("div", _BEFORE[k % len(_BEFORE)], 0), within("div", _AFTER[j % len(_AFTER)], 0)
            named = within(tag, text, 0)
            pages.append("<body>" + before + (named if k % 2 else "") + within(around, body, 1) + ("" if k % 2 else named) + after + "</body>")
            if i < 3:
                pages.append("<body>" + before + within(around, body, 1) + after + "</body>")
    return tuple(pages)


#: Blocks of the labelled table in a leaf, at least.
LEAST = 3


class Tree:
    """A binary CART tree by Gini impurity, grown until leaves are pure or too small."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.value = float(y.mean()) if len(y) else 0.0
        self.split: tuple[int, float] | None = None
        if depth == 0 or self.value in (0.0, 1.0):
            return
        best = (2 * self.value * (1 - self.value) * len(y) - 1e-9, None)
        for k in range(x.shape[1]):
            levels = np.unique(x[:, k])
            for cut in (levels[1:] + levels[:-1]) / 2:
                left = x[:, k] < cut
                if min(left.sum(), (~left).sum()) < LEAST:
                    continue
                cost = sum(2 * part.mean() * (1 - part.mean()) * len(part) for part in (y[left], y[~left]))
                if cost < best[0]:
                    best = (cost, (k, float(cut)))
        if best[1]:
            self.split = best[1]
            left = x[:, self.split[0]] < self.split[1]
            self.children = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value >= 0.5)
        left = x[:, self.split[0]] < self.split[1]
        out = np.zeros(len(x), bool)
        out[left], out[~left] = self.children[0].predict(x[left]), self.children[1].predict(x[~left])
        return out

    def rules(self, indent: str = "") -> str:
        if self.split is None:
            return f"{indent}{'keep' if self.value >= 0.5 else 'drop'}\n"
        name, cut = FEATURES[self.split[0]], self.split[1]
        return f"{indent}{name} < {cut:g}:\n{self.children[0].rules(indent + '  ')}{indent}else:\n{self.children[1].rules(indent + '  ')}"


@functools.cache
def trained() -> Tree:
    """The tree of the labelled table."""
    return grown(labelled())


def grown(pages: tuple[str, ...]) -> Tree:
    """A tree from labelled pages; every block that carries a label counts."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x.append(features(found)[[i for i, b in enumerate(found) if b.label]])
        y += [b.label == "1" for b in found if b.label]
    return Tree(np.concatenate(x), np.array(y))


def main_blocks(pages: list[str | None]) -> list[tuple[list[str], int]]:
    """For each page its kept blocks and the number of all its blocks."""
    found = [blocks(p) if p else [] for p in pages]
    keep = trained().predict(np.concatenate([features(f) for f in found])) if found else np.zeros(0, bool)
    out, at = [], 0
    for f in found:
        out.append(([b.text for b, k in zip(f, keep[at : at + len(f)], strict=True) if k], len(f)))
        at += len(f)
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text, n_chars, n_blocks, n_kept of every page."""
    ident, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                got = main_blocks(part.column(2).to_pylist())
                text = ["\n\n".join(kept) for kept, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), *(pa.array(v, pa.int64()) for v in ([len(t) for t in text], [n for _, n in got], [len(k) for k, _ in got]))],
                    [id_col, url_col, "text", "n_chars", "n_blocks", "n_kept"],
                )

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {ident}, `{url_col}` {url}, text string, n_chars long, n_blocks long, n_kept long")
