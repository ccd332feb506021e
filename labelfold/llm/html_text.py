"""Main text of web pages by tag-path ratios (operator 4).

Each page is walked once.  Every text block belongs to a root-to-leaf tag path
(tag names with their class names).  Per path the walk aggregates text length,
punctuation and link text; a path's length ratio and punctuation ratio are its
sums over its number of blocks.  Both series are smoothed over the blocks in page
order, fused (length x punctuation, less link text) and cut at a multiple of
their standard deviation: what stays marks the content nodes.  The article is the
named one (``article``, else ``main``) that holds all content nodes, else the
innermost element that does; every block in it that no boilerplate element
encloses is kept, short ones too.  If only the body holds them all, blocks are kept
of the articles with content nodes, of the content paths, and of the element that
holds nearly all of the marked text.

Boilerplate elements (menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are known by tag, role or a word of a class name or id;
a name that tells what a wrapper has or lays out (``has-sidebar``) doesn't count.  Every pass over a
page is linear, also in how deep its elements nest.

Cases: null or empty html and pages without text give an empty text; markup cut
off or wrongly nested is read as far as it goes; repeated pages are treated one
by one; extra columns pass through unless they bear an output's name.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Content paths score at least this many standard deviations of the fused ratios.
THRESHOLD = 0.5
#: Where only the body holds all content nodes, an element with this share of their text is kept whole.
SHARE = 0.9

# HTML element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes template xmp svg".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
                   "p pre section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body head html title td th tr tbody thead tfoot caption option optgroup".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table article section div main body html blockquote td th form select".split())
NOISE_TAGS = frozenset("nav aside footer form button select dialog menu head object canvas audio video annotation annotation-xml".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "submenu sidebar side aside rail footer header masthead topbar cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "disqus reply replies respond related recommended recommendations breadcrumb breadcrumbs pagination pager widget search "
    "toolbar copyright disclaimer skip hidden".split())
#: Words by which a class name tells of a part elsewhere.
STATE_NAMES = frozenset("has with without no layout".split())
ROOTS = frozenset(("html", "body", "main", "article"))

_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+>?|/(?![a-zA-Z])[^>]*+>?"
                  r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']*))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


class _Element:
    __slots__ = ("tag", "path", "noise", "parent", "chars", "children", "article", "block", "linked")

    def __init__(self, tag, path, noise, parent):
        self.tag, self.path, self.noise, self.parent = tag, path, noise, parent
        self.chars, self.children = 0, []
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.linked = tag == "a" or bool(parent and parent.linked)
        if parent is not None:
            parent.children.append(self)


def _open(tag: str, attributes: str, parent: _Element, paths: dict) -> _Element:
    names: set[str] = set()
    telling: set[str] = set()
    noise = parent.noise or tag in NOISE_TAGS
    if attributes.strip():
        for m in _NAMES.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id"):
                for name in value.split():
                    words = set(_WORD.findall(name))
                    names |= words
                    if words.isdisjoint(STATE_NAMES):
                        telling |= words
            elif key == "role":
                noise = noise or value in NOISE_ROLES
            elif key == "style":
                noise = noise or "display:none" in value.replace(" ", "")
            else:
                noise = noise or key == "hidden" or value == "true"
    inside = parent.article
    if tag == "header" and not inside:
        noise = True
    found = telling & NOISE_NAMES
    if tag not in ROOTS and found and not (inside and found == {"header"}):
        noise = True
    label = tag + "".join(f".{x}" for x in sorted(names))
    return _Element(tag, paths.setdefault((parent.path, label), len(paths) + 1), noise, parent)


def text_blocks(page: str) -> list[tuple[str, int, _Element]]:
    """``(text, link_chars, element)`` of every block that no boilerplate element encloses, in page order."""
    root = _Element("#", 0, False, None)
    stack, out, buffer, links, held = [root], [], [], 0, root
    paths: dict[tuple[int, str], int] = {}  # a number for each root-to-leaf path
    unclosed: Counter[str] = Counter()
    pos, size = 0, len(page)

    def flush():
        nonlocal links
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            if text:
                out.append((text, min(links, len(text)), held))
            buffer.clear()
        links = 0

    def add(text):
        nonlocal links, held
        if not stack[-1].noise:
            if not buffer:
                held = stack[-1].block
            buffer.append(text)
            if stack[-1].linked:
                links += len(text)

    def close(k):
        for e in stack[k:]:
            unclosed[e.tag] -= 1
        del stack[k:]

    while pos < size:
        m = _TAG.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        if m[2] is None:  # comment or declaration
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        if m[1]:  # end tag
            for k in range(len(stack) - 1, 0, -1) if unclosed[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS and tag != "a":
                    break  # an inline end tag doesn't close a block
            continue
        if tag == "br" and not stack[-1].noise and buffer:
            buffer.append(" ")
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag != "svg":
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else size
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            closing = SIBLINGS.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
            k = len(stack) - 1
            cut = None
            while k > 0 and any(unclosed[t] for t in closing):
                if stack[k].tag in closing:
                    cut = k
                elif stack[k].tag in SCOPES and not (tag in ("tr", "tbody", "td", "th") and stack[k].tag in ("td", "th")):
                    break
                k -= 1
            if cut is not None:
                close(cut)
        if tag == "math" and m[3].rstrip().endswith("/"):
            continue
        stack.append(_open(tag, m[3], stack[-1], paths))
        unclosed[tag] += 1
    flush()
    return out


def path_scores(blocks: list[tuple[str, int, _Element]], near: bool = True) -> tuple[np.ndarray, list[int]]:
    """Fused tag-path ratio of each block, smoothed if ``near`` blocks count, and each block's path."""
    paths, sums = [], {}
    for text, links, element in blocks:
        paths.append(element.path)
        s = sums.setdefault(element.path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += links
        s[3] += 1
    length = np.array([sums[p][0] / sums[p][3] for p in paths])
    points = np.array([sums[p][1] / sums[p][3] for p in paths])
    linked = np.array([sums[p][2] / max(1, sums[p][0]) for p in paths])
    if not near:
        return length * (1 + points) * (1 - linked), paths
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(paths)), kernel, "full")[2:-2]
    smooth = lambda x: np.convolve(x, kernel, "full")[2:-2] / weight
    return smooth(length) * (1 + smooth(points)) * (1 - linked), paths


def _innermost(root: _Element, chars: float) -> list[_Element]:
    """The elements from the root down to the innermost that isn't a text block and holds ``chars`` of the marked text."""
    chain = [root]
    while True:
        down = [e for e in chain[-1].children if e.chars >= chars]
        if not down or down[0].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "blockquote", "pre"):
            return chain
        chain.append(down[0])


def _in_order(root: _Element) -> list[_Element]:
    """All elements, parents before their children."""
    out, left = [], [root]
    while left:
        out.append(left.pop())
        left.extend(out[-1].children)
    return out


def main_text(page: str | None) -> str:
    """The article's text, its blocks joined by one newline."""
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    score, paths = path_scores(blocks)
    inside = np.array([b[2].article for b in blocks])
    marked = score >= THRESHOLD * score.std()
    if inside.any():  # a page that names its article has its content nodes there
        marked = inside if not (marked & inside).any() else marked & inside
    if not marked.any():
        marked[:] = True
    sure = marked & (path_scores(blocks, near=False)[0] >= THRESHOLD * score.std())  # not only by what is beside them
    if not sure.any():
        sure = marked
    total = 0
    for (text, _, element), m in zip(blocks, sure):
        if m:
            total += len(text)
            element.chars += len(text)
    root = blocks[0][2]
    while root.parent is not None:
        root = root.parent
    elements = _in_order(root)
    for e in reversed(elements[1:]):  # children before their parents
        e.parent.chars += e.chars
    chain = _innermost(root, total)
    top = next((e for tag in ("article", "main") for e in chain if e.tag == tag), chain[-1])
    whole = {top}
    if top.tag in ("#", "html", "body"):
        whole = {e for e in _innermost(root, SHARE * total)[-1:] if e.tag not in ("#", "html", "body")}
    chosen = {p for p, m in zip(paths, sure if whole else marked) if m}
    below: set[_Element] = set()  # the elements in ``top``, and of these the ones that are kept whole
    all_of: set[_Element] = set()
    named: dict[_Element, _Element] = {}  # the outermost named article of an element
    for e in elements:
        if e is top or e.parent in below:
            below.add(e)
        if e in whole or e.parent in all_of:
            all_of.add(e)
        if e.article:
            named[e] = named.get(e.parent, e)
    return "\n".join(text for (text, _, e), path in zip(blocks, paths)
                     if e in below and (path in chosen or e in all_of or e in named and named[e].chars))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            others = [part.column(c) for c in part.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*(c for c in part.schema.names if c != "html"), "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and its number of code points ``n_chars``."""
    kept = [f for f in pages.schema.fields if f.name.lower() not in ("text", "n_chars")]
    others = [f for f in kept if f.name != "html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text string", "n_chars long"])
    df = pages.select(*[F.col(f"`{f.name}`") for f in others], F.col("html"))
    return df.mapInArrow(_extract, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``op4_html_text``: the main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
