"""Main-text extraction by tag-path ratios.

A page is cut into text nodes (blocks) with their root-to-leaf tag path.  Over all
nodes of a path, two ratios are aggregated: characters of text per node and marks
of punctuation per node.  The sequence of path ratios in page order is smoothed
with a Gaussian, so that a short heading between paragraphs counts as they do;
the smoothed ratios of text and punctuation are fused by their product, and
paths above the threshold (a share of the spread of the scores) are content.

The content paths then select nodes: the smallest container that holds all their
blocks is the article, and its nodes are kept in page order unless they lie in a part
that is no article text by its element (navigation, header and footer, aside,
form, script, ...) or, for containers, by a name in its class, id or role (advert,
menu, cookie notice, comments, ...).  A paragraph, list item or the like with such a
name has a path of its own: it stays where the ratios of this path, not smoothed, pass
the threshold and its container holds content without a name.  In a container that is
no article, paths below the threshold whose text is nearly all links (menus of plain
lists) go; other short blocks stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not markup and never text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements that hold no article text.
OUTSIDE = {"head", "nav", "footer", "aside", "form", "button", "label", "fieldset", "legend", "menu", "dialog",
           "select", "option", "datalist", "template", "noscript", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line of text: they neither end a block nor take part in paths.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source"}
HEADINGS = {"h1", "h2"}
LEVELS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of a text that do not hold a whole one.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure",
          "figcaption", "address", "summary", "caption"}
#: Elements of a text that a name alone does not put outside the article.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "summary",
           "caption"}
#: The share of link text from which a path is a list of links.
LINKS = 0.8
#: An opening tag ends these open elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role values that name a part outside the article.
NAMES = frozenset("""
    ad ads adsbygoogle adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr
    header login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay
    pagination pager paywall popup privacy promo promoted promotion recommended related replies reply respond
    search share sharing sidebar signup skyscraper social sponsor sponsored sponsors subscribe subscription teaser
    toolbar topbar widget alert alertdialog""".split())
#: Names that an article's own parts may carry beside a word of ARTICLE.
WEAK = frozenset("header banner notice alert related social widget promoted overlay search share".split())
ARTICLE = frozenset("article main content body post entry story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_NO_LETTER = re.compile(r"[^a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


def _names(tag: str, attributes: str) -> str:
    """The names of an element that mark no part of an article, joined; empty: none."""
    if not attributes or tag in ("body", "html", "main", "article"):
        return ""
    found: set[str] = set()
    for values in _NAMED.findall(attributes):
        words = set(_NO_LETTER.split(_HUMP.sub(r"\1 \2", "".join(values)).lower()))
        named = words & NAMES
        if named and not (named <= WEAK and (words & ARTICLE or tag in LEVELS)):
            found |= named
    return ".".join(sorted(found))


def _outside(tag: str, attributes: str) -> bool:
    """Whether an element is no part of an article by its kind, or if it is no text of its own, by its names."""
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("body", "html", "main", "article"):
        return False
    if (tag not in TEXTUAL or tag in LEVELS) and _names(tag, attributes):
        return True
    return bool(_HIDDEN.search(attributes))


class Block:
    """A run of text between block tags: its path, ancestors, text and characters of links.

    ``named`` is the element number of the text with a name that holds it, or none."""

    __slots__ = ("path", "ancestors", "outside", "text", "links", "named")

    def __init__(self, path, ancestors, outside, text, links, named):
        self.path, self.ancestors, self.outside, self.text = path, ancestors, outside, text
        self.links, self.named = links, named


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; white space inside a block is one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, str]] = [("", 0, False, "")]  # tag, number, outside, name in the path
    parts: list[str] = []
    number = at = linked = 0
    link = False
    named: list[int] = []  # numbers of the open elements with a name that are texts

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block("/".join(e[3] for e in stack[1:]), tuple(e[1] for e in stack),
                                 stack[-1][2], text, min(linked, len(text)), named[0] if named else None))
            linked = 0

    def add(text: str):
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text)

    def close(i: int):
        nonlocal link
        flush()
        link = False
        while named and named[-1] >= stack[i][1]:
            named.pop()
        del stack[i:]
    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        closing, tag = m.group(1), m.group(2)
        if closing:
            tag = closing.lower()
            link = link and tag != "a"
            if tag in INLINE and all(e[0] != tag for e in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
            continue
        if not tag:
            continue
        tag, attributes = tag.lower(), m.group(3) or ""
        if tag in RAW:
            flush()
            done = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = done.end() if done else end
            continue
        link = link or tag == "a"
        if tag in INLINE and (tag in VOID or not attributes or not _outside(tag, attributes)):
            continue
        flush()
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if stack[-1][0] == "p" and tag not in INLINE:  # a paragraph ends where a block begins
            close(len(stack) - 1)
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "tbody"):
                    break
        number += 1
        inside_article = any(e[0] in ("article", "main") for e in stack)
        out_of = stack[-1][2] or _outside(tag, attributes) or (tag == "header" and not inside_article)
        names = _names(tag, attributes) if tag in TEXTUAL else ""
        if names:
            named.append(number)
        stack.append((tag, number, out_of, f"{tag}.{names}" if names else tag))
    flush()
    return out


def _ratios(found: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each block's path number; each path's text and punctuation per node and its share of links."""
    paths: dict[str, int] = {}
    at = np.array([paths.setdefault(b.path, len(paths)) for b in found])
    nodes = np.bincount(at)
    chars = np.bincount(at, weights=[len(b.text) for b in found])
    marks = np.bincount(at, weights=[len(_PUNCTUATION.findall(b.text)) for b in found])
    links = np.bincount(at, weights=[b.links for b in found])
    return at, chars / nodes, marks / nodes, links / chars


def _smoothed(at: np.ndarray, chars: np.ndarray, marks: np.ndarray, sigma: float) -> np.ndarray:
    """Fused ratio of each block's path, both ratios smoothed in page order."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def smooth(ratio):
        padded = np.pad(ratio[at], reach, mode="edge")
        return np.convolve(padded, kernel, mode="valid")
    return np.sqrt(smooth(chars) * (1 + smooth(marks)))


def path_scores(found: list[Block], sigma: float = 1.0) -> np.ndarray:
    """Fused, smoothed ratio of each block's path: text x punctuation per node."""
    at, chars, marks, _ = _ratios(found)
    return _smoothed(at, chars, marks, sigma)


def _containers(kept: list[Block], content: np.ndarray) -> set[int]:
    """Numbers of the elements that hold the text of the content paths, all of it.

    The smallest element that is no paragraph, list or the like and holds every content
    block; in an <article>, the outermost one around it; else the innermost <main>
    around it.  If it lies in neither but all content does, the outermost <article>
    and <main> parts with content.
    """
    names: dict[int, str] = {}
    for b in kept:
        names.update(zip(b.ancestors, ["", *(t.partition(".")[0] for t in b.path.split("/"))], strict=False))
    found = [b.ancestors for b, c in zip(kept, content, strict=True) if c]
    common = set(found[0]).intersection(*found)
    # Elements are numbered as they open: an inner one has the larger number.
    if articles := [a for a in common if names[a] == "article"]:
        return {min(articles)}
    if mains := [a for a in common if names[a] == "main"]:
        return {max(mains)}
    parts = [next((a for a in of if names[a] in ("article", "main")), None) for of in found]
    if None not in parts:
        return set(parts)
    return {max(a for a in common if names[a] not in LEAVES)}


def extract(page: str) -> str:
    """The article's text: its blocks in page order, joined by one space."""
    found = blocks(page)
    kept = [b for b in found if not b.outside]
    if not kept:
        return ""
    at, chars, marks, links = _ratios(found)
    here = [i for i, b in enumerate(found) if not b.outside]
    score = _smoothed(at, chars, marks, 1.0)[here]
    own = np.sqrt(chars * (1 + marks))[at][here]  # not smoothed
    spread = score.std()
    threshold = max(min(score.mean(), score.max() / 2) if spread else 0.0, 0.2 * spread)
    content = score >= threshold
    plain = np.array([b.named is None for b in kept])
    if (content & plain).any():
        content &= plain
    else:  # only texts with names: they are all there is
        plain[:] = True
    containers = _containers(kept, content)
    holders = {b.ancestors[-2] for b, c in zip(kept, content, strict=True) if c and len(b.ancestors) > 1}
    inside = np.array([not containers.isdisjoint(b.ancestors) for b in kept])
    for i, b in enumerate(kept):
        if not plain[i]:
            inside[i] &= bool(own[i] >= threshold) and b.ancestors[b.ancestors.index(b.named) - 1] in holders
    marked = {n for b in kept for n, t in zip(b.ancestors[1:], b.path.split("/"), strict=False) if t in ("article", "main")}
    if not containers <= marked:
        inside &= content | (links[at][here] < LINKS)
    for i in range(len(kept) - 2, -1, -1):  # its heading may stand before it
        if inside[i + 1] and kept[i].path.rpartition("/")[2].partition(".")[0] in HEADINGS:
            inside[i] = True
    return " ".join(b.text for b, i in zip(kept, inside, strict=True) if i)


def _rows(batches: Iterator[pa.RecordBatch], n_keep: int):
    for batch in batches:
        texts = [extract(p) if p else "" for p in batch.column(n_keep).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(n_keep)), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:n_keep], "text", "n_chars"])


def extract_pages(pages: DataFrame, *, keep: list[str], page: str = "html") -> DataFrame:
    """``keep`` columns of every row with the main text of its page and n_chars.

    A null or empty page, or one without text outside menus and the like, has an
    empty text.  Unclosed and unknown elements, cut pages and stray character
    references are read as far as they go.  A text is whole, whatever its length.
    Rows that repeat a page get the same text; no rows give no rows.  Other columns
    are not read; result columns replace columns of ``keep`` with their names.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*keep, F.col(page).cast("string").alias("__page"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]),
                        "text string, n_chars bigint"])
    return rows.mapInArrow(lambda it: _rows(it, len(keep)), schema)
