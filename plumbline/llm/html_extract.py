"""Main text of web pages by tree scoring.

A page becomes a tree of block elements. Every block of running text earns points for its length and its commas and
passes them to its ancestors, all to the parent and less to each level above; a container's points are then discounted
by its link density. If the best container lies in an article or main element, the outermost of these is kept whole; else
the container is kept, and beside it and its ancestors every heading and all that is not mostly links. Menus, footers,
sidebars and the like are recognised by their element, and neither score nor appear.

A class, id or role that names such a part (``widget``, ``social``, ``comments``) is a mark, not a verdict, as themes put
these words on wrappers too. The scores decide: a marked element goes if it is dense in links, if the running text in it
earns no more than what stands unmarked in the same article, or if it is small next to the largest marked one there;
around the better part of an article the mark is ignored. Comments have to outweigh all this several times, as a
discussion may well be longer than its article. Beside an article element a mark always holds.

Defined results: a null or empty page gives an empty text; unclosed and misnested elements end where the next block or
an enclosing end tag says; a tag cut off by the end of the page is dropped; repeated pages get a row each; columns
beyond those asked for are not read. A page is read as a whole, in time proportional to its length.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that start a block, those never shown, those outside an article's text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg math object select canvas noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside menu dialog button head search".split())
#: Words of a class, id or role that mark a menu, header, footer, sidebar, notice, advert, form or comments.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer colophon "
    "comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended widget toolbar pagination pager skip copyright contentinfo complementary search form hidden".split()
)
#: Those that stand for reader comments.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: What share of the largest marked element's points a marked element needs, and comments as many times the most that is
#: in an article besides them, for the mark to be ignored.
LEAST_SHARE, COMMENTS_OUTWEIGH = 0.25, 8.0
#: A name with one of these says what stands beside the element, as in ``has-sidebar``.
BESIDE = frozenset("has with without no not".split())
#: Elements that hold the article whatever their class says.
HOLDERS = frozenset("html body main article".split())
#: An open element of these ends where another of the same row starts.
ENDS = {k: v for v in ("p", "li", "dt dd", "td th", "tr", "option") for k in v.split()}
BONUS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: From this share of linked text on, a block beside the best container is a menu without a mark.
LINK_DENSITY = 0.25
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"<]*"|'[^'<]*'|["'])*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile("[a-z]+")


def marked(tag: str, attributes: str, inside_article: bool) -> str:
    """``aside`` for an element that is never the article, ``part`` or ``comments`` for a mark, else empty."""
    if tag in HOLDERS:
        return ""
    if tag in ASIDE or (tag == "header" and not inside_article):
        return "aside"
    mark = "part" if tag == "form" else ""
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        for name in (m[2] or m[3] or m[4] or "").split():
            words = WORD.findall(re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())
            if BESIDE.intersection(words) or not MARKS.intersection(words):
                continue
            if COMMENTS.intersection(words):
                return "comments"
            mark = "part"
    return mark


class Page:
    """The tree of a page: per node its tag, parent, mark and whether it may be shown; and the blocks with their node."""

    def __init__(self, source: str):
        self.tags, self.parents, self.hidden, self.article, self.marks = ["#"], [0], [False], [False], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack, self.open = [0], {}
        self.words: list[str] = []
        self.linked = self.links = 0
        at = 0
        while m := TAG.search(source, at):
            self.text(source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                elif tag in RAW:
                    close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = at if m[3].endswith("/") else close.end() if close else len(source)
                else:
                    self.start(tag, m[3])
        rest = source[at:]
        self.text(rest)
        self.flush()

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.words.append(raw)
            if self.links:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text and not self.hidden[self.stack[-1]]:
                self.blocks.append((self.stack[-1], text, min(self.linked, len(text))))
            self.words, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links += 1
        if tag == "br":
            self.words.append(" ")
        if tag in VOID and tag != "hr":
            return
        above = self.stack[-1]
        aside = marked(tag, attributes, self.article[above])
        if tag not in BLOCKS and not aside:
            return
        self.flush()
        if self.open.get("p") and tag in BLOCKS:
            self.close("p")
        for other in ENDS.get(tag, "").split():
            if self.open.get(other) and self.tags[self.stack[-1]] == other:
                self.close(other)
        if tag == "hr":
            return
        above = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(above)
        self.hidden.append(self.hidden[above] or aside == "aside")
        self.marks.append(aside)
        self.article.append(self.article[above] or tag in ("article", "main"))
        self.stack.append(len(self.tags) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open.get(tag):
            self.flush()
            self.close(tag)
        elif tag in ("p", "br"):
            self.flush() if tag == "p" else self.words.append(" ")

    def close(self, tag: str) -> None:
        self.flush()
        while True:
            node = self.stack.pop()
            self.open[self.tags[node]] -= 1
            if self.tags[node] == tag:
                return


def is_heading(tag: str) -> bool:
    return tag[0] == "h" and tag[1:].isdigit()


def earns(text: str, links: int) -> float:
    """Points of a block of running text, less the share of links in it."""
    return ((len(text) >= 25) + text.count(",") + min(len(text) / 100, 3.0)) * (1 - links / len(text))


def shown_blocks(page: Page) -> list[tuple[int, str, int]]:
    """The blocks that lie in no marked element, marks being ignored around the better part of an article."""
    n = len(page.tags)
    own, chars, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in page.blocks:
        chars[node] += len(text)
        linked[node] += links
        own[node] += 0.0 if is_heading(page.tags[node]) else earns(text, links)
    #: Points below a node: of everything but comments, of what is unmarked, and of the largest outermost marked elements.
    inside, clean = own[:], own[:]
    largest = {"part": [0.0] * n, "comments": [0.0] * n}
    holds = [t in ("article", "main") for t in page.tags]
    for i in range(n - 1, 0, -1):
        above = page.parents[i]
        chars[above] += chars[i]
        linked[above] += linked[i]
        holds[above] = holds[above] or holds[i]
        inside[above] += 0.0 if page.marks[i] == "comments" else inside[i]
        clean[above] += 0.0 if page.marks[i] else clean[i]
        for mark, most in largest.items():
            here = inside[i] if page.marks[i] == mark else 0.0 if page.marks[i] else most[i]
            most[above] = max(most[above], here)
    off, scope = [False] * n, [0] * n
    for i in range(1, n):
        above = page.parents[i]
        off[i], scope[i] = off[above], scope[above]
        if page.tags[i] in ("article", "main"):
            scope[i] = i
        elif page.marks[i] and not off[i]:
            rest, part, talk = clean[scope[i]], largest["part"][scope[i]], largest["comments"][scope[i]]
            astray = holds[0] and not page.article[i] and not holds[i]
            dense = linked[i] >= LINK_DENSITY * chars[i]
            if page.marks[i] == "comments":
                small = inside[i] <= COMMENTS_OUTWEIGH * max(rest, part) or inside[i] < LEAST_SHARE * talk
            else:
                small = inside[i] <= rest or inside[i] < LEAST_SHARE * part
            off[i] = astray or dense or small
            if not off[i]:
                scope[i] = i
    return [b for b in page.blocks if not off[b[0]]]


def main_text(source: str | None) -> str:
    """The blocks of the best container and of what belongs to it, in page order, one a line."""
    page = Page(source or "")
    page.blocks = shown_blocks(page) if any(page.marks) else page.blocks
    if not page.blocks:
        return ""
    n = len(page.tags)
    points = [0.0] * n
    chars, linked = [0] * n, [0] * n
    for node, text, links in page.blocks:
        chars[node] += len(text)
        linked[node] += links
        # a paragraph passes its points on; other elements that hold text themselves keep them as containers
        at = page.parents[node] if page.tags[node] in ("p", "li", "dd", "dt", "pre", "td", "blockquote") else node
        if is_heading(page.tags[node]):
            continue
        earned = earns(text, links)
        for share in SHARES:
            points[at] += earned * share
            if not at:
                break
            at = page.parents[at]
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        linked[page.parents[i]] += linked[i]
    score = [
        (points[i] + BONUS.get(page.tags[i], 0.0)) * (1 - linked[i] / chars[i]) if chars[i] else 0.0 for i in range(n)
    ]
    best = max(range(n), key=lambda i: (score[i], i))
    keep, path = [False] * n, [best]
    while path[-1]:
        path.append(page.parents[path[-1]])
    holder = next((i for i in reversed(path) if page.tags[i] in ("article", "main")), None)
    if holder is not None:
        keep[holder] = True
    else:
        # the path from the best container up to the page, and beside it what is a heading or not mostly links
        on_path = set(path)
        keep[best] = True
        for i in range(1, n):
            if page.parents[i] in on_path and i not in on_path and page.parents[i] != best:
                keep[i] = page.tags[i] in HEADINGS or (chars[i] > 0 and linked[i] < LINK_DENSITY * chars[i])
    for i in range(1, n):
        keep[i] = keep[i] or keep[page.parents[i]]
    above = set(path[1:]) if holder is None else set()
    shown = [t for node, t, links in page.blocks if keep[node] or (node in above and links < LINK_DENSITY * len(t))]
    return "\n".join(shown)


def _texts(sources: pa.Array) -> pa.Array:
    return pa.array([main_text(s) for s in sources.to_pylist()], pa.string())


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Key, URL, main text and its length in code points for every row of ``pages``. Nothing is shuffled."""
    made = pages.select(page, url, F.arrow_udf(_texts, "string")(F.col(source)).alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
