"""Main text of web pages, with site templates removed.

Block elements are hashed as subtrees, bottom up (an element's tag, its text with white space made one space, its
children's digests), counted by host in Spark, and deleted where they recur on many differing pages of that host.
Pages differ if their texts do, so copies of one page don't make it a template. A subtree outside articles is counted
by its path of tags. Inside an article or <main>, where passages that articles share are text, it is counted with its
place besides: its number from its parent's start, or from its end, up to ``EDGE``; and it must be on more of the
host's pages. Elements whose tag, role, class or id says that they are a menu, header, footer, sidebar, notice, advert,
form, script, style or reader comment are deleted on every page; a class says so by the last word of a name that isn't
a mere container's (``cookie-notice``, ``share-box``; not ``notice-of-theorem``).

How many pages make a template: ``share`` of the host's differing pages (``inside`` of them within articles), at least
8, or on hosts of fewer than 14 pages three fifths of them, at least 3. The counts are two partial aggregates. Templates
reach the pages by a join on the host, broadcast only if their number is small.

Text: blocks of the outermost articles if there are any, else of <main>, else of the body; character references are
decoded, white space inside a block becomes one space (a line break and a table cell's end are white space), blocks are
trimmed, empty ones left out, the rest joined by a line feed. A page is read once, in time in proportion to its length.

Cases: a null page is empty and gives an empty text; broken markup is read as far as it goes (open elements end with the
page, a tag that never ends is text); repeated pages get a row each; null urls are a host of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements by kind, after the HTML standard.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "head", "html", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "caption", "legend"}
SPACE = {"br", "td", "th", "img"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
# What says that an element is no main text.
DROP_TAGS = RAW | {"head", "nav", "footer", "aside", "form", "template", "svg", "math", "canvas", "object", "audio", "video", "select", "button", "dialog", "menu", "search", "datalist", "input", "label", "fieldset"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status", "tablist", "tooltip", "note"}
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promotion promotions banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs "
    "sidebar sidebars aside rail widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus pagination pager hidden skip form search tags".split()
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACES = re.compile(r"\s+")


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEADER_WORDS = {"header", "masthead", "banner"}
#: Words of class names that only say that something is held.
CONTAINERS = set("area bar block body bottom box btn button buttons card cards cell col column container content footer grid group holder icons inner item items layer left link links list module outer pane panel right row section sections slot tile title top unit units wrap wrapper zone".split())
#: What says of an article or its title that it is none of the page's own.
NO_ARTICLE = {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"}


def _heads(name: str) -> set[str]:
    """The words that name what each class or id is: the last word of it, or the last that isn't a container's."""
    out = set()
    for token in name.split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
        while len(words) > 1 and words[-1] in CONTAINERS and words[-1] not in DROP_WORDS:
            words.pop()
        out.update(words[-1:])
    return out


def _named(source: str) -> set[str]:
    found = set()
    for m in ATTR.finditer(source):
        if m[1].lower() in ("class", "id"):
            found |= _heads(unescape(m[2] or m[3] or m[4] or ""))
    return found


def _is_header(source: str) -> bool:
    """Whether the class or id calls an element a header and nothing else that is dropped."""
    words = _named(source)
    return bool(words & HEADER_WORDS) and not words & (DROP_WORDS - HEADER_WORDS)


def _says_drop(tag: str, source: str) -> bool:
    if tag in DROP_TAGS:
        return True
    if not source or source.isspace():
        return False
    for m in ATTR.finditer(source):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = _heads(unescape(value))
            if tag in ("article", "h1"):
                if words & NO_ARTICLE:
                    return True
            elif tag not in ("html", "body", "main") and words & (DROP_WORDS - HEADER_WORDS if tag in HEADINGS else DROP_WORDS):
                return True
        elif name == "role" and value.lower() in DROP_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


def _hash(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - ((h >> 63) << 64)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Open:
    """An open element: whether all below is dropped, its region (2 article, 1 main, 0 body), whether in it only headings
    count (an article's header), the blocks before it, what is to be hashed, its path of tags, its place among its
    parent's block elements, how many of these it has, and its record if it is a block element."""

    __slots__ = ("tag", "dropped", "region", "heads", "blocks", "parts", "path", "place", "children")

    def __init__(self, tag: str, dropped: bool, region: int, heads: bool, blocks: int, path: bytes, place: int):
        self.tag, self.dropped, self.region, self.heads, self.blocks, self.path, self.place = tag, dropped, region, heads, blocks, path, place
        self.parts, self.children = [tag.encode()], []


#: Places from a parent's start or end at which a subtree inside an article may be a template.
EDGE = 4


class Page:
    """One page, read once: blocks by region, and the subtrees that hold some."""

    def __init__(self, source: str | None):
        self.html = source or ""
        self.blocks: list[tuple[int, str]] = []
        #: Subtrees of block elements: region, first block, block after the last, digest, path, place from the start, from the end.
        self.subtrees: list[list] = []
        self._words: list[str] = []
        self._root = Open("", False, 0, False, 0, b"", 0)
        self._open: list[Open] = [self._root]
        # Where in the list of open elements each tag is, and where block elements are.
        self._at: dict[str, list[int]] = {}
        self._block_at: list[int] = [0]
        self._in_headings = 0
        self._read()
        self.region = max((r for r, _ in self.blocks), default=0)

    def _text(self, piece: str) -> None:
        if piece and not self._open[-1].dropped:
            self._words.append(piece)

    def _end_block(self) -> None:
        if self._words:
            text = " ".join(unescape("".join(self._words)).split())
            self._words = []
            top = self._open[-1]
            if text and (not top.heads or self._in_headings):
                self.blocks.append((top.region, text))
                self._open[self._block_at[-1]].parts.append(b"t" + _bytes(text) + b"\0")

    def _close(self) -> None:
        top = self._open[-1]
        if top.tag in BLOCK:
            self._end_block()
        self._open.pop()
        self._at[top.tag].pop()
        if top.tag in HEADINGS:
            self._in_headings -= 1
        if top.tag in BLOCK:
            self._block_at.pop()
            above = self._open[self._block_at[-1]]
            digest = xxhash.xxh64_digest(b"".join(top.parts))
            above.parts.append(b"e" + digest)
            for child in top.children:
                child[6] = len(top.children) - 1 - child[5]
            if len(self.blocks) > top.blocks:
                record = [top.region, top.blocks, len(self.blocks), digest, top.path, len(above.children), 0]
                above.children.append(record)
                self.subtrees.append(record)

    def _close_to(self, i: int) -> None:
        while len(self._open) > i:
            self._close()

    def _last(self, tags) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            p = self._last(("p",))
            if p > 0 and p > self._last(("button", "td", "th", "table", "caption", "object")):
                self._close_to(p)
        if tag in IMPLIED:
            scope = self._last(SCOPE[tag])
            while (i := self._last(IMPLIED[tag])) > scope:
                self._close_to(i)
                if tag != "tr":
                    break
        if tag in BLOCK:
            self._end_block()
        elif tag in SPACE:
            self._text(" ")
        if tag in VOID:
            return
        top = self._open[-1]
        dropped, region, heads = top.dropped, top.region, top.heads
        if not dropped:
            if tag == "header":
                heads, dropped = region == 2 or heads, region != 2
            elif _says_drop(tag, attrs):
                # The header of an article holds its headings.
                header = region == 2 and tag in ("div", "section", "hgroup") and _is_header(attrs)
                heads, dropped = heads or header, not header
            if tag == "article":
                region = 2
            elif (tag == "main" or "main" in attrs and re.search(r"""\brole\s*=\s*["']?main\b""", attrs)) and region == 0:
                region = 1
        block = tag in BLOCK
        path = xxhash.xxh64_digest(top.path + tag.encode()) if block else top.path
        self._at.setdefault(tag, []).append(len(self._open))
        if block:
            self._block_at.append(len(self._open))
        if tag in HEADINGS:
            self._in_headings += 1
        self._open.append(Open(tag, dropped, region, heads, len(self.blocks), path, 0))

    def _read(self) -> None:
        html, at, find = self.html, 0, TAG.search
        ends = html.rfind(">")
        while at <= ends:
            m = find(html, at)
            if not m:
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                i = self._last((tag,))
                if i > 0 and (tag in BLOCK or i > self._block_at[-1]):
                    self._close_to(i)
                elif tag in ("br", "p"):
                    self._text(" ")
                if tag in SPACE:
                    self._text(" ")
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            self._start(tag, m[3])
        if at < len(html):
            self._text(html[at:])
        self._close_to(1)
        self._end_block()

    def keys(self) -> dict[int, tuple[int, int]]:
        """Blocks (from, to) by the key of their subtree, in the region that makes the text; even keys are of article or main."""
        out = {}
        for region, lo, hi, digest, path, first, last in self.subtrees:
            if region != self.region or not region and path == b"":
                continue
            if not region:
                out.setdefault(_hash(digest + path) | 1, []).append((lo, hi))
                continue
            for side, place in ((b"<", first), (b">", last)):
                if place < EDGE:
                    out.setdefault(_hash(digest + path + side + bytes([place])) & ~1, []).append((lo, hi))
        return out

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        gone = set()
        if templates:
            for key, spans in self.keys().items():
                if key in templates:
                    for lo, hi in spans:
                        gone.update(range(lo, hi))
        return "\n".join(t for i, (r, t) in enumerate(self.blocks) if r == self.region and i not in gone)

    def identity(self) -> int:
        return _hash(b"\0".join(_bytes(t) for _, t in self.blocks))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def subtrees(pages: DataFrame) -> DataFrame:
    """Rows (host, page, subtree): keys of block subtrees; page identifies the text of all blocks."""

    @F.pandas_udf("struct<page: bigint, subtrees: array<bigint>>")
    def of(htmls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in htmls:
            read = [Page(x) for x in s]
            yield pd.DataFrame({"page": [p.identity() for p in read], "subtrees": [sorted(p.keys()) for p in read]})

    rows = pages.select("host", of("html").alias("x"))
    return rows.select("host", F.col("x.page").alias("page"), F.explode_outer("x.subtrees").alias("subtree"))


def templates(pages: DataFrame, share: float = 0.02, inside: float = 0.5) -> DataFrame:
    """Rows (host, templates array<bigint>): subtrees on as many of a host's differing pages as make a template."""
    seen = materialise(subtrees(pages).distinct(), "html-subtrees")
    hosts = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n"))
    counts = seen.where("subtree is not null").groupBy("host", "subtree").agg(F.count("*").alias("c")).where("c >= 3")
    least = F.least(F.lit(8), F.ceil(F.col("n") * F.lit(0.6)))
    part = F.when(F.col("subtree") % 2 == 0, F.lit(inside)).otherwise(F.lit(share))
    kept = counts.join(hosts, "host").where((F.col("c") >= least) & (F.col("c") >= part * F.col("n")))
    return kept.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates"))


def main_text(pages: DataFrame, broadcast_hosts: int = 100_000) -> DataFrame:
    """Rows (page_id, url, text) of pages (page_id, url, html)."""

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, found in batches:
            yield pd.Series([Page(h).text(set() if t is None else set(map(int, t))) for h, t in zip(htmls, found)], dtype=object)

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = materialise(templates(rows.select("host", "html")), "html-templates")
    rows = rows.join(F.broadcast(known) if known.count() <= broadcast_hosts else known, "host", "left")
    return rows.select("page_id", "url", of("html", "templates").alias("text"))


def op6(spark, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
