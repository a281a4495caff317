"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of block elements (tag and class or id) from the
root. Over the pages that have it a node shows several presentations (the runs of its children's tags), several
contents (its text) and a share of each page's text. The entropies of the former two, as a share of the largest
possible ones, give 1 - (1 - H_presentation) * (1 - H_content): 0 where all pages show the same, near 1 where each
differs. A node is of low importance in one of two ways:

* it repeats: those entropies combine to less than LOW. The contents that repeat, on min_pages pages of the host, are removed; a page
  with a content of its own there keeps it;
* it weighs little: its mean share of a page's text is below LIGHT, and it hangs on a template, a node whose
  presentation hardly varies. So menus and adverts go whose words differ from page to page. What lies in a node of free
  form or with paragraphs in it, as the parts of an article do, stays, and so does a branch that is half of its own page.

Paragraphs, headings and the article itself are never removed for repeating, nor is a branch that holds some with
text: only what lies beside them in it and repeats on more pages than the branch itself goes, as a menu does beside a copied
text. So copies of one article on one host stay, with their lists and tables. Such a branch is not removed for weighing little
either, unless the page has an article or main element elsewhere. A repeated text without any such element cannot
be told from a box of the site and goes, unless nothing else is left.

What the tree leaves is held against the markup, for hosts of fewer than min_pages pages and for what weighs as much as text
does, as readers' comments: branches go whose element (nav, footer) or name ("sidebar", "comments") tells their
role. A class, id or role names a role where it is the whole name or its head word, container and place words (TAILS) aside:
"site-nav-wrapper", not "no-sidebar", "has-comments" or "legal-notice-text". A so named branch or a form that holds the
page's main element, or its article where none lies outside, stays; lists of other texts (comments, related ones;
OTHERS) do not count for that. Where a page has an article or main element, only what lies in it counts. Where nothing is left, the
tree is ignored, then names, then elements.

Only counts of hashes are gathered: (node, presentation or content) with partial sums, then one row for each node that min_pages
pages have, and one for each of its repeated contents. These are broadcast where they are at most SHARED entries; else each page's own nodes and contents
meet them in joins whose frequent keys are dealt to parts, so a page comes by no more than its nodes' judgement, however large the host. Pages are read in linear time without recursion, whatever their nesting or unclosed tags.

Nulls: a null html counts as empty and gives empty text; a null or odd url has the empty host. Repeated
rows give repeated rows. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, spread, stored

MIN_PAGES, LOW = 3, 0.15
#: Below this mean share of its pages' text a branch weighs little; a template's presentation has at most this entropy.
LIGHT, TEMPLATE = 0.15, 0.5
#: Entries of the judgement (nodes and contents, some 100 bytes each) that are broadcast at most.
SHARED = 1 << 19
#: Pages with one key that meet what is judged of it in one part of a join.
PART_PAGES = 20_000
#: Tags with an odd quote that are searched for their end to the end of the page; later ones end at the next sign.
ODD = 64

# Element names and names of roles in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp noframes math".split())
LANDMARKS = frozenset("nav footer aside menu".split())
DROPPED = frozenset("head form button select option label fieldset dialog menuitem object canvas audio video applet map datalist".split())
KEPT = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Those that hold text, not whole pages: what a branch is kept for, and what is never judged.
HOLDERS, LEAVES = KEPT - {"html", "body"}, KEPT - {"html", "body", "article", "main", "pre", "blockquote"}
#: Those beside which a branch is part of the same text.
FLOW = frozenset("p blockquote pre".split())
ROLES = frozenset(
    "nav navbar navigation menu menubar footer foot contentinfo sidebar aside complementary rail ad ads adv advert adverts advertisement adsense adbox sponsor sponsored promo promotion "
    "banner notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations trending popular "
    "breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond reply replies discussion widget widgets login search searchbox toolbar copyright legal disclaimer skip".split()
)
#: Roles of branches whose articles are other texts than the page's own.
OTHERS = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended recommendations trending popular".split())
#: Words behind the head word of a name: containers, places, items.
TAILS = frozenset(
    "area areas bar bars block blocks bottom box boxes btn button buttons card cards col column container count desktop fixed form frame group holder icon icons inner item items left level line link links list lists "
    "mobile module outer pane panel position post posts primary region right row secondary section sections slot slots small sticky strip tertiary title titles toggle top unit units wrap wrapper zone articles stories tags".split()
)
#: Words that make a name tell of a role elsewhere on the page.
ABOUT = frozenset("no not non with without has have hide hidden show shows is enable enables enabled disable disables disabled allow allows before after below above near".split())
#: Why a branch is dropped: its name, its name as a list of other texts, its element's role, its element, or that it is hidden.
NAMED, OTHER, LANDMARK, ELEMENT, HIDDEN = 1, 2, 3, 4, 5
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "body": frozenset(["head"]),
}

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
#: Dates and times, which would make each page's copy of a box its own.
_TIME = re.compile(r"\b[0-9]{1,4}([-/.:])[0-9]{1,2}(?:\1[0-9]{1,4})?\b")
TEXT, OPEN, CLOSE = 0, 1, 2


class Judgement(NamedTuple):
    """What the host's pages tell of a node: pages of its repeated contents, whether it repeats, weighs little, is of free form; and below how many pages a content does not repeat."""

    often: Mapping[int, int]
    repeats: bool
    light: bool
    free: bool
    least: int = MIN_PAGES


class Page:
    """Block elements in document order, the root first, as parallel lists; and the events of reading: text, element begins, element ends."""

    def __init__(self):
        self.tag, self.path, self.parent, self.own, self.main = [""], [0], [-1], [0], [False]
        self.events: list[tuple[int, int, str]] = []
        self.drop: list[int] = []

    def inherit(self) -> None:
        self.drop = []
        for own, up in zip(self.own, self.parent, strict=True):
            self.drop.append(max(own, self.drop[up]) if up >= 0 else own)

    def below(self, flags: list[bool]) -> list[bool]:
        """For each node whether a flag stands at it or in it."""
        out = list(flags)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] |= out[i]
        return out


def _head(name: str) -> str:
    """The word of a class token, id or role that tells what it is; none where the name tells of something elsewhere."""
    words = _NAME.findall(name)
    if not ABOUT.isdisjoint(words):
        return ""
    while len(words) > 1 and words[-1] in TAILS:
        words.pop()
    return words[-1] if words else ""


def _role(tag: str, attrs: str, inside: bool) -> tuple[str, int, bool]:
    """What a node's class or id adds to its path; why its markup drops it, if so; whether it holds the main text."""
    drop = ELEMENT if tag in DROPPED else LANDMARK if tag in LANDMARKS or tag == "header" and not inside else 0
    key, main = "", tag in ("article", "main")
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            value, name = (a or b or c).lower(), name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                drop = HIDDEN
            elif name in ("class", "id", "role"):
                key += "." + _DIGITS.sub("0", value)
                main |= name == "role" and value == "main"
                if tag not in ("html", "body", "article", "main"):
                    for head in map(_head, value.split()):
                        if head in ROLES or head == "header" and not inside:
                            drop = max(drop, OTHER if head in OTHERS else NAMED)
    return key, drop, main


def _tokens(html: str) -> Iterator[tuple[str, bool, str] | str]:
    """Texts, and (tag, whether it ends, attributes), in time linear in the page."""
    at, n, last, odd = 0, len(html), html.rfind(">"), 0
    while at < n:
        lt = html.find("<", at)
        comment = lt >= 0 and html.startswith("<!--", lt)
        if lt < 0 or lt > last and not comment:
            yield html[at:]
            return
        if lt > at:
            yield html[at:lt]
        if comment:
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        start = _START.match(html, lt)
        if start is None:
            if html[lt + 1] in "!?/":
                at = html.find(">", lt) + 1
            else:
                yield "<"
                at = lt + 1
            continue
        m = _TAG.match(html, lt) if odd < ODD else None
        if m is not None:
            attrs, at = m[3], m.end()
        else:
            odd += 1
            end = html.find(">", lt)
            attrs, at = html[start.end() : end], end + 1
        tag = start[2].lower()
        if tag not in RAW:
            yield tag, bool(start[1]), attrs
        elif not start[1]:
            end_tag = _END[tag].search(html, at)
            at = end_tag.end() if end_tag else n


def parse(html: str) -> Page:
    """The tree of block elements; inline elements leave only their text."""
    page, stack, opened = Page(), [0], Counter()
    tags, events, lost = page.tag, page.events, []
    way = [True]  # whether names and forms only drop what lies around
    depth_drop = [0]

    def close() -> None:
        i = stack.pop()
        opened[tags[i]] -= 1
        events.append((CLOSE, i, ""))

    for token in _tokens(html):
        node = stack[-1]
        if isinstance(token, str):
            events.append((TEXT, node, token))
            continue
        tag, ends, attrs = token
        # an inline element is a node only where its role drops it, and what lies in such a one
        if tag in INLINE and tags[node] not in INLINE and (ends or not (attrs and _role(tag, attrs, True)[1])):
            continue
        if tag in VOID:
            events.append((TEXT, node, " "))
        elif ends:
            if opened[tag]:
                while tags[stack[-1]] != tag:
                    close()
                close()
        else:
            closes = CLOSES.get(tag, ())
            while tags[stack[-1]] in closes:
                close()
            while tags[stack[-1]] == "p" and tag not in INLINE:
                close()
            up, i = stack[-1], len(tags)
            key, drop, main = _role(tag, attrs, page.main[up])
            tags.append(tag)
            page.path.append(_path(page.path[up], tag, key))
            page.parent.append(up)
            page.own.append(drop)
            way.append(way[up] and (drop in (0, NAMED) or tag in ("form", "fieldset", "header")))
            depth_drop.append(max(drop, depth_drop[up]))
            if main and not drop and depth_drop[i] and not page.main[up]:
                lost.append(i)
            page.main.append(page.main[up] or main)
            events.append((OPEN, i, ""))
            stack.append(i)
            opened[tag] += 1
            if attrs.endswith("/"):
                close()
    while len(stack) > 1:
        close()
    page.inherit()
    if lost:
        _restore(page, lost, way)
    return page


def _restore(page: Page, lost: list[int], way: list[bool]) -> None:
    """Undo drops around the main element, and around articles where the page has none outside dropped branches."""
    alone = not _has_main(page)
    says = [False] * len(page.tag)
    for kind, i, text in page.events:
        if kind == TEXT and text.strip():
            says[i] = True
    for i in range(len(says) - 1, 0, -1):  # text that nothing in the branch itself drops
        if says[i] and not page.own[i]:
            says[page.parent[i]] = True
    done: set[int] = set()
    for i in lost:
        if (alone or page.tag[i] != "article") and way[page.parent[i]] and says[i]:
            up = page.parent[i]
            while up >= 0 and up not in done:
                done.add(up)
                up = page.parent[up]
    if done:
        for i in done:
            page.own[i] = 0
        page.inherit()


def _said(text: str) -> bool:
    return bool((html_lib.unescape(text) if "&" in text else text).strip())


def _has_main(page: Page, least: int = NAMED) -> bool:
    return any(kind == TEXT and page.main[i] and page.drop[i] < least and _said(text) for kind, i, text in page.events)


def text_of(page: Page, gone: list[bool] | None = None, main: bool = False, least: int = NAMED) -> str:
    """The decoded text without the branches that are gone and those dropped for at least that reason, white space as single blanks."""
    shown = [d < least and not (gone and gone[i]) for i, d in enumerate(page.drop)]
    out = []
    for kind, i, text in page.events:
        if kind == TEXT:
            if shown[i] and (not main or page.main[i]):
                out.append(text)
        elif shown[page.parent[i]] and page.tag[i] not in INLINE:
            out.append(" ")
    return " ".join(html_lib.unescape("".join(out)).split())


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(1 << 16)
def _path(up: int, tag: str, key: str) -> int:
    return _hash(f"{up}/{tag}{key}")


class Shown(NamedTuple):
    """A node on a page: its hashes of presentation and content, its share of the page's text, its parent's path, its branches."""

    presentation: int
    content: int
    share: float
    up: int
    nodes: list[int]


def shows(page: Page) -> dict[int, Shown]:
    """What the page shows of each node that is judged, and of the root (path 0): repeated siblings together.

    Contents are hashes of hashes, from the leaves up, so that deep nesting costs no more than flat text.
    """
    n = len(page.tag)
    skipped = [d >= ELEMENT for d in page.drop]
    size = [0] * n
    sums = [hashlib.blake2b(digest_size=8) for _ in range(n)]
    kids: list[list[str]] = [[] for _ in range(n)]
    found: dict[int, list[int]] = {0: [0]}
    for kind, i, text in page.events:
        if skipped[i]:
            continue
        if kind == TEXT:
            words = text.split()
            if words:
                plain = " ".join(words)
                size[i] += len(plain) + 1
                sums[i].update(_TIME.sub("0", plain).encode("utf-8", "surrogatepass") + b" ")
        elif kind == CLOSE:
            up = page.parent[i]
            size[up] += size[i]
            sums[up].update(sums[i].digest() + b"<")
        else:
            kids[page.parent[i]].append(page.tag[i])
            if page.tag[i] not in LEAVES:
                found.setdefault(page.path[i], []).append(i)
    out = {}
    for path, nodes in found.items():
        content = hashlib.blake2b(b"".join(sums[i].digest() for i in nodes), digest_size=8).digest() if len(nodes) > 1 else sums[nodes[0]].digest()
        up = page.parent[nodes[0]]
        out[path] = Shown(
            _hash("|".join(" ".join(kids[i]) for i in nodes)), int.from_bytes(content, "big", signed=True), sum(size[i] for i in nodes) / max(1, size[0]), page.path[up] if up >= 0 else 0, nodes
        )
    return out


def noise(page: Page, judged: Mapping[int, Judgement]) -> list[bool]:
    """For each node whether the host's tree removes it, or what it lies in."""
    n = len(page.tag)
    gone = [False] * n
    if not judged:
        return gone
    often, within, light, part = [0] * n, [0.0] * n, [False] * n, [False] * n
    for path, shown in shows(page).items():
        j = judged.get(path)
        if j is None:
            continue
        pages = j.often.get(shown.content, 0)
        for i in shown.nodes:
            often[i], light[i], part[i] = pages if j.repeats else 0, j.light and shown.share < 0.5, j.free
            within[i] = pages or j.least - 1
    said = [False] * n
    for kind, i, text in page.events:
        if kind == TEXT and page.drop[i] < ELEMENT and not said[i]:
            said[i] = _said(text)
    said = page.below(said)
    holds = page.below([said[i] and page.tag[i] in HOLDERS and page.drop[i] < ELEMENT for i in range(n)])
    mains = page.below([said[i] and page.main[i] and not page.drop[i] for i in range(n)])
    for i in range(1, n):
        if said[i] and page.tag[i] in FLOW:
            part[page.parent[i]] = True
    base = [0.0] * n
    for i in range(1, n):
        up = page.parent[i]
        base[i] = base[up]
        part[i] |= part[up]
        if gone[up]:
            gone[i] = True
        elif page.tag[i] not in ("html", "body"):
            if holds[i]:
                base[i] = max(base[i], within[i])
            elif often[i] > base[i]:
                gone[i] = True
            if light[i] and not page.main[i] and not mains[i] and not part[up] and (mains[0] or not holds[i]):
                gone[i] = True
    return gone


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def extract(html: str | None, judged: Mapping[int, Judgement] = MappingProxyType({}), names: bool = True) -> str:
    """The main text of one page, given the judgement of its host's nodes; without names the tree alone decides."""
    page = parse(html or "")
    gone = noise(page, judged)
    if not names:
        return text_of(page, gone, least=ELEMENT) or text_of(page, least=ELEMENT)
    main = _has_main(page)
    text = text_of(page, gone, main) or text_of(page, None, main)
    for least in (LANDMARK, HIDDEN + 1):
        text = text or text_of(page, None, _has_main(page, least), least)
    return text


def judgement(pages: DataFrame, *, min_pages: int = MIN_PAGES, low: float = LOW, light: float = LIGHT, template: float = TEMPLATE) -> tuple[DataFrame, DataFrame]:
    """(host, node, pages, repeats, light, free) of each node that min_pages pages have, and (host, node, content, pages) of each of its contents that repeats."""

    def count(batch: pa.RecordBatch):
        seen: dict[tuple, list] = {}
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            for node, s in shows(parse(html or "")).items():
                for key, share in (((host, node, s.up, 0, s.presentation), s.share), ((host, node, s.up, 1, s.content), 0.0)):
                    own = seen.setdefault(key, [0, 0.0])
                    own[0] += 1
                    own[1] += share
        keys = list(seen)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.float64())],
            names=["host", "node", "up", "kind", "what", "n", "share"],
        )

    rows = map_arrow(pages.select("url", "html"), count, "host string, node long, up long, kind int, what long, n long, share double")
    counts = stored(rows.groupBy("host", "node", "up", "kind", "what").agg(F.sum("n").alias("n"), F.sum("share").alias("share")), "shows")
    is_content = F.col("kind") == 1
    log_sum = F.col("n") * F.log("n")
    each = counts.groupBy("host", "node").agg(
        F.sum(F.when(is_content, F.col("n"))).alias("pages"), F.sum(F.when(is_content, log_sum)).alias("sc"), F.sum(F.when(~is_content, log_sum)).alias("sp"), F.sum("share").alias("share")
    )
    entropy = lambda s: (F.log("pages") - F.col(s) / F.col("pages")) / F.log("pages")
    each = each.filter(F.col("pages") >= min_pages)
    each = each.select("host", "node", "pages", (1 - (1 - entropy("sp")) * (1 - entropy("sc")) < low).alias("repeats"), (F.col("share") / F.col("pages") < light).alias("light"), (entropy("sp") > template).alias("free"))
    often = counts.filter(is_content & (F.col("n") >= min_pages)).select("host", "node", F.col("what").alias("content"), F.col("n").alias("pages"))
    # a content on so many pages stands at a node that so many have
    return stored(each, "nodes"), stored(often, "often")


def _met(pages: DataFrame, nodes: DataFrame, often: DataFrame) -> DataFrame:
    """pages with what is judged of them: an array of (node, repeats, light, free, content and its pages, if it repeats)."""

    def with_key(batch: pa.RecordBatch):
        both = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)
        keys = [hashlib.blake2b(f"{len(u or '')}:{u or ''}{h or ''}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for u, h in both]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["page_id", "url", "html", "key"])

    def show(batch: pa.RecordBatch):
        key, host, node, content = [], [], [], []
        for k, url, html in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html")), strict=True):
            own = host_of(url)
            for path, s in shows(parse(html or "")).items():
                key.append(k)
                host.append(own)
                node.append(path)
                content.append(s.content)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(host, pa.string()), pa.array(node, pa.int64()), pa.array(content, pa.int64())], names=["key", "host", "node", "content"])

    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = map_arrow(pages, with_key, f"page_id {kind}, url string, html string, key binary")
    # copies show the same, so they are told once
    shown = stored(map_arrow(keyed.select("key", "url", "html"), show, "key binary, host string, node long, content long").distinct(), "shown")
    salt = F.xxhash64("key")
    at = F.struct("host", "node").alias("at")
    judged = spread(shown.select("key", "node", at), nodes.select(at, "pages", "repeats", "light", "free"), "at", "pages", salt, part=PART_PAGES)
    what = F.struct("host", "node", "content").alias("what")
    repeated = spread(shown.select("key", what), often.select(what, "pages", F.col("pages").alias("n")), "what", "pages", salt, part=PART_PAGES)
    none = F.lit(None)
    rows = judged.select("key", "node", "repeats", "light", "free", none.cast("long").alias("content"), none.cast("long").alias("n")).unionByName(
        repeated.select("key", F.col("what.node").alias("node"), none.cast("boolean").alias("repeats"), none.cast("boolean").alias("light"), none.cast("boolean").alias("free"), F.col("what.content").alias("content"), "n")
    )
    one = F.struct("node", "repeats", "light", "free", "content", "n")
    info = rows.groupBy("key").agg(F.collect_list(one).alias("judged"))  # twice the nodes of a page at most
    copies = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    return spread(keyed, copies.join(info, "key", "left"), "key", "copies", F.xxhash64("page_id"), part=PART_PAGES).select("page_id", "url", "html", "judged")


def main_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, low: float = LOW, light: float = LIGHT, names: bool = True, shared: int = SHARED) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"
    pages = pages.select("page_id", "url", "html")
    nodes, often = judgement(pages, min_pages=min_pages, low=low, light=light)

    def told(batch: pa.RecordBatch, of) -> pa.RecordBatch:
        texts = [extract(html, of(i, url), names) for i, (url, html) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if nodes.count() + often.count() <= shared:
        contents: dict[tuple, dict[int, int]] = {}
        for r in often.collect():  # with the nodes at most `shared` entries
            contents.setdefault((r["host"], r["node"]), {})[r["content"]] = r["pages"]
        hosts: dict[str, dict[int, Judgement]] = {}
        for r in nodes.collect():
            hosts.setdefault(r["host"], {})[r["node"]] = Judgement(contents.get((r["host"], r["node"]), {}), r["repeats"], r["light"], r["free"], min_pages)
        known = spark.sparkContext.broadcast(hosts)

        def near(batch: pa.RecordBatch):
            yield told(batch, lambda i, url: known.value.get(host_of(url), {}))

        return map_arrow(pages, near, out)

    def far(batch: pa.RecordBatch):
        judged = batch.column("judged")

        def of(i: int, url: str | None) -> dict[int, Judgement]:
            rows = judged[i].as_py() or ()
            contents: dict[int, dict[int, int]] = {}
            for r in rows:
                if r["content"] is not None:
                    contents.setdefault(r["node"], {})[r["content"]] = r["n"]
            return {r["node"]: Judgement(contents.get(r["node"], {}), r["repeats"], r["light"], r["free"], min_pages) for r in rows if r["repeats"] is not None}

        yield told(batch, of)

    return map_arrow(_met(pages, nodes, often), far, out)
