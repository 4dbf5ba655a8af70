"""Main text of web pages by consensus of their host on where it stands.

Every page is read tolerantly into its elements and blocks of text. Each container gets a score: the characters of the running text in it,
times the square of their share in all that it holds, times what its tag or class says. The page votes for its best
container's path, the tags and classes from the root down with digits and positions left out. Votes are counted by host; paths with a twentieth of
a host's votes win there. A page is then read again: its text is that of the containers on the winning path that has most
votes among those it has, or of its own best container if it has none of them.

Inside a container, what names itself as something else goes: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, by tag, role, class or id. An element so named that holds the article or main element stays. Nothing is dropped by
its length or words.

Edge cases: a null or empty page has an empty text; pages without a host choose for themselves; a page cut anywhere ends there, and an
open comment, script or tag takes the rest; bad nesting closes what it must; repeated rows each have a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SHARE_OF_VOTES = 20
#: Elements in elements; deeper ones part blocks but hold nothing of their own.
DEEPEST = 512
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
HAS_NAME = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp".split())
CONTAINERS = frozenset("html body div section article main td th tr tbody thead tfoot table ul ol dl dd blockquote center form nav header footer aside details dialog fieldset figure address menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt pre hr summary figcaption caption legend option hgroup search".split())
CANDIDATES = frozenset("body div section article main td blockquote center".split())
#: An open element that a new one closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
IN_HEAD = frozenset("meta link title style script base noscript template head html".split())
#: 1: layout that stays if it holds the article; 2: never part of it.
BY_TAG = dict.fromkeys("nav header footer aside form menu search".split(), 1) | dict.fromkeys("head template svg math select button object audio video canvas dialog fieldset".split(), 2)
BY_ROLE = dict.fromkeys("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split(), 1)
LAYOUT_WORDS = frozenset(
    """nav navbar navigation menu submenu header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion
    banner notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related
    recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar copyright search form skip disclaimer""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
NOT_LAYOUT = frozenset("has with no without".split())
TEXT_WORDS = frozenset("article content post entry story text main body".split())


@lru_cache(maxsize=8192)
def names(attributes: str) -> tuple[str, int, bool]:
    """(classes for a path, whether they name something else, whether they name the text) of an element's attributes."""
    classes, words, flag = "", set(), 0
    for name, *values in NAMED.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden":
            flag = 2
        elif name == "style":
            flag = 2 if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else flag
        elif name == "role":
            flag = max(flag, BY_ROLE.get(value.strip().lower(), 0))
            words |= {"main"} if value.strip().lower() == "main" else set()
        else:
            words |= {w.lower() for w in PART.findall(value)}
            if name == "class":
                classes = "".join(f".{c}" for c in sorted({DIGITS.sub("#", c) for c in value.split()}))
    if words & COMMENT_WORDS:
        flag = 2
    elif words & LAYOUT_WORDS and not words & NOT_LAYOUT:
        flag = max(flag, 1)
    return classes, flag, bool(words & TEXT_WORDS)


class Page:
    """Elements that can hold blocks (parent, tag, path, whether left out) and the blocks of text (element, text, characters in links)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.flag, self.says_text = [-1], ["html"], ["html"], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._open: list[tuple[str, int]] = []  # (tag, the element around it)
        self._at, self._links, self._linked, self._text = 0, 0, 0, []
        self._read(html)
        self._flush()
        self._settle_flags()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._at, text, self._linked))
            self._text, self._linked = [], 0

    def _pop_to(self, i: int) -> None:
        """Close the i-th open element and those in it."""
        for tag, _ in self._open[i:]:
            self._links -= tag == "a"
        self._at = self._open[i][1]
        del self._open[i:]

    def _find(self, tags, stop) -> int:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in tags:
                return i
            if self._open[i][0] in stop:
                break
        return -1

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if (i := self._find(("p",), CONTAINERS)) >= 0:
                self._pop_to(i)
        if tag not in IN_HEAD and self._open and (i := self._find(("head",), ("body",))) >= 0:
            self._pop_to(i)
        while tag in CLOSES and (i := self._find(*CLOSES[tag])) >= 0:
            self._pop_to(i)
        if tag == "a" and (i := self._find(("a",), CONTAINERS)) >= 0:
            self._pop_to(i)
        if tag == "html" or tag == "body" and "body" in self.tag:
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self._text.append(" ")
            return
        if len(self._open) >= DEEPEST:
            return
        around = self._at
        named = HAS_NAME.search(attributes)
        if named or tag in CONTAINERS or tag in BY_TAG:
            classes, flag, says = names(attributes.strip()) if named else ("", 0, False)
            if tag in ("body", "main", "article") and flag == 1:
                flag = 0
            label = tag + classes
            path = self.path[around]
            if path.rpartition(">")[2] != label:
                path = f"{path}>{label}"
                if len(path) > 1000:
                    path = f"{hashlib.md5(path.encode('utf-8', 'replace')).hexdigest()}>{label}"
            if flag or tag in BY_TAG:
                self._flush()
            self.parent.append(around)
            self.tag.append(tag)
            self.path.append(path)
            self.flag.append(max(flag, BY_TAG.get(tag, 0)))
            self.says_text.append(says)
            self._at = len(self.tag) - 1
        self._open.append((tag, around))
        self._links += tag == "a"

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if tag in VOID or tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self._flush()
        i = self._find((tag,), () if tag in CONTAINERS or tag in BY_TAG else CONTAINERS)
        if i >= 0:
            if self._open[i][1] != self._at and self.flag[self._at]:
                self._flush()
            self._pop_to(i)

    def _read(self, html: str) -> None:
        at, search = 0, TOKEN.search
        while True:
            m = search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text:
                text = unescape(text) if "&" in text else text
                self._text.append(text)
                if self._links:
                    self._linked += len(text)
            if not m:
                return
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag == "plaintext":
                return
            else:
                self._start(tag, m[3])

    def _settle_flags(self) -> None:
        """Layout around the article or main element is not left out; what is in something left out is."""
        for i, tag in enumerate(self.tag):
            if tag in ("article", "main") and not self.flag[i]:
                up = self.parent[i]
                above = []
                while up >= 0 and self.flag[up] != 2:
                    above.append(up)
                    up = self.parent[up]
                if up < 0:
                    for j in above:
                        self.flag[j] = 0
        self.out = [f > 0 for f in self.flag]
        for i in range(1, len(self.tag)):
            self.out[i] = self.out[i] or self.out[self.parent[i]]

    def best(self) -> str | None:
        """The path of the container with the highest score; None without running text."""
        n = len(self.tag)
        good, everything = [0] * n, [0] * n
        for i, text, linked in self.blocks:
            everything[i] += len(text)
            if not self.out[i] and 2 * linked <= len(text):
                good[i] += len(text) - linked
        outer = list(range(n))  # the outermost element of a run with one path
        for i in range(1, n):
            if self.path[self.parent[i]] == self.path[i]:
                outer[i] = outer[self.parent[i]]
        for i in range(n - 1, 0, -1):
            good[self.parent[i]] += good[i]
            everything[self.parent[i]] += everything[i]
        fullest = [0] * n
        for i in range(1, n):
            if self.tag[i] in CANDIDATES and not self.out[i]:
                fullest[self.parent[i]] = max(fullest[self.parent[i]], good[i])
        for i in range(n - 1, 0, -1):
            if self.tag[i] not in CANDIDATES:
                fullest[self.parent[i]] = max(fullest[self.parent[i]], fullest[i])
        by_path: dict[str, list] = {}
        for i in range(n):
            if good[i] and not self.out[i] and outer[i] == i and (self.tag[i] in CANDIDATES or i == 0):
                says = 1.6 if self.tag[i] == "article" else 1.4 if self.tag[i] == "main" else 1.25 if self.says_text[i] else 1.0
                wide = 0.7 if 10 * fullest[i] >= 9 * good[i] else 1.0
                found = by_path.setdefault(self.path[i], [0, 0, says, wide, i])
                found[0], found[1] = found[0] + good[i], found[1] + everything[i]
        if not by_path:
            return None
        return max(by_path, key=lambda p: (by_path[p][0] * (by_path[p][0] / by_path[p][1]) ** 2 * by_path[p][2] * by_path[p][3], by_path[p][4], p))

    def text(self, paths: list[str]) -> str:
        """Blocks inside the first of the paths that has any, or else inside the page's own best container, joined by a space."""
        seen, above = set(), set()
        for i in (i for i, _, _ in self.blocks if not self.out[i]):
            while i >= 0 and i not in seen:
                seen.add(i)
                above.add(self.path[i])
                i = self.parent[i]
        path = next((p for p in paths if p in above), None) or self.best()
        if path is None:
            return ""
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = self.path[i] == path or i > 0 and inside[self.parent[i]]
        return " ".join(text for i, text, _ in self.blocks if inside[i] and not self.out[i])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [Page(html.as_py()).best() if html.is_valid else None for html in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html, paths = batch.column(batch.schema.get_field_index("html")), batch.column(batch.schema.get_field_index("paths"))
        texts = [Page(h.as_py()).text(p.as_py() or []) if h.is_valid else "" for h, p in zip(html, paths, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: F.Column) -> F.Column:
    """The host of a URL in lower case; null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html", share: int = SHARE_OF_VOTES) -> DataFrame:
    """host, paths: those with at least one in `share` of the host's votes, most votes first; `share` of them at most."""
    cast = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host is not null")
    votes = settle(cast.mapInArrow(_votes, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n")), "votes")
    # A hot host's paths can be many; its total is summed before they meet, and few remain of them.
    totals = votes.groupBy("host").agg(F.sum("n").alias("total"))
    some = votes.join(totals, "host").where(F.col("n") * share >= F.col("total"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return settle(some.groupBy("host").agg(ordered.alias("o")).select("host", F.col("o.path").alias("paths")), "winners")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", share: int = SHARE_OF_VOTES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = winning_paths(pages, url, html, share)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    schema = rows.select("page_id", "url").schema.add("text", "string")
    read = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_texts, schema)
    return read.withColumn("n_chars", F.length("text").cast("long"))
