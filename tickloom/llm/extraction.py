"""Main text of web pages by containers that the pages of a host agree on.

A first pass scores each page's containers: the share of the page's readable text they hold, less text in links, more for
article elements. The path of a container is generalised to tags and classes without digits. Spark adds the pages' votes
by host; a second pass extracts each page from the containers on its host's winning path, or from the page's own best
where that path is absent or empty.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role,
class or id; a name counts where all its words do, so that a paragraph of class ``share-price`` stays. Paragraphs of main or of
an article beside the chosen container, and articles beside a chosen one, are kept. Texts are blocks with white space folded to one space, joined by a line feed. Null and empty pages have an
empty text; pages of a null or odd URL vote under an empty host; equal rows give equal rows; other columns are passed
over; an empty table gives an empty result. Parsing is one pass, at any length and depth.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture".split())
#: Start tags that end an open paragraph, and tags that end an open one of their own kind.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl body article section div main".split())
CONTAINERS = frozenset("body main article section div td center".split())
LEFT_OUT = frozenset("nav header footer aside form button select option textarea input fieldset dialog menu head script style noscript iframe svg canvas template object embed audio video title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tooltip".split())
#: Words in a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead header topbar footer bottombar copyright "
    "sidebar aside widget widgets rail related recommended recommendations share sharing social "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login paywall disclaimer "
    "comment comments commentlist respond disqus replies reply discussion form search hidden".split()
)
#: Those that mark an article element of its own.
ARTICLE_MARKS = frozenset("comment comments reply ad ads advert sponsored promo related".split())
GOOD = frozenset("article post entry story content main body text page blog news".split())


#: Words that only say what an element looks like: a name of these and of marks is a mark (``share-bar``), with any other word it is not (``share-price``).
SHAPES = frozenset(
    "area articles bar bars block blocks body bottom box boxes btn button buttons center col column columns container content count field fixed float footer "
    "frame group head heading header icon icons inner input inline item items label large left line link links list lists main menu meta module outer page "
    "panel placeholder post posts region right row section site slot small stack sticky story stories tab tabs text thread title toggle top unit user wrap wrapper wrapping zone".split()
)


class Tags:
    """The tags of a page in order, found from the left.

    A tag ends at the first ``>`` outside quotes; where quotes leave none, at the first one. Places from which no end was
    found are remembered, so that a page of odd quotes is still read once.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.dead: set[int] = set()
        self.unclosed: dict[str, int] = {}

    def _end(self, at: int) -> int:
        """Place behind the tag whose name ends at ``at``, -1 without one."""
        html, passed = self.html, []
        while (stop := _STOP.search(html, at)) and stop.start() not in self.dead:
            here, mark = stop.start(), stop[0]
            if mark == ">":
                return here + 1
            passed.append(here)
            close = -1 if here >= self.unclosed.get(mark, len(html)) else html.find(mark, here + 1)
            if close < 0:
                self.unclosed[mark] = min(here, self.unclosed.get(mark, here))
                break
            at = close + 1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name and attributes of the next tag; no name for comments and declarations."""
        html, n = self.html, len(self.html)
        while (start := html.find("<", at)) >= 0:
            first = html[start + 1 : start + 2]
            if start > self.last and (first in "/!?" or first.isascii() and first.isalpha()) and first:
                return start, n, "", "", ""  # a tag that the page's end cuts off
            if html.startswith("<!--", start):
                close = html.find("-->", start + 4)
                return start, n if close < 0 else close + 3, "", "", ""
            if first and first in "!?":
                close = html.find(">", start)
                return start, n if close < 0 else close + 1, "", "", ""
            found = _NAME.match(html, start)
            if found:
                end = self._end(found.end())
                end = html.find(">", found.end()) + 1 if end < 0 else end
                if end > 0:
                    return start, end, found[1], found[2], html[found.end() : end - 1]
            at = start + 1
        return None


def marked(name: str) -> bool:
    """Whether a class or id says that its element is not the article."""
    words = {w.lower() for w in _WORD.findall(name)}
    return bool(words & MARKS) and words <= MARKS | SHAPES


class Page:
    """Containers and blocks of one page, in page order."""

    def __init__(self, html: str):
        self.parents, self.paths, self.bonus, self.sizes, self.links = [-1], [0], [0.0], [0], [0]
        self.ends, self.tags = [0], ["html"]
        self.blocks: list[tuple[int, str]] = []
        self._parse(html)
        for i in range(len(self.parents) - 1, 0, -1):
            self.sizes[self.parents[i]] += self.sizes[i]
            self.links[self.parents[i]] += self.links[i]

    def _flush(self, where: int) -> None:
        text = " ".join("".join(self._held).split())
        if text:
            self.blocks.append((where, text))
            self.sizes[where] += len(text)
            self.links[where] += min(self._linked, len(text))
        self._held.clear()
        self._linked = 0

    def _parse(self, html: str) -> None:
        self._held: list[str] = []
        self._linked = 0
        stack: list[tuple[str, int, bool]] = []  # tag, container, whether it is left out
        where, out, linked, at = 0, 0, 0, 0
        counts: dict[str, int] = {}

        def pop() -> None:
            nonlocal where, out, linked
            tag, container, left = stack.pop()
            counts[tag] -= 1
            if tag not in INLINE and not out:
                self._flush(where)
            out -= left
            linked -= tag == "a"
            if container >= 0:
                self.ends[container] = len(self.parents)
                where = self.parents[container]

        tags = Tags(html)
        while True:
            found = tags.next(at)
            if not out:
                text = html[at : found[0] if found else len(html)]
                if text:
                    text = unescape(text) if "&" in text else text
                    self._held.append(text)
                    if linked:
                        self._linked += len(text)
            if not found:
                break
            _, at, closing, name, attributes = found
            if not name:
                continue
            tag = name.lower()
            if closing:
                if tag == "br":
                    self._held.append(" ")
                elif counts.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                elif tag == "p" and not out:
                    self._flush(where)
                continue
            if tag == "br":
                if not out:
                    self._held.append(" ")
                continue
            if tag not in INLINE and not out:
                self._flush(where)
            if tag in CLOSES_P and counts.get("p"):
                while stack[-1][0] != "p":
                    pop()
                pop()
            elif tag in SIBLINGS and any(counts.get(x) for x in SIBLINGS[tag]):
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in SCOPE and stack[k][0] not in SIBLINGS[tag]:
                    k -= 1
                if k >= 0 and stack[k][0] in SIBLINGS[tag]:
                    while len(stack) > k:
                        pop()
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
                continue
            if attributes.endswith("/") and tag not in CONTAINERS and tag not in CLOSES_P and tag not in INLINE:
                continue
            left, label, bonus = self._look(tag, attributes)
            container = -1
            if not out and not left and tag in CONTAINERS:
                container = len(self.parents)
                self.parents.append(where)
                self.paths.append(xxhash.xxh64_intdigest(label, self.paths[where]) >> 1)
                self.bonus.append(bonus)
                self.sizes.append(0)
                self.links.append(0)
                self.ends.append(0)
                self.tags.append(tag)
                where = container
            out += left
            linked += tag == "a"
            stack.append((tag, container, left))
            counts[tag] = counts.get(tag, 0) + 1
        while stack:
            pop()
        if not out:
            self._flush(where)
        self.ends[0] = len(self.parents)

    @staticmethod
    def _look(tag: str, attributes: str) -> tuple[bool, str, float]:
        """Whether an element is left out, its generalised label, and what speaks for it."""
        bonus = {"article": 1.0, "main": 0.6}.get(tag, 0.0)
        if not attributes.strip():
            return tag in LEFT_OUT, tag, bonus
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        names = found.get("class", "").split()
        role = found.get("role", "").lower()
        own = [*names, found.get("id", "")]
        words = {w.lower() for name in own for w in _WORD.findall(name)}
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag in ("html", "body", "main"):
            left = False
        elif tag == "article":
            left = any(marked(name) and bool(ARTICLE_MARKS & {w.lower() for w in _WORD.findall(name)}) for name in own)
        else:
            left = tag in LEFT_OUT or role in ROLES or hidden or any(map(marked, own))
        if role == "main" or found.get("itemprop", "").lower() == "articlebody":
            bonus = max(bonus, 0.8)
        bonus += 0.2 * bool(words & GOOD)
        return left, ".".join([tag, *sorted(re.sub(r"\d+", "#", name) for name in names)]), bonus

    def best(self) -> tuple[int, float]:
        """The container that scores most, and its score."""
        whole = sum(len(text) for _, text in self.blocks)
        choice, most = 0, (self.sizes[0] - self.links[0]) / max(whole, 1)
        depth = [0] * len(self.parents)
        for i in range(1, len(self.parents)):
            depth[i] = depth[self.parents[i]] + 1
            if self.sizes[i]:
                score = (self.sizes[i] - self.links[i]) / whole * (1 + self.bonus[i]) + 0.01 * min(depth[i], 10)
                if score > most:
                    choice, most = i, score
        return choice, most

    def text(self, path: int | None) -> str:
        """Text of the outermost containers on ``path``; of the page's own best container if there is none."""
        spans = []
        for i, own in enumerate(self.paths):
            if own == path and (not spans or i >= spans[-1][1]):
                spans.append((i, self.ends[i]))
        if not any(self.sizes[a] for a, _ in spans):
            choice = self.best()[0]
            spans = [(choice, self.ends[choice])]
        inside = [False] * len(self.parents)
        for a, b in spans:
            inside[a:b] = [True] * (b - a)
        for parent in {self.parents[a] for a, _ in spans if a}:
            # what stands beside the container in the same article, or in main, is of the page's text
            inside[parent] = inside[parent] or self.tags[parent] in ("main", "article")
        parts = {self.parents[a] for a, _ in spans if self.tags[a] == "article"}
        for i in range(1, len(self.parents)) if parts else ():
            if self.tags[i] == "article" and self.parents[i] in parts and 2 * self.links[i] <= self.sizes[i]:
                inside[i : self.ends[i]] = [True] * (self.ends[i] - i)  # articles side by side
        return "\n".join([text for where, text in self.blocks if inside[where]])


def host() -> Column:
    """Host of the column ``url``, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the container path with most votes on each host."""
    def vote(batches):
        for batch in batches:
            hosts, paths, scores = [], [], []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                choice, score = page.best()
                if page.sizes[0]:
                    hosts.append(name)
                    paths.append(page.paths[choice])
                    scores.append(round(score * 1000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    votes = pages.select(host().alias("host"), "html").mapInArrow(vote, "host string, path bigint, score bigint")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    pages = df.select(df[id_column].alias("page_id"), df[url_column].cast("string").alias("url"), df[html_column].cast("string").alias("html"))
    pages = pages.withColumn("key", F.xxhash64("page_id", "url"))
    # the host's path is joined to keys first, so that a host with very many pages is dealt by page, not by host
    known = pages.select("key", host().alias("host")).join(host_paths(pages), "host").groupBy("key").agg(F.first("path").alias("path"))

    def run(batches):
        for batch in batches:
            texts = [Page(h or "").text(p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    joined = pages.join(known, "key", "left").select("page_id", "url", "html", "path")
    kind = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"page_id": id_column, "url": url_column})
