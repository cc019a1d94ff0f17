"""Main text of web pages by consensus host paths.

Each page's containers are scored on their text, and the page divides its votes among their paths by that score, most of
it to the best one's. A path is the tags and classes from the root, with digits generalised, so pages made by one template
vote alike. Votes are summed by host in Spark, and each page is then extracted again with its host's winning path; where a
page has no such container, its own best one is taken.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role
and class wherever they stand. Text is cut into blocks at block-level tags; blocks have their white space turned into
single spaces and are joined by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table, text_chunks

# HTML's elements by their meaning here, and words of class names and ids that mark what isn't the article.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("article main section div body td".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template button select option textarea input iframe object embed canvas svg math audio video map dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox banner banners bottombar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright crumbs disqus dropdown "
    "footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe tagcloud toolbar topbar tracking warning widget widgets".split()
)
#: Characters of a container's own text that don't make it the article.
LITTLE = 20
#: Before a mark these say that the element is beside such a thing, not one itself.
NEGATED = frozenset("has no with without hide".split())
#: A paragraph's end is implied before these.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of a kind that ends where another of these begins.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: An end tag doesn't close what lies outside these.
WALLS = frozenset("article main section body td th table div".split())
#: End tags that close through walls, what ends no item outside it, and what counts for more as an article's container.
THROUGH = frozenset("html ul ol nav aside form header footer tr tbody".split())
HOLDS = frozenset(["ul", "ol", "dl", "table", "tbody", *WALLS])
BONUS = {"article": 1.6, "main": 1.3}
#: Bytes of pages that are read at once.
_CHUNK = 8_000_000

_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EVENT = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d{2,}")  # a single digit is more often a column than an id
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def _left_out(tag: str, own: dict[str, str], forms: bool) -> bool:
    if not own:
        return tag in DROPPED and not (forms and tag == "form")
    if tag in DROPPED and not (forms and tag == "form") or own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(own.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):  # site-wide classes there say nothing of the content
        return False
    names = f"{own.get('class', '')} {own.get('id', '')}"
    words = _PARTS.split(_CAMEL.sub(" ", names).lower())
    return any(w in MARKS and before not in NEGATED for before, w in zip(["", *words], words, strict=False))


def _step(tag: str, own: dict[str, str]) -> str:
    """A path's part for an element: its tag and classes, digits generalised."""
    if "class" not in own:
        return tag
    step = ".".join([tag, *sorted({_DIGITS.sub("#", c.lower()) for c in own["class"].split()})])
    return step if len(step) <= 200 else f"{tag}.{_digest(step)}"


def _digest(path: str) -> str:
    """What stands for a path in those below it, so that deep pages have no long paths."""
    return blake2b(path.encode("utf-8", "replace"), digest_size=12).hexdigest()


class Tags:
    """A page's markup in one pass, however broken it is.

    A tag ends at the first > outside quotes; a < without such an end is text. What a search for an end has found to
    lead nowhere is remembered, so that no part of the page is searched for every < before it.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.dead: set[int] = set()  # quotes that begin outside any tag's value and from which no end is reached
        self.clear = (0, -1)  # from a place to the next of > and quotes

    def event(self, at: int) -> int:
        """The place of the next >, " or ', or the page's end."""
        if not self.clear[0] <= at <= self.clear[1]:
            m = _EVENT.search(self.html, at)
            self.clear = (at, m.start() if m else len(self.html))
        return self.clear[1]

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, -1 if there is none."""
        html, passed = self.html, []
        while (at := self.event(at)) <= self.last:
            if html[at] == ">":
                return at
            if at in self.dead or (closed := html.find(html[at], at + 1)) < 0:
                break
            passed.append(at)
            at = closed + 1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Begin and end of the next tag, comment or declaration, whether it is an end tag, its name and attributes."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                m = _COMMENT_END.search(html, at + 4)
                return at, m.end() if m else len(html), False, "", ""
            if at > self.last:
                at = html.find("<!--", at)  # an open comment is all that can follow
                return (at, len(html), False, "", "") if at >= 0 else None
            closing = html.startswith("/", at + 1)
            m = _NAME.match(html, at + 1 + closing)
            if m:
                if (end := self.end(m.end())) >= 0:
                    return at, end + 1, closing, m[0], html[m.end() : end]
            elif html[at + 1 : at + 2] in ("!", "?") or closing and at + 2 < len(html):
                return at, html.find(">", at) + 1, False, "", ""
            at += 1
        return None


class Page:
    """A page's containers, with their paths and own pieces of text."""

    def __init__(self, html: str, forms: bool = False):
        self.forms = forms
        #: Of each container, its parent's path as a digest and its own step.
        self.paths: list[str] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        #: Whether a container is an article or main element or lies in one.
        self.inside: list[bool] = []
        #: (container, text) in page order; None is the edge of a block.
        self.pieces: list[tuple[int, str | None]] = []
        self.links: dict[int, int] = {}
        #: Text outside links that stands in a container itself, and characters of first-level headings anywhere in it.
        self.own: dict[int, int] = {}
        self.titles: dict[int, int] = {}
        self._read(html)

    def _read(self, html: str) -> None:
        open_: list[tuple[str, int]] = []  # tag, container or -1
        places: dict[str, list[int]] = {}  # where each tag is open
        blocks: list[int] = []  # where elements are open that aren't inline
        links = 0
        path: list[str] = [""]  # digests of the open elements' paths
        holders: list[int] = []
        skip: list[int] = []  # depths of open elements that are left out
        last = lambda tag: places[tag][-1] if places.get(tag) else -1

        def text(raw: str) -> None:
            if raw and not skip and holders:
                self.pieces.append((holders[-1], raw))
                box, size = holders[-1], len(raw.strip())
                if links:
                    self.links[box] = self.links.get(box, 0) + len(raw)
                elif size:
                    self.own[box] = self.own.get(box, 0) + size
                if size and headed():
                    self.titles[box] = self.titles.get(box, 0) + size

        def headed() -> bool:
            return any(t == "h1" for t, _ in open_[-4:])

        def edge() -> None:
            if holders:
                self.pieces.append((holders[-1], None))

        def close(upto: int) -> None:
            nonlocal links
            while len(open_) > upto:
                tag, box = open_.pop()
                places[tag].pop()
                if skip and skip[-1] == len(open_):
                    skip.pop()
                if tag == "a" and links:
                    links -= 1
                path.pop()
                if tag not in INLINE:
                    blocks.pop()
                    edge()
                if box >= 0:
                    holders.pop()

        def begin(tag: str, own: dict[str, str]) -> None:
            nonlocal links
            if tag not in INLINE:
                edge()
                blocks.append(len(open_))
            whole = "" if skip else f"{path[-1]}/{_step(tag, own)}"
            path.append(path[-1] if skip else _digest(whole))
            box = -1
            if not skip and _left_out(tag, own, self.forms):
                skip.append(len(open_))
            elif not skip and tag in CONTAINERS:
                box = len(self.paths)
                self.paths.append(whole)
                self.tags.append(tag)
                self.parents.append(holders[-1] if holders else -1)
                self.inside.append(tag in BONUS or bool(holders) and self.inside[holders[-1]])
                holders.append(box)
            links += tag == "a"
            places.setdefault(tag, []).append(len(open_))
            open_.append((tag, box))

        begin("body", {})  # what stands outside any container
        base, at, n, tags = len(open_), 0, len(html), Tags(html)
        while at < n:
            if (found := tags.next(at)) is None:
                text(html[at:])
                break
            start, end, closing, name, inner = found
            text(html[at:start])
            at = end
            if not name:
                continue
            tag = name.lower()
            if closing:
                place = last(tag)
                if place < base:
                    if tag == "p":
                        edge()
                elif tag in WALLS or tag in THROUGH or place > max(map(last, WALLS)):
                    close(place)
                continue
            if tag in ("html", "body"):
                continue
            own = _attributes(inner) if inner else {}
            if tag in VOID:
                if tag not in INLINE:
                    edge()
                continue
            if tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(html, at)
                at = m.end() if m else n
                continue
            if inner.endswith("/") and tag in ("svg", "math"):
                continue
            if tag in ENDS_P and blocks[-1] >= base and open_[blocks[-1]][0] == "p":
                close(blocks[-1])
            if tag in ENDS:
                place = max(map(last, ENDS[tag]))
                if place >= base and place >= max(map(last, HOLDS)):
                    close(place)
            begin(tag, own)

    def text(self, boxes: list[int]) -> str:
        """The text of some containers, in page order."""
        own = [False] * len(self.paths)
        for b in boxes:
            own[b] = True
        for k, up in enumerate(self.parents):
            own[k] = own[k] or up >= 0 and own[up]
        # A reference doesn't reach over markup, so each piece is decoded for itself.
        return " ".join("".join("\n" if piece is None else unescape(piece) for box, piece in self.pieces if own[box]).split())

    def best(self) -> tuple[int, list[float]]:
        """The container that holds the article, and each one's worth as such.

        From the one with most text outside links (an article or main element counts for more) down to a child while it
        has nearly all of that text, the container itself has hardly any, and no title is left outside. From an
        article or main element, or within one, only down to a child that has all of its text.
        """
        n = len(self.paths)
        size, linked = [0] * n, [self.links.get(k, 0) for k in range(n)]
        title = [self.titles.get(k, 0) for k in range(n)]
        inner: list[list[int]] = [[] for _ in range(n)]
        for box, piece in self.pieces:
            if piece is not None:
                size[box] += len(piece.strip())
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            if up >= 0:
                size[up], linked[up], title[up] = size[up] + size[k], linked[up] + linked[k], title[up] + title[k]
                inner[up].append(k)
        plain = [max(0, size[k] - linked[k]) * (1 - 0.5 * linked[k] / max(1, size[k])) for k in range(n)]
        worth = [plain[k] * BONUS.get(self.tags[k], 1.0) for k in range(n)]
        at = max(range(n), key=lambda k: worth[k])
        while self.own.get(at, 0) < LITTLE:
            child = max(reversed(inner[at]), key=lambda k: plain[k], default=at)
            if child == at or plain[child] < 0.9 * plain[at] or title[child] < title[at]:
                break
            if size[child] < size[at] and self.inside[at]:
                break  # what isn't an article's own has been left out by its marks
            at = child
        return at, worth


def page_votes(html: str) -> dict[str, float]:
    """What a page gives to the paths of its containers: one vote to the best one's, to others less by their worth.

    A container that is worth nearly as much as the best one, as those around it are, has half a vote at most, and far
    less as it falls behind. Pages of little text have part of a vote.
    """
    page = Page(html)
    best, worth = page.best()
    weight = min(1.0, sum(len(p) for _, p in page.pieces if p is not None) / 500)
    out: dict[str, float] = {}
    for path, w in zip(page.paths, worth, strict=True):
        if w > 0:
            out[path] = max(out.get(path, 0.0), 0.5 * min(1.0, w / worth[best] if worth[best] else 1.0) ** 4 * weight)
    out[page.paths[best]] = weight
    return out


def page_vote(html: str) -> tuple[str, float]:
    """The path that a page gives most, and how much."""
    votes = page_votes(html)
    path = max(votes, key=lambda p: votes[p])
    return path, votes[path]


def extract(html: str, path: str | None) -> str:
    """A page's text in the containers of `path`, or in its own best one."""
    page = Page(html)
    boxes = [k for k, p in enumerate(page.paths) if p == path]
    if path is None or not boxes or not (made := page.text(boxes)):
        made = page.text([page.best()[0]])
    if not made and "<form" in html.lower():  # a form around the whole page
        page = Page(html, forms=True)
        made = page.text([page.best()[0]])
    return made


def host_of(url: str) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^(www|m|amp)\.", "")


def winning_paths(pages: DataFrame, scratch: Scratch, url: str = "url", html: str = "html") -> DataFrame:
    """host and path: the one with most votes of the host's pages; ties go to the first path in order of its digest."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, text="html", most=_CHUNK):
            hosts, paths, votes = [], [], []
            for host, h in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                for path, v in page_votes(h).items() if h and host else ():
                    hosts.append(host)
                    paths.append(path)
                    votes.append(round(v * 1000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], ["host", "path", "votes"])

    voted = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(vote, "host string, path string, votes long")
    summed = voted.groupBy("host", "path").agg(F.sum("votes").alias("votes")).where("votes > 0")
    return scratch.keep(summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path")))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`.

    A null or empty html has the empty text. Pages without a host vote for nobody and are extracted by their own best
    container, as are those that lack their host's winning one or have no text in it. Repeated rows give repeated
    results and vote each for itself. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "html")
    won = winning_paths(pages, scratch, url, html)
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    joined = read.join(won, "host", "left").select("page_id", "url", "html", "path")

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in text_chunks(batches, text="html", most=_CHUNK):
            texts = [extract(h, p) if h else "" for h, p in zip(s.column("html").to_pylist(), s.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([s.column("page_id"), s.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(pull, f"page_id {read.schema['page_id'].dataType.simpleString()}, url {read.schema['url'].dataType.simpleString()}, text string, n_chars long")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
