"""Main text of web pages by consensus on container paths per host.

First pass: each page's containers are scored by the share of running text in
them. Scores are summed per host and generalised path (tags with classes, digits
masked), so pages of a host vote on where its articles are. Second pass: each
page is cut at its host's winning path, or at its own best container if the
page lacks that path. Votes are combined before the shuffle; html is shuffled in
neither pass unless the winners are too many to broadcast.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_of
from tessera.llm.url_filter import host_of

#: Hosts whose winning paths are broadcast at most (some 100 bytes each); with more, pages are joined by host.
BROADCAST_HOSTS = 200_000
#: Steps of a generalised path, and characters of a step's classes, that are spelled out; what is beyond counts by a checksum.
DEEPEST = 24
LONGEST_STEP = 60
#: A doubtful element stays if this share of the page's text and a first-level heading are in it.
MOST = 0.5

#: Kinds of elements. What is no block is inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript template noembed noframes select xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul script style title textarea iframe "
    "noscript template noembed noframes select xmp".split()
)
CONTAINERS = frozenset("html body main article section div td center".split())
SCOPES = CONTAINERS | frozenset("nav header footer aside form table tr tbody ul ol dl li figure fieldset details blockquote dialog menu".split())
ENDS = {"li": ("li", "ul", "ol", "menu"), "dt": ("dt", "dd", "dl"), "dd": ("dd", "dt", "dl"), "td": ("td", "th", "tr", "table"), "th": ("th", "td", "tr", "table"), "tr": ("tr", "table")}
LEFT_OUT = frozenset("head nav header footer aside form button dialog menu search annotation annotation-xml".split())
#: Words in a class, id or role of what is no article.
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "recommended related replies responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar tracking widget "
    "contentinfo complementary alert hidden".split()
)
#: Words that may stand beside those in a compound name.
COMPANIONS = frozenset(
    "area article articles bar block body bottom box button buttons card col column container content entry form global group holder icon icons inner item items "
    "left link links list main outer page panel post posts primary region right row secondary section site slot space story text title top unit wrap wrapper".split()
)
#: Words in a class, id or role of an article.
ARTICLE_WORDS = frozenset("article content entry main post story body text".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/=>][^\s/=>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_ENDS_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NO_STYLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Container:
    path: str
    begin: int
    bonus: float
    depth: int
    end: int = 0


@dataclass
class Doubt:
    """An element that its names call no article: the doubtful element around it, and what speaks for it."""

    parent: int
    size: int = 0
    article: bool = False
    heading: bool = False


@dataclass
class Page:
    """Blocks of text in page order, how much of each is link text, and the containers as ranges of blocks."""

    blocks: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)

    def without(self, doubts: list[Doubt], of: list[int]) -> None:
        """Drop the blocks of doubtful elements; ``of`` names each block's innermost one, or -1.

        One stays that holds an article or main element, or most of the page's
        text together with its heading.
        """
        if not doubts:
            return
        for text, d in zip(self.blocks, of):
            if d >= 0:
                doubts[d].size += len(text)
        total = sum(map(len, self.blocks))
        for d in reversed(doubts):
            if d.parent >= 0:
                doubts[d.parent].size += d.size
        gone: list[bool] = []
        for d in doubts:
            out = not (d.article or (d.heading and d.size >= MOST * total))
            gone.append(out or (d.parent >= 0 and gone[d.parent]))
        keep = [d < 0 or not gone[d] for d in of]
        place = [0]
        for k in keep:
            place.append(place[-1] + k)
        self.blocks = [x for x, k in zip(self.blocks, keep) if k]
        self.links = [x for x, k in zip(self.links, keep) if k]
        for c in self.containers:
            c.begin, c.end = place[c.begin], place[c.end]

    def scores(self) -> list[float]:
        """Of each container: its share of the page's running text, more for article-like and deeper ones."""
        ahead, linked = [0], [0]
        for text, n in zip(self.blocks, self.links):
            ahead.append(ahead[-1] + len(text))
            linked.append(linked[-1] + n)
        total = max(1, ahead[-1])
        share = [(ahead[c.end] - ahead[c.begin] - 2 * (linked[c.end] - linked[c.begin])) / total for c in self.containers]
        return [s + (c.bonus if s > 0.2 else 0) + 0.01 * min(c.depth, 20) if s > 0 else 0.0 for s, c in zip(share, self.containers)]

    def text(self, path: str | None) -> str:
        """Blocks under the containers with this path; else under the best container."""
        own = [c for c in self.containers if c.path == path and c.end > c.begin]
        if not own and self.blocks:
            scores = self.scores()
            own = [self.containers[max(range(len(scores)), key=lambda i: (scores[i], -i))]] if scores else []
        out, done = [], 0
        for c in sorted(own, key=lambda c: c.begin):
            out += self.blocks[max(c.begin, done) : c.end]
            done = max(done, c.end)
        return " ".join(out)


def _calls_no_article(token: str) -> bool:
    """Whether a class, id or role is a word of what is no article, alone or beside words that say little."""
    parts = _WORD.findall(_CAMEL.sub("-", token).lower())
    return bool(parts) and (parts[0] in LEFT_OUT_WORDS or parts[-1] in LEFT_OUT_WORDS) and all(x in LEFT_OUT_WORDS or x in COMPANIONS for x in parts)


def _names(attributes: str) -> tuple[str, bool, bool, bool]:
    """The generalised class, and whether the names call no article, an article, or the element is hidden."""
    cls, left_out, article, hidden = "", False, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name not in ("class", "id", "role", "hidden", "style"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or bool(_NO_STYLE.search(value))
        else:
            each = value.split()
            left_out = left_out or any(map(_calls_no_article, each))
            article = article or any(x in ARTICLE_WORDS for t in each for x in _WORD.findall(t.lower()))
            if name == "class":
                cls = ".".join(sorted(re.sub(r"\d+", "N", value.lower()).split()))
                if len(cls) > LONGEST_STEP:
                    cls = f"{cls[:LONGEST_STEP]}~{zlib.crc32(cls.encode()):x}"
    return cls, left_out, article, hidden


class _Parser:
    """One pass over a page; each step takes constant time but for what it consumes."""

    def __init__(self):
        self.page = Page()
        self.root = Container("", 0, 0.0, 0)
        self.page.containers.append(self.root)
        # an open element: name, whether it is left out, its container, whether it is a path step, whether it is doubtful
        self.stack: list[tuple[str, bool, Container | None, bool, bool]] = []
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.steps: list[str] = []
        self.sums: list[int] = [0]
        self.doubts: list[Doubt] = []
        self.doubt = -1
        self.of: list[int] = []
        self.held: list[str] = []
        self.linked = self.silent = self.inside_link = 0

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.page.blocks.append(text)
                self.page.links.append(min(self.linked, len(text)))
                self.of.append(self.doubt)
            self.held.clear()
        self.linked = 0

    def close(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            name, quiet, container, step, doubtful = self.stack.pop()
            self.where[name].pop()
            if self.scopes and self.scopes[-1] == len(self.stack):
                self.scopes.pop()
            if name in BLOCKS:
                self.flush()
            if step:
                self.steps.pop()
                self.sums.pop()
            if doubtful:
                self.flush()
                self.doubt = self.doubts[self.doubt].parent
            self.silent -= quiet
            self.inside_link -= name == "a"
            if container is not None:
                container.end = len(self.page.blocks)

    def opened(self, name: str) -> int | None:
        """Place of the nearest open element of this name; inline ones and paragraphs are sought in the nearest scope only."""
        at = self.where.get(name)
        if not at or (name not in SCOPES and self.scopes and self.scopes[-1] > at[-1]):
            return None
        return at[-1]

    def say(self, text: str) -> None:
        if not self.silent and text:
            text = unescape(text) if "&" in text else text
            self.held.append(text)
            if self.inside_link:
                self.linked += len(text)

    def end(self, name: str) -> None:
        at = self.opened(name)
        if at is not None:
            self.close(at)
        elif name in BLOCKS:
            self.flush()

    def begin(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            p = self.opened("p")
            if p is not None:
                self.close(p)
            if name in ENDS:  # the next of its kind ends it, inside the same list or table
                nearest = max(ENDS[name], key=lambda x: (self.where.get(x) or [-1])[-1])
                if nearest == name and self.where.get(name):
                    self.close(self.where[name][-1])
            self.flush()
        cls, left_out, article, hidden = _names(attributes) if attributes else ("", False, False, False)
        quiet = name in LEFT_OUT or hidden
        doubtful = left_out and name not in ("html", "body", "main")
        if name in ("article", "main", "h1") and not doubtful:
            d = self.doubt
            while d >= 0 and not (self.doubts[d].heading if name == "h1" else self.doubts[d].article):
                if name == "h1":
                    self.doubts[d].heading = True
                else:
                    self.doubts[d].article = True
                d = self.doubts[d].parent
        if doubtful:
            if name not in BLOCKS:
                self.flush()
            self.doubts.append(Doubt(self.doubt))
            self.doubt = len(self.doubts) - 1
        container, step = None, name in CONTAINERS
        if step:
            own = f"{name}.{cls}" if cls else name
            self.steps.append(own)
            self.sums.append(zlib.crc32(own.encode(), self.sums[-1]))
            path = "/".join(self.steps[-DEEPEST:])
            if len(self.steps) > DEEPEST:
                path += f"^{self.sums[-1]:x}"
            bonus = 0.3 if name in ("article", "main") else 0.15 if article else 0.0
            container = Container(path, len(self.page.blocks), bonus, min(len(self.steps), DEEPEST))
            if not self.silent and not quiet:
                self.page.containers.append(container)
        self.where.setdefault(name, []).append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((name, quiet, container, step, doubtful))
        self.silent += quiet
        self.inside_link += name == "a"

    def run(self, html: str) -> Page:
        at, size, last = 0, len(html), html.rfind(">")
        tag = _OPEN
        while at < size:
            i = html.find("<", at)
            if i < 0 or i > last and not html.startswith("<!--", i):
                self.say(html[at:])
                break
            self.say(html[at:i])
            if html.startswith("<!--", i):
                stop = html.find("-->", i + 4)
                at = size if stop < 0 else stop + 3
                continue
            if html[i + 1 : i + 2] in ("!", "?") or (html[i + 1 : i + 2] == "/" and not html[i + 2 : i + 3].isalpha()):
                at = html.find(">", i) + 1
                continue
            m = tag.match(html, i)
            if m is None and tag is _OPEN and html[i + 1 : i + 3].strip("/")[:1].isalpha():
                tag = _LOOSE  # quotes that do not end: from here a tag ends at the first >
                m = tag.match(html, i)
            if m is None:
                self.say("<")
                at = i + 1
                continue
            at = m.end()
            name = m[2].lower()
            if m[1]:
                self.end(name)
            elif name in RAW:
                self.flush()
                if not m[3].endswith("/"):
                    stop = _ENDS_OF_RAW[name].search(html, at)
                    if name == "xmp":
                        self.say(html[at : stop.start() if stop else size].replace("&", "&amp;"))
                        self.flush()
                    at = html.find(">", stop.start()) + 1 if stop and stop.start() < last else size
            elif name == "br":
                self.held.append(" ")
            elif name == "hr":
                self.flush()
            elif name not in VOID:
                self.begin(name, m[3])
        self.close(0)
        self.flush()
        self.root.end = len(self.page.blocks)
        self.page.without(self.doubts, self.of)
        return self.page


def parse(html: str) -> Page:
    """Blocks and containers of a page; any string is accepted, tags may be unclosed or misplaced."""
    return _Parser().run(html)


def _slices(batches, size: int = 250):
    for b in batches:
        for lo in range(0, b.num_rows, size):
            yield b.slice(lo, size)


def path_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): each page's container scores, summed over the pages of a batch."""

    def run(batches):
        for part in _slices(batches, 2_000):
            votes: dict[tuple[str, str], float] = {}
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                page = parse(html)
                best: dict[str, float] = {}
                for c, s in zip(page.containers, page.scores()):
                    if s > 0:
                        best[c.path] = max(s, best.get(c.path, 0))
                for path, s in best.items():
                    votes[host, path] = votes.get((host, path), 0) + round(s, 3)
            hosts, paths = zip(*votes) if votes else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])

    return pages.mapInArrow(run, "host string, path string, votes double")


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path) with the most votes; the longer path and then the greater string of equals."""
    votes = path_votes(pages).groupBy("host", "path").agg(F.round(F.sum("votes"), 2).alias("votes"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", F.length("path"), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null or empty html gives the empty text. Pages without a host vote together.
    Repeated rows vote and are extracted like others; null page_ids and urls are
    kept; no rows give no rows; other columns are ignored.
    """
    url = F.col("url").cast("string")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(F.coalesce(url, F.lit(""))).alias("host"), text_of("html").alias("html"))
    winners = stored(winning_paths(seen.select("host", "html")))
    few = winners.count() <= BROADCAST_HOSTS
    joined = seen.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path")

    def run(batches):
        for part in _slices(batches):
            texts = [parse(html).text(path) for html, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
