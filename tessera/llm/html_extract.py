"""Main-text extraction by consensus host paths.

Every page scores its containers and names the one that holds its article by its generalised tag-class path; Spark
counts the votes per host; every page is then extracted again at its host's winning path, or at its own best container
where it lacks that path. All elements at the path count, long or short; one is left out only where it is mostly links.

Elements are taken as something else than the article by their tag, by attributes that hide them or give them a role, and
by whole class or id names whose head word says so (``site-footer``, ``cookie-bar``, not ``related-work``); an element
named so that holds ``<main>`` or ``<h1>`` stays. Where nothing is left of a page that has text, names that are weak
evidence are read as content; where that leaves nothing either, forms are.

A page is read in time and memory linear in its length, whatever its nesting: paths are hashes chained from the root,
scores go from child to parent once, the ends of dropped elements come from one pass per tag.

Defined results: null or empty html gives an empty text; broken markup is read as it stands (unclosed elements end with
their parent, an unclosed comment ends with the page, a tag that never ends is text); a null url is a host of its own;
repeated rows vote each; equal votes go to the smaller path; columns with clashing names are never read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Batches, as_text, settle

BROADCAST_HOSTS = 100_000

# HTML elements by what they mean to the extraction.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = set("article body div main section td center html blockquote figure table tbody tr ul ol dl".split())
DROPPED = set("head script style noscript template iframe svg math canvas object embed audio video map nav footer aside form button select option textarea input label dialog menu title".split())
LOOSE = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
FORMS = {"form"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIST_OWNERS = {"ul", "ol", "dl", "table", "div", "section", "article", "body"}
RAW = {"script", "style", "textarea", "title"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
# Words of class and id names. STRONG and WEAK name something else than the article, GOOD names the article,
# WRAPPERS stand behind the word that counts, FIRST count at the front of a name, STATES say that another element is there.
STRONG = set("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored cookie cookies consent gdpr popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot comment comments commentlist disqus newsletter subscribe signup login pagination pager toolbar".split())
WEAK = set("banner promo promos promotion promotions notice notices notification notifications alert alerts header masthead topbar bottombar respond reply replies share sharing social related recommended recommendations search widget widgets copyright legal skiplink".split())
GOOD = set("article content entry post story main body text".split())
WRAPPERS = set("container wrapper wrap box bar area list item items inner outer left right top bottom block section slot unit panel region link links posts articles stories content body text title form icon icons button buttons row col column group".split())
FIRST = set("ad ads advert advertisement cookie cookies gdpr disqus sponsor sponsored".split())
STATES = set("no not has have with without hide show is js open".split())
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[-_:.\d]+|(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    """An element: its blocks are those numbered first to last - 1; chars and links are of those blocks, score of the text close to it."""

    tag: str
    step: str
    path: int
    parent: int
    dropped: bool
    inside: bool
    good: bool
    first: int
    last: int = -1
    chars: int = 0
    links: int = 0
    score: float = 0.0


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


@lru_cache(maxsize=65_536)
def strength(name: str) -> str:
    """Which list a class or id name falls under by its head word: strong, weak, good or nothing."""
    parts = [p.lower() for p in _PART.split(name) if p]
    if not parts or parts[0] in STATES:
        return ""
    if "".join(parts) == "skiplink":
        return "weak"
    if parts[0] in FIRST:
        return "strong"
    good = parts[-1] in GOOD
    while len(parts) > 1 and parts[-1] in WRAPPERS:
        parts.pop()
    for word in (parts[-1], "".join(parts[-2:])):
        if word in STRONG:
            return "strong"
        if word in WEAK:
            return "" if word == "header" and GOOD.intersection(parts[:-1]) else "weak"
    return "good" if good or parts[-1] in GOOD else ""


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts, a name inside a value is none."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class _Source:
    """A page's markup: tags in order, ends of elements and places of headings, each found in one pass."""

    def __init__(self, page: str):
        self.page, self.last_end = page, page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self._ends: dict[str, dict[int, int]] = {}
        self._heads: list[int] | None = None

    def tag_end(self, at: int) -> int:
        """Where the tag that opened before ``at`` has its >; -1 if nowhere. A quote counts where it follows = and closes before another tag does."""
        page = self.page
        while (m := _STOP.search(page, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = m.end()
            if page[max(0, m.start() - 64) : m.start()].rstrip().endswith("=") and at <= self.last_quote[m[0]]:
                close = page.find(m[0], at)
                first = page.find(">", at, close)
                if first >= 0 and not (page[close + 1 : close + 2].isspace() or page[close + 1 : close + 2] in ("/", ">", "")):
                    return first  # the quote was never closed: it runs into another tag's
                at = close + 1
        return -1

    def end_of(self, tag: str, start: int) -> int:
        """Where the element whose tag starts there ends; the page's end for an unclosed script or style, 0 for another unclosed element."""
        if tag not in self._ends:
            ends, open_ = {}, []
            for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(self.page, 0, self.last_end + 1):
                if not m[1]:
                    if tag not in RAW or not open_:
                        open_.append(m.start())
                elif open_:
                    ends[open_.pop()] = m.end()
            self._ends[tag] = ends
        return self._ends[tag].get(start) or (len(self.page) if tag in RAW else 0)

    def holds_heading(self, start: int, end: int) -> bool:
        """Whether a <main> or <h1> starts in between."""
        if self._heads is None:
            self._heads = [m.start() for m in re.finditer(r"<(?:main|h1)(?=[\s/>])", self.page, re.I)]
        i = bisect_right(self._heads, start)
        return i < len(self._heads) and self._heads[i] < end


def parse(page: str, weak: bool = True, forms: bool = True) -> Page:
    """Elements and blocks of a page; text in dropped elements belongs to no block. weak, forms: whether weak names and forms are dropped."""
    src = _Source(page)
    nodes = [Node("", "", 0, -1, False, False, False, 0)]
    out = Page(nodes)
    stack, open_, run = [0], {}, []
    links = in_link = at = 0
    end = len(page)

    def close_block() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                n = nodes[stack[-1]]
                inside = min(links, len(text))
                n.score += max(len(text) - 2 * inside, 0)
                n.chars += len(text)
                n.links += inside
                out.blocks.append((stack[-1], text, inside))
            run.clear()
            links = 0

    def leave(depth: int) -> None:
        for k in stack[depth:]:
            nodes[k].last = len(out.blocks)
            open_[nodes[k].tag] -= 1
        del stack[depth:]

    while at < end:
        start = page.find("<", at)
        while 0 <= start and not (page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("/", "!", "?")):
            start = page.find("<", start + 1)
        if start < 0 or start > src.last_end:
            start = end
        text = page[at:start]
        if text and not nodes[stack[-1]].dropped:
            run.append(entities.unescape(text) if "&" in text else text)
            links += len(text) if in_link else 0
        if start == end:
            break
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = close + 3 if close >= 0 else end
            continue
        m = _NAME.match(page, start + 1)
        close = src.tag_end(m.end() if m else start + 1) if m else page.find(">", start)
        if close < 0:
            if not nodes[stack[-1]].dropped:
                run.append(page[start:])
            break
        at = close + 1
        if not m:
            continue
        tag, attrs = m[1].lower(), page[m.end() : close]
        if page[start + 1] == "/":
            if tag == "a":
                in_link = max(in_link - 1, 0)
            elif tag in BLOCKS or tag in DROPPED:
                close_block()
                if open_.get(tag):
                    d = len(stack) - 1
                    while nodes[stack[d]].tag != tag:
                        d -= 1
                    leave(d)
            continue
        if tag == "br":
            run.append(" ")
        elif tag == "a":
            in_link += 1
        elif tag in BLOCKS or tag in DROPPED:
            close_block()
            in_link = 0
            ends = CLOSES.get(tag, {"p"})  # any block ends an open paragraph
            if any(open_.get(x) for x in ends):
                for d in range(len(stack) - 1, 0, -1):
                    if nodes[stack[d]].tag in ends:
                        leave(d)
                        break
                    if nodes[stack[d]].tag in LIST_OWNERS:
                        break
            if tag in VOID:
                continue
            up = nodes[stack[-1]]
            named = attributes(attrs) if attrs.strip(" /\n\t\r") else {}
            names = list(dict.fromkeys(f"{named.get('class', '')} {named.get('id', '')}".split()))
            kinds = {strength(x) for x in names}
            bad = tag in DROPPED and (forms or tag not in FORMS) or (tag == "header" and not up.inside)
            if tag not in ("html", "body") and named:
                bad = bad or named.get("hidden", "until-found").lower() != "until-found" or named.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(named.get("style", "")) is not None or named.get("role", "").lower() in ROLES
                if not bad and tag not in ("article", "main") and ("strong" in kinds or (weak and "weak" in kinds and not (up.inside and kinds == {"weak"} and any(x.lower().endswith("header") for x in names)))):
                    bad = not src.holds_heading(start, src.end_of(tag, start) or end)
            step = tag + "".join(f".{re.sub('[0-9]+', 'N', x)}" for x in sorted(names)[:3])
            if bad and (over := src.end_of(tag, start)):
                at = max(over, at)
            elif not attrs.endswith("/"):
                path = xxhash.xxh3_64_intdigest(step.encode("utf-8", "surrogatepass"), up.path) >> 1
                nodes.append(Node(tag, step, path, stack[-1], up.dropped or bad, up.inside or tag in ("article", "main"), "good" in kinds, len(out.blocks)))
                stack.append(len(nodes) - 1)
                open_[tag] = open_.get(tag, 0) + 1
    close_block()
    leave(1)
    nodes[0].last = len(out.blocks)
    for n in reversed(nodes[1:]):  # children come after their parents
        p = nodes[n.parent]
        p.score += n.score * (0.7 if n.tag in CONTAINERS else 1.0)
        p.chars += n.chars
        p.links += n.links
    return out


def read(page: str) -> Page:
    """The page parsed; weak names, then forms, count as content where nothing else is left."""
    out = parse(page)
    if not out.blocks:
        out = parse(page, weak=False)
    return out if out.blocks else parse(page, weak=False, forms=False)


def _holds(n: Node) -> bool:
    return (n.tag in CONTAINERS or n.parent < 0) and not n.dropped and n.first < n.last


def _plain(chars: int, links: int) -> bool:
    return 2 * links <= chars


def best(page: Page) -> int:
    """The container that holds the article: that with most text close to it (the first of equals), or what around it is marked or named as the article, or else what holds it with plain text only."""
    nodes = page.nodes
    bonus = lambda n: n.score * (1.6 if n.tag in ("article", "main") else 1.0) * (1.2 if n.good else 1.0)
    k = max((k for k, n in enumerate(nodes) if _holds(n)), key=lambda k: bonus(nodes[k]))
    around = []
    up = k
    while up > 0:
        if nodes[up].tag in CONTAINERS and nodes[up].tag not in ("html", "body"):
            around.append(up)
        up = nodes[up].parent
    for marked in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.good):
        found = [x for x in around if marked(nodes[x])]
        if found:
            return found[-1]
    for x in around:
        if not _plain(nodes[x].chars - nodes[k].chars, nodes[x].links - nodes[k].links):
            break
        k = x
    return k


def path_of(page: Page, k: int) -> str:
    steps = []
    while k > 0:
        steps.append(page.nodes[k].step)
        k = page.nodes[k].parent
    return "/".join(["", *reversed(steps)])


def extract(html: str, path: int | None) -> str:
    """Blocks of the elements at that path, or of the page's own best container and its like, joined by an empty line.

    Where those elements are no article or main, paragraphs and headings that stand right in an element around them count too.
    """
    page = read(html)
    nodes = page.nodes
    if not page.blocks:
        return ""
    own = [k for k, n in enumerate(nodes) if n.path == path and _holds(n)]
    if not own:
        k = best(page)
        path = nodes[k].path
        own = [j for j, n in enumerate(nodes) if n.path == path and _holds(n)]
    own = [k for k in own if _plain(nodes[k].chars, nodes[k].links)] or own
    taken = bytearray(len(page.blocks))
    around = set()
    for k in own:
        taken[nodes[k].first : nodes[k].last] = b"\x01" * (nodes[k].last - nodes[k].first)
        if not nodes[k].inside:
            up = nodes[k].parent
            while up >= 0 and up not in around:
                around.add(up)
                up = nodes[up].parent
    if around:
        for i, (k, text, links) in enumerate(page.blocks):
            if not taken[i] and (k in around or nodes[k].parent in around) and nodes[k].tag in LOOSE and nodes[k].tag not in CONTAINERS and _plain(len(text), links):
                taken[i] = 1
    return "\n\n".join(text for i, (_, text, _) in enumerate(page.blocks) if taken[i])


def host_of(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path_id, path, n_pages and score: how many of the host's pages have their best container there."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = {"host": [], "path_id": [], "path": [], "score": []}
            for host, t in zip(b.column(0).to_pylist(), as_text(b.column(1)), strict=True):
                page = read(t) if t else None
                if page and page.blocks:
                    k = best(page)
                    for name, x in zip(rows, (host, page.nodes[k].path, path_of(page, k), page.nodes[k].score), strict=True):
                        rows[name].append(x)
            yield pa.RecordBatch.from_pydict({n: pa.array(x, t) for (n, x), t in zip(rows.items(), (pa.string(), pa.int64(), pa.string(), pa.float64()), strict=True)})

    named = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path_id long, path string, score double")
    return named.groupBy("host", "path_id").agg(F.min("path").alias("path"), F.count("*").alias("n_pages"), F.sum("score").alias("score"))


def winners(counted: DataFrame) -> DataFrame:
    """host, path_id and path: most pages, ties to the smaller path."""
    top = F.min(F.struct((-F.col("n_pages")).alias("n"), "path", "path_id"))
    return counted.groupBy("host").agg(top.alias("top")).select("host", "top.path_id", "top.path")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """key, url, text, n_chars, host and path (the host's winning path), one row per row of pages."""
    elected = settle(winners(votes(pages, url, html)))
    small = F.broadcast(elected) if elected.count() <= broadcast_hosts else elected
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for b in batches:
            text = [extract(t, p) if t else "" for t, p in zip(as_text(b.column(2)), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), b.column(3), b.column(5)], names=[key, url, "text", "n_chars", "host", "path"])

    joined = pages.select(F.col(key).alias(key), F.col(url).alias(url), F.col(html).alias("html"), host_of(url).alias("host")).join(small, "host", "left")
    return joined.select(key, url, "html", "host", "path_id", "path").mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long, host string, path string")
