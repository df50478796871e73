"""Main-text extraction by consensus of a host's pages.

Each page is parsed once to score its containers: text in paragraphs and
headings directly inside counts fully, a level further in by half, less the
text in links.  A container's path is its chain of ``tag.class`` names with
numbers generalised, kept as a 64-bit hash of the parent's hash and the last
name; lists and quotations are part of the container around them.  Each page
votes for its best path, weighted by text, and tells which paths hold text on
it; both are summed per host in Spark (partial sums first, so a hot host is a
row a task).  A host's winning paths are the one of most weight and all that
win on half of the pages that have them, on two at least; a path that stands on
less than ``SHARE`` of the host's pages has no say, so a host has a bounded
number of paths, however many pages it has.  Every page is then
re-extracted from the winning path with the most text on it.  It uses its own
best container instead if it has no text on a winning path, or less than half
as much as there; but not if the host's pages outvote that container (it wins
on fewer than half of the pages that have it) and there is a winning path.

Left out: scripts, styles, forms, navigation, asides, footers, page headers
(outside an article), and containers named (class, id or role) as menus,
adverts, notices, sidebars, comments and the like.  A name counts when such a
word is its first or last part ("sidebar-left", "site-footer"; not
"text-social-history"), unless it says "with", "has", "no" or the like.  What
holds the page's main text is never left out: the article (or ``main``, or a
container named as content; without any, the container of most text) is looked
for on the whole page, text inside a marked container counting less and readers'
comments not at all, and everything around the best one stays.  Character references are decoded,
white space in a block becomes one space, blocks are joined in page order by one
space; nothing else is dropped (``math``, ``svg``, ``noscript`` and the like are
text), and nothing is cut.  Time and memory grow in proportion to the page.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own (the empty name); repeated pages vote and are extracted each; broken
nesting is closed at the nearest open tag of that name; ties between paths go to
the smaller hash; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import url_filter
from .common import saved, small_or_shuffled

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")
#: Fixed lists of HTML's elements by their part in a page.
RAW = {"script", "style", "template", "textarea", "head", "title", "select", "button"}
HIDING = {"script", "style", "textarea", "template"}
DROPPED = {"nav", "aside", "footer", "form", "menu", "dialog"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "header", "table", "tbody", "tr", "td", "th", "ul", "ol", "dl", "li", "blockquote", "figure", "center", "details", "fieldset"} | DROPPED
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dt", "dd", "figcaption", "br", "hr", "address", "caption", "summary"}
#: Parts of running text: what is in them counts for the container around them, and they get no vote.
LISTS = {"ul", "ol", "dl", "li", "blockquote"}
#: Words of classes and ids that mark parts that are not the article; of readers' comments; of the article; and words that deny one.
ASIDE = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget ad ads advert adverts advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "recommendations tags pagination pager toolbar skip copyright legal disclaimer".split()
)
REMARKS = {"comment", "comments", "replies", "reply", "disqus", "discussion", "respond"}
ARTICLE = {"article", "post", "entry", "content", "story", "main", "body", "text"}
DENY = {"with", "has", "no", "without", "not", "hide", "hidden"}
_PART = re.compile(r"[_-]+")


#: Share of a host's pages that a path must stand on.
SHARE = 0.001


def named(said: list[str]) -> tuple[int, bool]:
    """What a container's names say: 0, 1 (an aside) or 2 (readers' comments); and whether it is the article."""
    mark, article = 0, False
    for name in said:
        parts = [x for x in _PART.split(name.lower()) if x]
        if not parts:
            continue
        article = article or any(x in ARTICLE for x in parts)
        if not DENY.intersection(parts):
            for x in (parts[0], parts[-1]):
                x = x.rstrip("0123456789") or x
                mark = max(mark, 2 if x in REMARKS else 1 if x in ASIDE else 0)
    return mark, article


class Page:
    """A parsed page: containers in the order of their start, and runs of text ``(container, block, text, links around it)``."""

    def __init__(self, html: str):
        self.path, self.parent, self.bonus = [0], [-1], [1.0]
        #: 0 plain, 1 left out unless the main text is inside, 2 readers' comments.
        self.mark, self.core = [0], [False]
        self.runs: list[tuple[int, int, str, int]] = []
        self._parse(html)
        self._keep()

    def _open(self, tag: str, rest: str, parent: int) -> int:
        names = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(rest)} if "=" in rest else {}
        classes = names.get("class", "")
        said = f"{classes} {names.get('id', '')} {names.get('role', '')}".split()
        mark, article = named(said) if said and tag not in ("html", "body") else (0, False)
        core = tag in ("article", "main") and not mark
        if tag in ("article", "main") and mark < 2:
            mark = 0
        inside = self._inside[parent] or core or (article and not mark)
        if tag in DROPPED or (tag == "header" and not self._inside[parent]):
            mark = max(mark, 1)
        self.path.append(xxhash.xxh64_intdigest(f"{tag} {' '.join(sorted(_NUMBER.sub('N', classes).lower().split()))}", self.path[parent]))
        self.parent.append(parent)
        self.bonus.append(0.0 if tag in LISTS else 1.5 if core or (article and not mark) else 1.0)
        self.mark.append(2 if self.mark[parent] == 2 else mark)
        self.core.append(core or (article and not mark and tag not in LISTS))
        self._inside.append(inside)
        return len(self.path) - 1

    def _parse(self, html: str) -> None:
        self._inside = [False]
        stack: list[tuple[str, int]] = [("", 0)]
        opened: dict[str, int] = {}
        unclosed: set[str] = set()
        block, link, svg, at, n = 0, 0, 0, 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if not m:
                self.runs.append((stack[-1][1], block, html[at:], link))
                break
            if m.start() > at:
                self.runs.append((stack[-1][1], block, html[at : m.start()], link))
            at = m.end()
            tag = m.group(2)
            if not tag:
                continue
            tag, closing, rest = tag.lower(), bool(m.group(1)), m.group(3)
            if tag in RAW and not (tag == "title" and svg):
                if not closing and not rest.endswith("/"):
                    end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    # An unclosed script or style hides the rest; of the others only the tag goes.
                    if end:
                        at = end.end()
                    elif tag in HIDING:
                        at = n
                    else:
                        unclosed.add(tag)
                block += 1
            elif tag in CONTAINERS:
                block += 1
                if closing:
                    if opened.get(tag):
                        while True:
                            name, _ = stack.pop()
                            opened[name] -= 1
                            if name == tag:
                                break
                else:
                    if tag == "li" and stack[-1][0] == "li":
                        stack.pop()
                        opened["li"] -= 1
                    i = self._open(tag, rest, stack[-1][1])
                    if not rest.endswith("/"):
                        stack.append((tag, i))
                        opened[tag] = opened.get(tag, 0) + 1
            elif tag in BLOCKS:
                block += 1
                if tag == "p" or tag[0] == "h":
                    link = 0
            elif tag == "a":
                link = max(0, link + (-1 if closing else 1))
            elif tag == "svg" and not rest.endswith("/"):
                svg = max(0, svg + (-1 if closing else 1))

    def _keep(self) -> None:
        """Score of every container, and which are kept."""
        n = len(self.path)
        own, linked = [0.0] * n, [0.0] * n
        for c, _, text, link in self.runs:
            size = len(text) - text.count(" ")
            own[c] += size
            linked[c] += size * min(link, 1)
        plain = [max(0.0, a - 2 * b) for a, b in zip(own, linked, strict=True)]
        home = []
        for i in range(n):
            home.append(i if self.bonus[i] else home[self.parent[i]])
        whole, around = plain[:], [False] * n  # text with all inside; whether a marked container is around or itself
        for i in range(n):
            around[i] = self.mark[i] > 0 or (i > 0 and around[self.parent[i]])
        for i in range(n - 1, 0, -1):
            if self.mark[i] < 2:
                whole[self.parent[i]] += whole[i]
        cores = [i for i in range(n) if self.core[i] and self.mark[i] < 2 and whole[i] > 0]
        if cores:
            worth = {i: whole[i] * (0.5 if around[i] else 1.0) for i in cores}
        else:
            worth = {i: plain[i] * (0.25 if around[i] else 1.0) for i in range(n) if self.mark[i] < 2 and plain[i] > 0}
        spared, i = set(), max(worth, key=lambda i: (worth[i], -i)) if worth else 0
        while i > 0:
            spared.add(i)
            i = self.parent[i]
        self.kept = [True]
        for i in range(1, n):
            self.kept.append(self.kept[self.parent[i]] and (not self.mark[i] or i in spared))
        self.score: dict[int, float] = {}
        score = [0.0] * n
        for i in range(n):
            if self.kept[i]:
                at = home[i]
                for share in (1.0, 0.5, 0.25):
                    score[at] += share * plain[i]
                    up = self.parent[at]
                    if up < 0 or not self.kept[up]:
                        break
                    at = home[up]
        for i in range(n):
            if self.kept[i]:
                self.score[self.path[i]] = self.score.get(self.path[i], 0.0) + self.bonus[i] * score[i]

    def text(self, path: int) -> str:
        """Text of the outermost containers on the path, without what is left out everywhere."""
        inside = []
        for p, parent, kept in zip(self.path, self.parent, self.kept, strict=True):
            inside.append(kept and (p == path or (parent >= 0 and inside[parent])))
        blocks: list[str] = []
        now, parts = -1, []
        for c, block, text, _ in self.runs:
            if inside[c]:
                if block != now:
                    if parts:
                        blocks.append("".join(parts))
                    now, parts = block, []
                parts.append(text)
        if parts:
            blocks.append("".join(parts))
        clean = (_SPACE.sub(" ", unescape(b)).strip() for b in blocks)
        return " ".join(b for b in clean if b)


def most(total: dict[int, float], paths) -> int:
    return max(sorted(paths), key=total.__getitem__)


def choose(total: dict[int, float], won: int | None, voted: list[int], outvoted: list[int]) -> int:
    """The path to take a page's text from; see the module's first lines."""
    own = most(total, total)
    known = [p for p in {won, *voted} if total.get(p, 0.0) > 0]
    if known:
        best = most(total, known)
        return best if own in outvoted or 2 * total[best] >= total[own] else own
    return won if won in total and own in outvoted else own


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def _vote(batches):
    names = ["host", "path", "weight", "wins", "seen"]
    for batch in batches:
        votes: dict[tuple[str, int], list[int]] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not html:
                continue
            exact = Page(html).score
            total = {p: int(x) for p, x in exact.items() if x >= 1}
            for path in total:
                votes.setdefault((host, path), [0, 0, 0])[2] += 1
            if total:
                path = most(exact, exact)
                vote = votes[host, path]
                vote[0] += total[path]
                vote[1] += 1
        rows = list(votes.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([_signed(k[1]) for k, _ in rows], pa.int64()), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(3))], names)


def _extract(batches, extra: int):
    for batch in batches:
        out = []
        for html, won, *lists in zip(*(batch.column(extra + i).to_pylist() for i in range(4)), strict=True):
            if not html:
                out.append("")
                continue
            page = Page(html)
            voted, outvoted = ([p % (1 << 64) for p in x or ()] for x in lists)
            out.append(page.text(choose(page.score, None if won is None else won % (1 << 64), voted, outvoted)))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(extra)), pa.array(out, pa.string())], ["page_id", "url", "text"])


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, voted, outvoted)``: each host's path of most weight, those that win on half of the pages they are
    on and on two at least, and those that win on fewer."""
    hosts = pages.select(url_filter.host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = hosts.mapInArrow(_vote, "host string, path long, weight long, wins long, seen long")
    # Written, so that pages are parsed once for both uses.
    summed, _ = saved(votes.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("weight", "wins", "seen"))).where("wins > 0"), "votes")
    # Every page with text wins for one path.
    pages_of = summed.groupBy("host").agg(F.sum("wins").alias("pages"))
    summed = summed.join(pages_of, "host").where(F.col("seen") >= F.col("pages") * SHARE)

    def those(which: str) -> F.Column:
        return F.sort_array(F.collect_list(F.expr(f"CASE WHEN {which} THEN path END")))

    return summed.groupBy("host").agg(
        F.min_by("path", F.struct(-F.col("weight"), "path")).alias("path"), those("2 * wins >= seen AND wins > 1").alias("voted"), those("2 * wins < seen").alias("outvoted")
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page; html is read twice, and shuffled (by host) only where
    the hosts' paths are too many to broadcast."""
    won = small_or_shuffled(consensus(pages, url_col, html_col).withColumnRenamed("host", "h"), "paths")
    left = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_filter.host(F.col(url_col)).alias("host"))
    joined = left.join(won, left.host == won.h, "left").select("page_id", "url", "html", "path", "voted", "outvoted")
    return joined.mapInArrow(partial(_extract, extra=2), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
