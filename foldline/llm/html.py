"""Main text of web pages by consensus of each host.

Every page is parsed into containers, whose generalised tag-class paths are scored by their text.  A page votes for the path
of its densest container and names what else it has: the texts of containers outside.  Spark counts the votes of each host,
and which texts outside the winning path return on pages of different content.  Pages are then extracted again: by the
host's winning path, where nothing but link lists and such returning texts lies outside it; else, as nothing of a page may be lost,
by the page's own best container without the returning texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is raw text up to their own end tag.
RAW = frozenset("script style textarea title".split())
#: Their content is no text of the page, unless they are left open until their parent ends.
MUTE = frozenset("noscript template svg iframe select button canvas object xmp noembed annotation annotation-xml".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary address legend".split())
CONTAINER = frozenset("html body article main section div nav aside header footer form table tbody thead tfoot tr ul ol dl figure details dialog fieldset center menu hgroup search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("nav aside footer dialog menu search head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar aside widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social related recommended recommendations comment comments "
    "disqus discussion reply replies respond reader login search form copyright disclaimer skip topbar".split()
)
LISTS = frozenset("ul ol dl table thead tbody tfoot tr".split())
#: A block of which less is outside links is part of a link list (headings aside).
LINKS = 0.2
GOOD_WORDS = frozenset("article content post entry story main body text".split())
#: Words that say nothing about what a class is for.
NEUTRAL = frozenset(
    "box wrap wrapper container area block section list item items inner outer top bottom left right site page blog home global group holder panel "
    "bar row col column div unit slot zone region module component link links button buttons primary secondary sticky fixed mobile desktop email "
    "google gpt js wp id posts articles stories news".split()
)
#: Noise by their class, but a subject of its own as the id of a section.
TOPICS = frozenset(
    "advertising sponsor promotion consent notice notices notification alert subscription share sharing social related recommended recommendations "
    "discussion reply replies respond reader login search form copyright disclaimer".split()
)
#: Besides containers, elements that can hold others and be noise by their class.
HOLDERS = frozenset("li dd td th blockquote".split())
#: Noise by class, id or form is outweighed by what the page holds; other noise is not.
SOFT, HARD = 1, 2


@lru_cache(1 << 16)
def purpose(token: str) -> tuple[bool, bool, bool]:
    """Whether a class or id as a whole names noise, noise that is no topic, and content."""
    words = {w.lower() for w in _WORDS.findall(token) if len(w) > 1}
    bad = words & NOISE_WORDS
    noise = bool(bad) and words <= NOISE_WORDS | NEUTRAL | GOOD_WORDS or words - NEUTRAL == {"header"} and "page" not in words
    return noise, noise and not bad <= TOPICS, bool(words & GOOD_WORDS) and words <= GOOD_WORDS | NEUTRAL


class Tags:
    """The tags of a page, one after another, in time linear in the page.

    A quoted value may hold ``>``.  Where quotes leave a tag without an end, it and all later ones end at their first ``>``;
    what has no ``>`` at all is text.
    """

    __slots__ = ("source", "last", "strict")

    def __init__(self, source: str):
        self.source, self.last, self.strict = source, source.rfind(">"), True

    def _end(self, at: int) -> int:
        """Behind the ``>`` that ends a tag whose name ends at ``at``."""
        source = self.source
        if self.strict:
            k = at
            while m := _STOP.search(source, k):
                if m[0] == ">":
                    return m.end()
                k = source.find(m[0], m.end()) + 1
                if not k:
                    break
            self.strict = False
        return source.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether an end tag, name in lower case and attributes of the next tag; comments have no name."""
        source = self.source
        while (begin := source.find("<", at)) >= 0:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(source), False, "", ""
            if begin >= self.last:
                return None
            if source[begin + 1] in "!?":
                return begin, source.find(">", begin) + 1, False, "", ""
            if m := _NAME.match(source, begin):
                end = self._end(m.end())
                return begin, end, bool(m[1]), m[2].lower(), source[m.end() : end - 1]
            at = begin + 1
        return None


class Page:
    """Blocks of a page and the containers they lie in."""

    __slots__ = ("blocks", "parent", "label", "noise", "undivided", "good", "own", "kind", "kinds")

    def __init__(self, source: str):
        self.parent, self.label, self.noise, self.undivided, self.good, self.own = [-1], [""], [False], [False], [False], [0]
        #: Which path each container has: (path of the parent, label) by number, 0 the page.
        self.kind, self.kinds = [0], {}
        self.blocks: list[tuple[int, str, int]] = []
        headings = self._parse(source)
        self._settle()
        self.blocks = [b for k, b in enumerate(self.blocks) if not self.noise[b[0]] or (k in headings and self._titled(b[0]))]

    def _parse(self, source: str) -> set[int]:
        """All blocks, those in noise too; gives the numbers of headings."""
        headings: set[int] = set()
        stack: list[tuple[str, int]] = [("", 0)]
        text: list[str] = []
        linked, in_link, leaf, at = 0, 0, "", 0
        scan = Tags(source).next
        opened: Counter = Counter()  # tags on the stack
        muted: list[tuple[str, int]] = []  # the open MUTE element and what is open in it, with where they began
        within: Counter = Counter()  # their tags
        open_ended: set[int] = set()  # where MUTE elements begin that have no end
        before = 0  # where the content of the outermost begins

        def close() -> None:
            nonlocal linked
            if text:
                body = " ".join(unescape("".join(text)).split())
                node = stack[-1][1]
                if body:
                    if leaf in HEADINGS:
                        headings.add(len(self.blocks))
                    self.blocks.append((node, body, 0 if leaf in HEADINGS else linked))
                text.clear()
            linked = 0

        while at < len(source) or muted:
            m = scan(at)
            # The end of an element around the open MUTE one.
            if muted and (not m or m[2] and not within[m[3]] and (m[3] == leaf or (m[3] in CONTAINER or m[3] in LEAF) and opened[m[3]])):
                open_ended.update(x for t, x in muted if t in MUTE)
                muted.clear()
                within.clear()
                at = before
                continue
            if not m:
                text.append(source[at:])
                break
            begin, end, closing, tag, attrs = m
            if begin > at and not muted:
                piece = source[at:begin]
                text.append(piece)
                if in_link:
                    linked += len(piece.strip())
            at = end
            if not tag:
                continue
            if tag in RAW and not closing:
                if not (tag in ("script", "style", "title") and attrs.endswith("/") and within["svg"]):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if muted:
                if not closing:
                    if tag in CONTAINER or tag in LEAF or tag in MUTE and not (tag == "svg" and attrs.endswith("/")):
                        muted.append((tag, begin))
                        within[tag] += 1
                elif within[tag]:
                    while True:
                        last = muted.pop()
                        within[last[0]] -= 1
                        if last[0] == tag:
                            break
                        if last[0] in MUTE:
                            open_ended.add(last[1])
                continue
            if tag in MUTE:
                if not closing and not (tag == "svg" and attrs.endswith("/")) and begin not in open_ended:
                    muted.append((tag, begin))
                    within[tag] += 1
                    before = at
                continue
            if closing:
                if tag == "a":
                    in_link = 0
                elif tag in CONTAINER:
                    if opened[tag]:
                        close()
                        leaf, in_link = "", 0
                        while True:
                            last = stack.pop()[0]
                            opened[last] -= 1
                            if last == tag:
                                break
                elif tag in LEAF:
                    close()
                    leaf = ""
                    if stack[-1][0] == tag:
                        opened[stack.pop()[0]] -= 1
                continue
            if tag in VOID:
                text.append(" ")
                continue
            if tag == "a":
                in_link = 1
            elif tag in CONTAINER or tag in LEAF:
                close()
                in_link = 0
                if stack[-1][0] in LEAF:
                    if not (stack[-1][0] in ("li", "td", "th", "dd", "blockquote") and tag in ("p", "ul", "ol", "div", "table", "blockquote", "h2", "h3", "h4", "dl", "figure", "section")):
                        opened[stack.pop()[0]] -= 1
                leaf = tag if tag in LEAF else ""
                label, own, undivided, good = self._kind(tag, attrs)
                if tag in CONTAINER or own:
                    up = stack[-1][1]
                    self.parent.append(up)
                    self.label.append(label)
                    self.own.append(own)
                    self.undivided.append(undivided)
                    self.good.append(good)
                    self.kind.append(self.kinds.setdefault((self.kind[up], label), len(self.kinds) + 1))
                    stack.append((tag, len(self.parent) - 1))
                    opened[tag] += 1
                elif tag in ("li", "td", "th", "dd", "blockquote"):
                    stack.append((tag, stack[-1][1]))
                    opened[tag] += 1
            elif attrs and self._kind(tag, attrs)[1]:  # an inline element that is hidden or noise by its role
                close_at = source.find("<", at)
                if close_at >= 0 and (end_tag := _NAME.match(source, close_at)) and end_tag[1] and end_tag[2].lower() == tag:
                    at = source.find(">", close_at) + 1 or close_at
        close()
        return headings

    def _settle(self) -> None:
        """Which containers are noise, now that it is known where the page's text lies."""
        n, parent, own = len(self.parent), self.parent, self.own
        hard = [False] * n
        for node in range(1, n):
            hard[node] = own[node] == HARD or hard[parent[node]]
        mass = [0] * n
        for node, body, linked in self.blocks:
            if not hard[node] and len(body) - linked >= LINKS * len(body):
                mass[node] += len(body)
        alone = mass.copy()
        for node in range(n - 1, 0, -1):
            mass[parent[node]] += mass[node]
        noise, kept = [False] * n, 0
        for node in range(1, n):
            noise[node] = noise[parent[node]] or own[node] == HARD
            if own[node] == SOFT and not noise[node]:
                most = 2 * mass[node] > mass[0]
                if most and (mass[node] == kept or self.label[node].split(".")[0] == "form" or self._only(node, alone, mass[node])):
                    own[node], kept = 0, mass[node]
                noise[node] = own[node] == SOFT
        if not any(not noise[node] for node, _, _ in self.blocks):  # nothing but forms and classes holds the page's text
            noise = hard
            self.own = [x if x == HARD else 0 for x in own]
        self.noise = noise

    def _only(self, node: int, alone: list[int], mass: int) -> bool:
        """Whether there is no article, and next to nothing in good containers, outside a container."""
        inside, where, beside = [False] * len(alone), [0] * len(alone), 0
        for k in range(1, len(alone)):
            up = self.parent[k]
            inside[k] = inside[up] or k == node or self.own[k] > 0
            where[k] = max(where[up], 2 if self.undivided[k] else int(self.good[k]))
            if not inside[k] and alone[k]:
                if where[k] == 2:
                    return False
                beside += where[k] * alone[k]
        return 10 * beside < mass

    def _titled(self, node: int) -> bool:
        """A header inside an article keeps its headings."""
        while node >= 0 and self.noise[node]:
            if self.own[node] and self.label[node].split(".")[0] != "header":
                return False
            node = self.parent[node]
        return node > 0 and self.inside(node)

    def inside(self, node: int) -> bool:
        while node > 0:
            if self.label[node].split(".")[0] in ("article", "main"):
                return True
            node = self.parent[node]
        return False

    def _kind(self, tag: str, attrs: str) -> tuple[str, int, bool, bool]:
        """Label, own noise, whether an article, and whether its class or id names content."""
        label, undivided, named, good = tag, tag in ("article", "main"), tag == "form", False
        noise = tag in NOISE_TAGS or tag == "header"
        if attrs and "=" in attrs or "hidden" in attrs:
            names: list[str] = []
            for m in _ATTR.finditer(attrs):
                key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    if tag in CONTAINER or tag in HOLDERS:
                        topical = tag in HOLDERS or key == "id" and (tag == "section" or re.search(r"\bsection\b", attrs) is not None)
                        for token in value.split():
                            bad, anyhow, fine = purpose(token)
                            named = named or (anyhow if topical else bad)
                            good = good or fine
                    if key == "class":
                        names += sorted({re.sub(r"\d+", "#", x.lower()).replace(">", "") for x in value.split()})
                elif key == "role":
                    named = named or value.lower() == "form"
                    noise = noise or value.lower() in NOISE_ROLES
                    undivided = undivided or value.lower() in ("main", "article")
                elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value.lower() == "true":
                    noise = True
                elif key == "itemprop" and "articlebody" in value.lower().split():
                    undivided = True
            if names:
                label = ".".join((tag, *names))
        if tag in ("body", "html", "main") and not attrs.strip().lower().startswith("hidden"):
            noise = False
        own = HARD if noise else SOFT if named and not (good or undivided or tag in ("body", "html")) else 0
        return label, own, undivided, good

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(out))

    def best(self) -> tuple[int, float]:
        """The deepest container (or the first of several of one path) outside which only link lists are left, and its text's score.

        An article, a list or a table is never divided, as what lies beside one of its parts belongs to it.
        """
        own, solid = [0.0] * len(self.parent), [0] * len(self.parent)
        for node, body, linked in self.blocks:
            share = 1 - min(1.0, linked / max(1, len(body)))
            own[node] += len(body) * share * share * (1.25 if body[-1:] in ".!?…\"" else 1.0)
            solid[node] += 0 if share < LINKS else len(body)
        for node in range(len(own) - 1, 0, -1):
            own[self.parent[node]] += own[node]
            solid[self.parent[node]] += solid[node]
        children: dict[int, list[int]] = {}
        for node in range(1, len(own)):
            children.setdefault(self.parent[node], []).append(node)
        at = [0]
        while not any(self.undivided[n] for n in at):
            below: dict[str, list[int]] = {}
            for n in at:
                for child in children.get(n, ()):
                    below.setdefault(self.label[child], []).append(child)
            left = sum(solid[n] for n in at)
            whole = [x for x in below.values() if left and sum(solid[n] for n in x) == left]
            if not whole or self.label[whole[0][0]].split(".")[0] in LISTS:
                break
            at = whole[0]
        return at[0], sum(own[n] for n in at)

    def densest(self, least: float = 0.6) -> tuple[str, float]:
        """Path and score of the deepest containers of one path that hold at least that share of the best one's text."""
        node, score = self.best()
        solid = [0] * len(self.parent)
        for n, body, linked in self.blocks:
            solid[n] += 0 if len(body) - linked < LINKS * len(body) else len(body)
        for n in range(len(solid) - 1, 0, -1):
            solid[self.parent[n]] += solid[n]
        children: dict[int, list[int]] = {}
        for n in range(1, len(solid)):
            children.setdefault(self.parent[n], []).append(n)
        at = [n for n in range(len(solid)) if self.kind[n] == self.kind[node]]
        need = least * sum(solid[n] for n in at)
        while need and not any(self.undivided[n] for n in at):
            below: dict[str, list[int]] = {}
            for n in at:
                for child in children.get(n, ()):
                    below.setdefault(self.label[child], []).append(child)
            most = max(below.values(), key=lambda x: sum(solid[n] for n in x), default=[])
            if sum(solid[n] for n in most) < need or not most or self.label[most[0]].split(".")[0] in LISTS:
                break
            at = most
        return self.path(at[0]), score

    def beside(self, path: str) -> tuple[list[tuple[str, int, list[int]]], bool]:
        """(path, hash of the text, numbers of the blocks) of each container outside those of ``path`` that has more than link lists,
        the outermost that holds none of them; and whether such blocks lie outside any of these."""
        kind = self.number(path)
        hit = self.under(kind) if kind is not None else [False] * len(self.parent)
        holds = hit.copy()
        for n in range(len(holds) - 1, 0, -1):
            holds[self.parent[n]] = holds[self.parent[n]] or holds[n]
        top = list(range(len(self.parent)))
        for n in range(1, len(top)):
            up = self.parent[n]
            if not holds[n] and not holds[up]:
                top[n] = top[up]
        found: dict[int, list[int]] = {}
        solid, loose = set(), False
        for k, (n, body, linked) in enumerate(self.blocks):
            if hit[n]:
                continue
            filled = len(body) - linked >= LINKS * len(body)
            if holds[n] or n == 0:
                loose = loose or filled
                continue
            found.setdefault(top[n], []).append(k)
            if filled:
                solid.add(top[n])
        items = []
        for n in sorted(solid):
            text = "\n".join(self.blocks[k][1] for k in found[n])
            items.append((self.path(n), int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), found[n]))
        return items, loose

    def main(self, winner: str | None, returning: dict[str, int]) -> str:
        """The page's text, by its host's winning path and the texts that return beside it."""
        own = self.path(self.best()[0])
        if not winner or self.number(winner) is None:
            return self.text(own)
        items, loose = self.beside(winner)
        again = [x for x in items if returning.get(x[0]) == x[1]]
        if len(again) == len(items) and not loose:
            return self.text(winner) or self.text(own)
        gone = {k for _, _, blocks in again for k in blocks}
        hit = self.under(self.number(own) or 0)
        return "\n".join(b for k, (n, b, _) in enumerate(self.blocks) if hit[n] and k not in gone)

    def number(self, path: str) -> int | None:
        """The number of a path, None where the page doesn't have it."""
        at: int | None = 0
        for label in path.split(">") if path else ():
            at = self.kinds.get((at, label))
            if at is None:
                return None
        return at

    def under(self, kind: int) -> list[bool]:
        """Which containers lie in one of that path, or are one."""
        hit = [kind == 0] * len(self.parent)
        for node in range(1, len(self.parent)):
            hit[node] = hit[self.parent[node]] or self.kind[node] == kind
        return hit

    def text(self, path: str) -> str:
        """The blocks in containers of that path, in page order, one a line."""
        kind = self.number(path)
        return "" if kind is None else "\n".join(self.lines(self.under(kind)))

    def lines(self, hit: list[bool]) -> list[str]:
        return [b for n, b, _ in self.blocks if hit[n]]


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


VOTES = "host string, path string, score double, main long, beside array<struct<path:string,text:long>>"


def votes(pages: DataFrame) -> DataFrame:
    """Of each page (host, html): the path of its densest container, its score, a hash of its text, and what lies beside it."""

    def run(_: dict, b: pa.RecordBatch) -> dict:
        path, score, main, beside = [], [], [], []
        for source in b.column(1).to_pylist():
            page = Page(source or "")
            p, s = page.densest()
            path.append(p)
            score.append(s)
            main.append(zlib.crc32(page.text(p).encode("utf-8", "surrogatepass")))
            beside.append([{"path": q, "text": h} for q, h, _ in page.beside(p)[0]])
        return {"host": b.column(0), "path": path, "score": score, "main": main, "beside": beside}

    return arrow_map(pages.select("host", "html"), run, VOTES).filter("score > 0")


def consensus(voted: DataFrame, least_share: float = 0.5) -> DataFrame:
    """host and its path of most votes (then of most text), where at least that share of the host's pages agree."""
    counted = voted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    top = counted.groupBy("host").agg(F.max(F.struct("n", "score", "path")).alias("top"), F.sum("n").alias("all"))
    return top.filter(F.col("top.n") >= least_share * F.col("all")).select("host", F.col("top.path").alias("winner"))


def returning(voted: DataFrame, winners: DataFrame, least_pages: int = 3, least_share: float = 0.5) -> DataFrame:
    """host and an array of (path, text): the text a container beside the winning path has on most of the host's pages that have
    the container, and on at least ``least_pages`` of different content.  One text a path at most."""
    beside = voted.join(winners.withColumnRenamed("winner", "path"), ["host", "path"], "left_semi").select("host", "main", F.explode("beside").alias("b"))
    each = beside.groupBy("host", F.col("b.path").alias("path"), F.col("b.text").alias("text"), "main").agg(F.count("*").alias("n"))
    each = each.groupBy("host", "path", "text").agg(F.sum("n").alias("n"), F.count("*").alias("contents"))
    top = each.groupBy("host", "path").agg(F.max(F.struct("n", "contents", "text")).alias("top"), F.sum("n").alias("all"))
    top = top.filter((F.col("top.contents") >= least_pages) & (F.col("top.n") >= least_share * F.col("all")))
    return top.groupBy("host").agg(F.collect_list(F.struct("path", F.col("top.text").alias("text"))).alias("returning"))


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = 50_000) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty html gives an empty text; pages without a host vote together; repeated rows each get their row (they count as
    one content); very long pages are parsed whole, in time linear in their length; an empty table gives none.  Hosts'
    winners are broadcast only when counted at ``broadcast_hosts`` at most, else joined by host, a host of many pages being split.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))
    voted = scratch.keep(votes(rows), "votes")
    winners = scratch.keep(consensus(voted), "winners")
    hosts = scratch.keep(winners.join(returning(voted, winners), "host", "left"), "hosts")
    scratch.drop("votes", "winners")
    if hosts.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(hosts), "host", "left")
    else:
        parts = 64
        copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int")).join(copies, ["host", "salt"], "left")

    def run(_: dict, b: pa.RecordBatch) -> dict:
        got = []
        for source, winner, again in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            got.append(Page(source or "").main(winner, {x["path"]: x["text"] for x in again or ()}))
        return {"page_id": b.column(0), "url": b.column(1), "text": got, "n_chars": [len(x) for x in got]}

    return arrow_map(joined.select("page_id", "url", "html", "winner", "returning"), run, "page_id long, url string, text string, n_chars long")
