"""Operator 2: main text of web pages by wrappers, union-free regular expressions inferred per host."""

from __future__ import annotations

import bisect
import html
import json
import re
from collections.abc import Callable, Iterator
from operator import add

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, key_of, table, tasks

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|button)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.DOTALL | re.IGNORECASE,
)
LABEL = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements that hold others, and elements that are one block of text.
HOLDERS = frozenset("html head body div section article main nav header footer aside form fieldset dialog ul ol dl table thead tbody tfoot tr figure blockquote details center menu".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary address legend label title".split())
OUTSIDE = frozenset("head nav footer aside form fieldset dialog menu".split())
#: Words of class, id or role that mark what is not the article.
NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|header|masthead|share|sharing|social|related|recommended|pagination|pager|toolbar|"
    r"comments?|commentlist|replies|reply|respond|discussion|disqus|search|contentinfo|complementary)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: The same for elements that are articles by their tag: only words of reader comments count.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|discussion|disqus)(?:$|[\s_-])", re.IGNORECASE)
MAIN = frozenset(("article", "main"))
#: Elements that the search for the article goes down into.
CONTAINERS = frozenset("html body div section article main center details".split())
#: Share of an element's running text that one element in it must hold for the search to go on there; the same for one that is an article by its tag.
MOST, MOST_MAIN = 0.9, 0.7
#: Groups of a wrapper, above which rare labels no longer tell elements apart; labels that then do; groups that a task holds; depth of a path.
GROUPS, LABELS, HELD, DEPTH = 2000, 300, 200_000, 60
#: Bytes of rules that may be broadcast; a host with more than one in SPREAD of all pages is dealt out to several tasks beyond that.
BROADCAST, SPREAD = 32 << 20, 1000

Block = tuple[tuple[str, ...], str, int, bool]


def parse(page: str, kept: frozenset[str] | None = None) -> list[Block]:
    """The blocks of a page in order: (path of open elements, text, characters within links, whether tags or labels say that it is not the article's).

    An element on a path bears its labels: div.ad; numbers of two digits or more are #. With kept, only labels in it. Blocks end where an
    element of HOLDERS or BLOCKS begins or ends; inline elements, unclosed ones included, do not matter. An end
    tag without its begin tag is passed over, and one whose element holds unclosed ones closes them too. What
    lies deeper than DEPTH elements counts as text of the last of them.
    """
    out, stack, parts, link, linked, at = [], [], [], 0, 0, 0  # stack: (tag, element, inside an article, outside of it)

    def flush() -> None:
        nonlocal linked
        if parts:
            if t := " ".join(html.unescape("".join(parts)).split()):
                out.append((tuple(e[1] for e in stack[:DEPTH]), t, linked, bool(stack) and stack[-1][3]))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            s = page[at : m.start()]
            parts.append(s)
            if link:
                linked += len(s)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, ends = tag.lower(), m[2] == "/"
        if tag == "a":
            link = 0 if ends else 1
        elif tag in ("br", "hr"):
            parts.append(" ")
            if tag == "hr":
                flush()
        elif tag in HOLDERS or tag in BLOCKS:
            flush()
            link = 0
            if ends:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if k is not None:
                    del stack[k:]
            elif not m[4].endswith("/"):
                if stack and stack[-1][0] in BLOCKS and (tag in BLOCKS or stack[-1][0] == "p"):
                    stack.pop()
                if tag == "body" and stack and stack[-1][0] == "head":
                    stack.pop()
                label = " ".join(x[1] or x[2] or x[3] for x in LABEL.findall(m[4])) if m[4] else ""
                inside, outside = stack[-1][2:] if stack else (False, False)
                if not outside:
                    told = label and tag not in ("body", "html") and (COMMENT if tag in MAIN else NOT_MAIN).search(label)
                    outside = bool(told) or tag in OUTSIDE or (tag == "header" and not inside)
                label = re.sub(r"[0-9]{2,}", "#", " ".join(label.split())) if tag in HOLDERS else ""
                stack.append((tag, f"{tag}.{label}" if label and (kept is None or label in kept) else tag, inside or tag in MAIN, outside))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def tag_of(element: str) -> str:
    return element.split(".", 1)[0]


# A wrapper is a list of groups [element, repeats, optional, groups within, pages]; a text slot is the group ["#", repeats, optional, hash of its text or None if it varies, characters, of links, pages], and "~" for "#" where tags or labels say that the text is not the article's.
SLOTS = ("#", "~")


def stream(blocks: list[Block]) -> list:
    """The token stream of one page as nested groups; equal neighbours are folded into repeated groups."""
    root: list = []
    opened: list[tuple[str, list]] = []
    for path, text, linked, outside in blocks:
        k = 0
        while k < min(len(path), len(opened)) and opened[k][0] == path[k] and (k < len(path) - 1 or tag_of(path[k]) not in BLOCKS):
            k += 1
        del opened[k:]
        for e in path[k:]:
            group = [e, False, False, [], 1]
            (opened[-1][1] if opened else root).append(group)
            opened.append((e, group[3]))
        (opened[-1][1] if opened else root).append([SLOTS[outside], False, False, xxhash.xxh3_64_hexdigest(text.encode()), len(text), linked, 1])
    return folded(root)


def folded(groups: list) -> list:
    out: list = []
    for g in groups:
        if g[0] not in SLOTS:
            g[3] = folded(g[3])
        if out and out[-1][0] == g[0]:
            out[-1] = unite(out[-1], g, max)
            out[-1][1] = True
        else:
            out.append(g)
    return out


def unite(a: list, b: list, pages: Callable[[int, int], int]) -> list:
    """The group that stands for both: differing texts become a slot, groups within are aligned. pages: add for different pages, max for one."""
    if a[0] in SLOTS:
        return [a[0], a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else None, a[4] + b[4], a[5] + b[5], pages(a[6], b[6])]
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3], pages), pages(a[4], b[4])]


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a and b that are matched, in order: a longest common subsequence, or beyond 90,000 combinations a greedy one."""
    x, y = [g[0] for g in a], [g[0] for g in b]
    if x == y:
        return [(i, i) for i in range(len(x))]
    n, m = len(x), len(y)
    if n * m > 90_000:
        places: dict[str, list[int]] = {}
        for j, e in enumerate(y):
            places.setdefault(e, []).append(j)
        out, last = [], -1
        for i, e in enumerate(x):
            p = places.get(e, [])
            k = bisect.bisect_right(p, last)
            if k < len(p):
                last = p[k]
                out.append((i, last))
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list, pages: Callable[[int, int], int] = add) -> list:
    """The union-free expression for both streams: a mismatch is a group that one side lacks, hence optional, or repeats."""
    out, i, j = [], 0, 0
    for p, q in [*pairs(a, b), (len(a), len(b))]:
        out += [[*g[:2], True, *g[3:]] for g in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(unite(a[p], b[q], pages))
        i, j = p + 1, q + 1
    merged: list = []
    for g in out:
        if merged and merged[-1][0] == g[0]:
            both = unite(merged[-1], g, max)
            both[1], both[2] = True, merged[-1][2] and g[2]
            merged[-1] = both
        else:
            merged.append(g)
    return merged


def size(groups: list) -> int:
    return len(groups) + sum(size(g[3]) for g in groups if g[0] not in SLOTS)


class Wrapper:
    """The expression of one host: pages, groups, and the labels that tell elements apart (None: all).

    Pages whose labels are all their own would let it grow with the host. Above GROUPS groups, only the LABELS
    labels of most pages stay part of an element, and if need be equal elements that are no neighbours become one repeated group.
    No text is lost by that: elements that are told apart less are judged together.
    """

    def __init__(self, pages: int, groups: list, kept: frozenset[str] | None) -> None:
        self.pages, self.groups, self.kept = pages, groups, kept

    def bare(self) -> None:
        def drop(gs: list) -> list:
            for g in gs:
                if g[0] not in SLOTS:
                    tag, _, label = g[0].partition(".")
                    g[0] = g[0] if label in self.kept else tag
                    g[3] = drop(g[3])
            return gs

        self.groups = folded(drop(self.groups))

    def shrink(self) -> Wrapper:
        if size(self.groups) > GROUPS:
            seen: dict[str, int] = {}

            def count(gs: list) -> None:
                for g in gs:
                    if g[0] not in SLOTS:
                        if label := g[0].partition(".")[2]:
                            seen[label] = seen.get(label, 0) + g[4]
                        count(g[3])

            count(self.groups)
            self.kept = frozenset(sorted((x for x, n in seen.items() if n > 1), key=lambda x: (-seen[x], x))[:LABELS])
            self.bare()
            if size(self.groups) > GROUPS:

                def gather(gs: list) -> list:
                    by: dict[str, list] = {}
                    for g in gs:
                        if g[0] in by:
                            by[g[0]] = unite(by[g[0]], g, max)
                            by[g[0]][1] = True
                        else:
                            by[g[0]] = g
                    for g in by.values():
                        if g[0] not in SLOTS:
                            g[3] = gather(g[3])
                    return list(by.values())

                self.groups = gather(self.groups)
        return self

    def add(self, other: Wrapper) -> Wrapper:
        if self.kept != other.kept:
            kept = self.kept if other.kept is None else other.kept if self.kept is None else self.kept & other.kept
            for w in (self, other):
                w.kept = kept
                w.bare()
        self.pages, self.groups = self.pages + other.pages, align(self.groups, other.groups)
        return self.shrink()

    def dump(self) -> str:
        return json.dumps([self.pages, self.groups, None if self.kept is None else sorted(self.kept)])

    @staticmethod
    def load(s: str) -> Wrapper:
        n, groups, kept = json.loads(s)
        return Wrapper(n, groups, None if kept is None else frozenset(kept))


def expression(groups: list) -> str:
    """A wrapper as a regular expression over tokens, without unions."""

    def one(g: list) -> str:
        body = (g[0] if g[3] is None else f"'{g[3]}'") if g[0] in SLOTS else f"<{g[0]}>{expression(g[3])}</>"
        sign = {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}[bool(g[1]), bool(g[2])]
        return f"({body}){sign}" if sign else body

    return " ".join(map(one, groups))


def holder(path: tuple[str, ...]) -> str:
    """The element that holds a block: the last of its path that is not itself a block of text."""
    return "/".join(path[:-1] if path and tag_of(path[-1]) in BLOCKS else path)


def rule(w: Wrapper) -> dict:
    """What the wrapper of a host says: the elements that hold the article (roots), and what else is not the article's.

    Running text is what the slots of a group hold whose text varies between pages, or that most pages lack, less
    twice what is linked; slots that tags or labels rule out hold none. The search for the article starts at
    the top and goes down into an element that holds MOST of the running text, MOST_MAIN if it is an
    article by its tag; varying headings beside it stay. Elements of which each page has but one are
    each searched. Roots that hold most of their text themselves, or are articles by their tag, are
    taken whole. In others, and for pages without any root, holders that are mostly links over all
    pages go (links), and for the whole body also slots whose text never changes and stands on most pages (fixed).
    A host of one page, or one whose every slot is the same, has no constant slots.
    """
    slots: list[tuple[tuple[str, ...], list]] = []

    def walk(gs: list, path: tuple[str, ...]) -> None:
        for g in gs:
            if g[0] not in SLOTS:
                walk(g[3], (*path, g[0]))
            elif g[0] == "#":
                slots.append((path, g))

    walk(w.groups, ())
    some = w.pages > 1 and any(g[3] is None for _, g in slots)
    constant = lambda g: some and g[3] is not None and 2 * g[6] > w.pages
    mass: dict[str, int] = {}
    for path, g in slots:
        if not constant(g):
            mass[holder(path)] = mass.get(holder(path), 0) + g[4] - 2 * g[5]

    def running(g: list) -> int:
        if g[0] in SLOTS:
            return 0 if g[0] == "~" or constant(g) else max(0, g[4] - 2 * g[5])
        return sum(map(running, g[3]))

    def headed(g: list) -> bool:
        return g[0] not in SLOTS and (tag_of(g[0]) in ("h1", "h2", "h3") and running(g) > 0 or any(map(headed, g[3])))

    def search(gs: list, path: tuple[str, ...], pages: int) -> list[tuple[tuple[str, ...], bool]]:
        each = [(running(g), g) for g in gs]
        total = sum(v for v, _ in each)
        inner = sorted(((v, g) for v, g in each if v and tag_of(g[0]) in CONTAINERS), key=lambda x: -x[0])
        below = lambda g: search(g[3], (*path, g[0]), g[4])
        if inner:
            v, top = inner[0]
            if v >= total * (MOST_MAIN if tag_of(top[0]) in MAIN else MOST):
                return below(top) + [((*path, g[0]), True) for n, g in each if g is not top and n and headed(g)]
            if len(inner) > 1 and sum(v for v, _ in inner) == total and all(g[2] for _, g in inner) and sum(g[4] for _, g in inner) <= 1.1 * pages:
                return [r for _, g in inner for r in below(g)]
        own = total - sum(v for v, _ in inner)
        proper = bool(path) and tag_of(path[-1]) not in ("html", "body")
        return [(path, proper and (tag_of(path[-1]) in MAIN or 2 * own >= total > 0))]

    return {
        "roots": [[list(p), whole] for p, whole in search(w.groups, (), w.pages)],
        "links": sorted(h for h, m in mass.items() if m < 0),
        "fixed": [["/".join(path), g[3]] for path, g in slots if constant(g)],
        "kept": None if w.kept is None else sorted(w.kept),
    }


class Rule:
    """A rule() made ready to be applied."""

    def __init__(self, r: dict) -> None:
        self.kept = None if r["kept"] is None else frozenset(r["kept"])
        self.roots = [(tuple(p), whole) for p, whole in r["roots"]]
        self.links, self.fixed = frozenset(r["links"]), frozenset(map(tuple, r["fixed"]))

    def select(self, blocks: list[Block]) -> list[Block]:
        def stays(b: Block, whole: bool, top: bool) -> bool:
            if whole or any(tag_of(e) in MAIN for e in b[0]):
                return True
            return holder(b[0]) not in self.links and not (top and ("/".join(b[0]), xxhash.xxh3_64_hexdigest(b[1].encode())) in self.fixed)

        out, found = [], False
        for b in blocks:
            for p, whole in self.roots:
                if b[0][: len(p)] == p:
                    found = True
                    if stays(b, whole, not p or tag_of(p[-1]) in ("html", "body")):
                        out.append(b)
                    break
        return out if found else [b for b in blocks if stays(b, False, True)]


def main_text(page: str, host: Rule | None) -> str:
    """The article of a page as its host's rule finds it; without a rule, all that tags and labels do not rule out."""
    blocks = [b for b in parse(page, host.kept if host else None) if not b[3]]
    return "\n".join(b[1] for b in (host.select(blocks) if host else blocks))


def wrappers(pages: DataFrame, finish: Callable[[Wrapper], str] = Wrapper.dump) -> DataFrame:
    """(host, pages, wrapper): one union-free expression per host, as JSON (or what finish makes of it), inferred from all its pages.

    Each task folds the pages it reads into one wrapper per host before the shuffle, so a host with a
    third of all pages sends as many wrappers as there are tasks, and folding them is a stream. A task
    holds at most some HELD groups. Alignment may depend on the order of pages only in how groups are split.
    """
    shape = ["host", "pages", "wrapper"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Wrapper] = {}
        total = 0

        def out() -> pd.DataFrame:
            rows = [(h, w.pages, w.dump()) for h, w in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=shape)

        for b in batches:
            for host, page in zip(b["host"], b["html"]):
                old = held.get(host)
                w = Wrapper(1, stream(parse(page if isinstance(page, str) else "", old.kept if old else None)), old.kept if old else None)
                total += size(w.groups)
                held[host] = w.shrink() if old is None else old.add(w)
            if total > HELD:
                total = sum(size(w.groups) for w in held.values())
                if total > HELD // 2:
                    yield out()
                    total = 0
        yield out()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, w = None, None
        for b in batches:
            done = []
            for host, x in zip(b["host"], b["wrapper"]):
                if host != last:
                    if last is not None:
                        done.append((last, w.pages, finish(w)))
                    last, w = host, Wrapper.load(x)
                else:
                    w.add(Wrapper.load(x))
            yield pd.DataFrame(done, columns=shape)
        if last is not None:
            yield pd.DataFrame([(last, w.pages, finish(w))], columns=shape)

    kinds = "host string, pages long, wrapper string"
    part = pages.select(host_of().alias("host"), "html").mapInPandas(fold, kinds)
    return part.repartition(tasks(pages.sparkSession), "host").sortWithinPartitions("host", "wrapper").mapInPandas(merge, kinds)


def host_of() -> F.Column:
    return key_of(F.lower(F.regexp_extract(F.col("url"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)))


def ruled(pages: DataFrame, rules: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """pages with the rule of their host. Rules of at most `broadcast` bytes go to every task, so that no page is moved; beyond
    that pages meet them by host, and those of a host with a large share of all pages by host and part."""
    total, held = rules.agg(F.sum("pages"), F.sum(F.octet_length("host") + F.octet_length("rule"))).first()
    if (held or 0) <= broadcast:
        return pages.join(F.broadcast(rules.select("host", "rule")), "host", "left")
    share = max(1, total // SPREAD)
    parts = F.ceil(F.col("pages") / share).cast("int")
    hot = rules.where(F.col("pages") > share).select("host", parts.alias("parts"))  # fewer than SPREAD rows
    pages = pages.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    dealt = rules.select("host", "rule", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return pages.join(dealt.hint("merge"), ["host", "part"], "left").drop("part")


def extract(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """One row per page (page_id, url, html): page_id, url, text, n_chars. Null and empty html give an empty text; null urls share a host.

    Repeated rows stay rows, other columns are not looked at, an empty table gives none. A page of any length is parsed
    whole, in one task.
    """
    rules = durable(wrappers(pages, lambda w: json.dumps(rule(w))).withColumnRenamed("wrapper", "rule"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Rule] = {}
        for b in batches:
            out = []
            for page, r in zip(b["html"], b["rule"]):
                if isinstance(r, str) and r not in known:
                    known = {} if len(known) > 500 else known
                    known[r] = Rule(json.loads(r))
                out.append(main_text(page if isinstance(page, str) else "", known.get(r)))
            yield b[["page_id", "url"]].assign(text=out, n_chars=[len(t) for t in out])

    x = ruled(pages.select("page_id", "url", "html", host_of().alias("host")), rules, broadcast).drop("host")
    return x.mapInPandas(each, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
