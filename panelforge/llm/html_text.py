"""Main text of web pages by consensus host paths.

Each page is read as text blocks under a stack of container elements.  Blocks
inside page furniture (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) or inside hidden elements are left
out.  A class or id tells
furniture unless the word is qualified (``no-sidebar``, ``has-comments``) or
the element, other than adverts and comments, holds all of the page's unlinked
text, or most of it and a title, ``article`` or ``main``: it wraps the page.  Every container scores
the text of its blocks less their link text; the page votes for the
generalised path (tags and classes without digits) of its best one.  Spark
adds up the votes per host, and the second pass extracts, on every page of a
host, the blocks under the winning path; a page without that path falls back
on its own best container.  An article in several parts stays whole: siblings
of the best container that hold a fifth of its unlinked text or more, and few
links, belong to it if at least half of its voters say so.

Scale: the votes are summed within each Arrow batch first, so the shuffle has
one row per host, path and batch however many pages a host has.  The winners
(one short row per host) are broadcast only up to ``BROADCAST_ROWS`` hosts;
beyond that pages and winners meet in a join by host, which adaptive execution
splits for a hot host.  A page costs time and memory linear in its length,
however deep it is nested.  Whole pages, no cap.

Defined results: NULL and empty html give empty text; a NULL or malformed url
counts as one host without a name; unclosed, misnested and truncated markup is
read as far as it goes; equal scores go to the container opened first, equal votes
to the higher score and then the later path in order; repeated rows get the same result
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>|<(?:[a-zA-Z/!?][^>]*)\Z", re.S | re.I)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
CONTAINER = frozenset("article body center div main section table tbody td".split())
ONE_OF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())     # closed by a sibling of its kind
FURNITURE_TAGS = frozenset("head nav footer aside form button select dialog menu object canvas audio video".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|side-?bar|menu|nav|navbar|navigation|"
    r"bread-?crumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|social|share|sharing|related|recommend\w*|widget|comments?|replies|"
    r"respond|disqus|discussion|pagination|pager|toolbar|skip-?link)(?=$|[\s_-])", re.I)
#: a class name that says what a wrapper has or lacks beside its text
QUALIFIED = re.compile(r"(?<![^\s_-])(?:no|non|not|with|without|has|have|hide|sans)[_-]\S*", re.I)
#: furniture that never wraps a page, however long it is
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|newsletter|subscribe|"
    r"comments?|replies|respond|disqus|discussion)(?=$|[\s_-])", re.I)
TITLED = frozenset(("article", "main"))


HIDDEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
SIBLING_SHARE = 0.2            # of the best container's unlinked text, for a sibling to belong to the article
SIBLING_LINKS = 0.25           # at most, of a sibling's text


def _step(tag: str, names: str) -> str:
    """One container of a generalised path: tag and classes without digits."""
    classes = sorted({re.sub(r"[\d>]+", "", c.lower()) for c in names.split()})
    return tag + "".join(f".{c}" for c in classes if c)


def _add_up(own: list[float], parent: list[int]) -> list[float]:
    """Sums over each node's subtree; parents come before their children."""
    total = list(own)
    for k in range(len(total) - 1, 0, -1):
        total[parent[k]] += total[k]
    return total


class Page:
    """Text blocks of one page: (text, link characters, number of the
    container path around it).  Path 0 is the page itself; ``up`` has each
    path's parent, which comes before it, and ``steps`` its last step.  Work and
    memory are linear in the page, however deep it is nested."""

    def __init__(self, html: str):
        self.up, self.steps, self.ids = [0], [""], {}
        read: list[tuple[str, int, int, int]] = []
        # tag, furniture, whether a container, whether furniture by name
        stack: list[tuple[str, bool, bool, bool]] = []
        is_open: dict[str, int] = defaultdict(int)
        # furniture by name: the innermost around the text, parents, and whether it holds the page's title
        named, named_up, topped = 0, [0], [False]
        path = 0
        text: list[str] = []
        linked = links = hidden = 0
        at = 0

        def flush():
            nonlocal text, linked
            if text:
                words = " ".join(entities.unescape("".join(text)).split())
                if words:
                    read.append((words, linked, path, named))
                text = []
            linked = 0

        def pop():
            nonlocal hidden, links, path, named
            if stack[-1][3]:
                flush()
                named = named_up[named]
            tag, furniture, container, _ = stack.pop()
            is_open[tag] -= 1
            hidden -= furniture
            links -= tag == "a"
            if container:
                path = self.up[path]

        for m in TOKEN.finditer(html):
            if m.start() > at and not hidden:
                piece = html[at:m.start()]
                text.append(piece)
                linked += len(piece) if links else 0
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
            if tag == "br":
                if not hidden:
                    text.append(" ")
                continue
            if tag not in INLINE:
                flush()
            if end:
                if is_open[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag in VOID or attrs.endswith("/") and tag in INLINE:
                continue
            if tag in ONE_OF and stack and stack[-1][0] == tag:
                pop()
            names: dict[str, str] = {}
            for k, a, b, c in ATTR.findall(attrs) if attrs else ():
                names.setdefault(k.lower(), a or b or c)
            told = QUALIFIED.sub(" ", f"{names.get('class', '')} {names.get('id', '')}")
            whole = tag in ("html", "body")
            furniture = (tag in FURNITURE_TAGS or tag == "header" and not (is_open["article"] or is_open["main"])
                         or names.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search")
                         or not whole and ("hidden" in names or names.get("aria-hidden", "").lower() == "true"
                                           or bool(HIDDEN.search(names.get("style", "")))))
            if tag in TITLED or tag == "h1":
                topped[named] = True
            by_name = False
            if not furniture and not whole and tag not in TITLED and told.strip() and FURNITURE.search(told):
                if tag in INLINE or ASIDE.search(told):
                    furniture = True
                else:
                    by_name = True
                    named_up.append(named)
                    topped.append(False)
                    named = len(named_up) - 1
            container = tag in CONTAINER
            if container:
                path = self._child(path, _step(tag, names.get("class", "")))
            stack.append((tag, furniture, container, by_name))
            is_open[tag] += 1
            hidden += furniture
            links += tag == "a"
        if not hidden and at < len(html):
            text.append(html[at:])
        flush()
        # furniture by name that holds the title and most of the page's unlinked
        # text, or all of that text, is a wrapper
        held = [0] * len(named_up)
        for words, in_links, _, around in read:
            held[around] += max(len(words) - in_links, 0)
        held = _add_up(held, named_up)
        for k in range(len(topped) - 1, 0, -1):
            topped[named_up[k]] |= topped[k]
        wraps = [True] * len(named_up)
        for k in range(1, len(named_up)):
            wraps[k] = wraps[named_up[k]] and (held[k] == held[0] or topped[k] and 2 * held[k] > held[0])
        self.blocks = [(words, in_links, p) for words, in_links, p, around in read if wraps[around]]

    def _child(self, path: int, step: str) -> int:
        new = self.ids.setdefault((path, step), len(self.up))
        if new == len(self.up):
            self.up.append(path)
            self.steps.append(step)
        return new

    def name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.steps[path])
            path = self.up[path]
        return ">".join(reversed(steps))

    def find(self, name: str) -> int | None:
        path = 0
        for step in name.split(">") if name else ():
            path = self.ids.get((path, step))
            if path is None:
                return None
        return path

    def best(self) -> tuple[str, float, list[str]] | None:
        """Generalised path of the best container (the first opened of
        equals), its score, and the paths beside it that belong to the article:
        siblings with much unlinked text, and ``parent>`` for the blocks
        directly under the common parent."""
        if not self.blocks:
            return None
        n = len(self.up)
        own, chars, links, score, seen = [0.0] * n, [0] * n, [0] * n, [0.0] * n, [False] * n
        for text, linked, p in self.blocks:
            worth = len(text) - 2.0 * linked
            own[p] += worth
            chars[p] += len(text)
            links[p] += linked
            score[p] += worth
            seen[p] = seen[self.up[p]] = True
            if p:
                score[self.up[p]] += worth / 2
        under, size, linked = _add_up(own, self.up), _add_up(chars, self.up), _add_up(links, self.up)
        for p in range(1, n):
            if self.steps[p].split(".", 1)[0] in TITLED and size[p]:
                score[p] += under[p] / 2
                seen[p] = True
        win = max((p for p in range(n) if seen[p]), key=lambda p: (score[p], -p))
        beside, least = [], SIBLING_SHARE * under[win]
        if win and least > 0:
            parent = self.up[win]
            beside = [self.name(p) for p in range(1, n)
                      if self.up[p] == parent and p != win and under[p] >= least and linked[p] <= SIBLING_LINKS * size[p]]
            if own[parent] >= least and links[parent] <= SIBLING_LINKS * chars[parent]:
                beside.append(self.name(parent) + ">")
        return self.name(win), score[win], beside

    def text(self, names: list[str]) -> str:
        """The blocks under any of the paths (directly under it, if it ends in ``>``)."""
        inside, direct = [False] * len(self.up), [False] * len(self.up)
        for name in names:
            p = self.find(name.removesuffix(">"))
            if p is not None:
                (direct if name.endswith(">") else inside)[p] = True
        for p in range(1, len(self.up)):
            inside[p] |= inside[self.up[p]]
        return "\n\n".join(t for t, _, p in self.blocks if inside[p] or direct[p])


def extract(html: str | None, winners: list[str] | None) -> str:
    """Main text of a page: under its host's paths, or else its own."""
    page = Page(html or "")
    if winners and page.find(winners[0]) is not None and (text := page.text(winners)):
        return text
    best = page.best()
    return page.text([best[0], *best[2]]) if best else ""


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the winning container path of every host of
    ``pages(host, html)``, and after it the paths beside it that at least half
    of its voters name."""
    def run(batches):
        for batch in batches:
            votes: dict[tuple[str, str, str | None], list[float]] = defaultdict(lambda: [0, 0.0])
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                best = Page(html).best() if html else None
                if best:
                    for beside in (None, *best[2]):
                        cell = votes[host, best[0], beside]
                        cell[0] += 1
                        cell[1] += best[1]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([k[i] for k in votes], pa.string()) for i in range(3)],
                 pa.array([v[0] for v in votes.values()], pa.int64()),
                 pa.array([v[1] for v in votes.values()], pa.float64())], names=["host", "path", "beside", "votes", "score"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, path string, beside string, votes bigint, score double")
    sums = stored(rows.groupBy("host", "path", "beside").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score")),
                  "host-votes")
    # equal votes: the higher score (in whole characters), then the path
    won = sums.where("beside is null").groupBy("host").agg(
        F.max(F.struct("votes", F.round("score").alias("s"), "path")).alias("w")).select(
        "host", F.col("w.path").alias("path"), F.col("w.votes").alias("most"))
    return (won.join(sums.where("beside is not null").select("host", "path", "beside", "votes"), ["host", "path"], "left")
            .groupBy("host", "path").agg(F.sort_array(F.collect_set(F.when(2 * F.col("votes") >= F.col("most"), F.col("beside"))))
                                         .alias("beside"))
            .select("host", F.concat(F.array("path"), "beside").alias("paths")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of every row of ``pages``."""
    url = F.col(url_col).cast("string")
    src = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html"),
                       F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")).alias("host"))
    winners = stored(host_paths(src), "host-paths")
    joined = src.join(bounded(winners, winners.count()), "host", "left")

    def run(batches):
        for batch in batches:
            text = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string())],
                                             names=["id", "url", "text"])

    out = joined.select("id", "url", "html", "paths").mapInArrow(
        run, f"id {src.schema['id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
