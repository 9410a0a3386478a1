"""Main text of web pages by consensus of each host's pages on a container path.

Every page's containers are scored by the text of their paragraphs, less its links. A container has
a generalised path: the tags from the root with their classes, runs of digits in a class written as
one `#`; it is known by its depth, its last step and a hash of the whole, so that deep pages cost no more
than their elements. Each page votes for the path of its best container; Spark sums the votes of a host, and
every page is then read again with the winning path of its host. A page without that path uses the
host's next paths, at last its own best container, else its body.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role, class or id wherever they stand, and so is what `hidden` or an inline style hides.
A class marks such a part by its last word, or by its first one where that names a part of a page, and by any word that names
comments, adverts, a footer or the like; a class that only says that a page has or lacks such a part marks nothing. An inline
element is left out in the same way, within its block. A form that holds an article is none. A block is the text between the borders of
block elements; its character references are decoded, its white space runs become one space, and
blocks are joined by an empty line. Null html and pages without text give an empty text; a null url
has the host ''. Extra columns are ignored, repeated pages are kept, each with the same text, and count
as votes each. Pages of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_frames, materialize, spread_join

#: Paths that a host hands to its pages, best first, unless asked for otherwise.
PATHS_PER_HOST = 3
#: Hosts up to which their paths are broadcast.
BROADCAST_HOSTS = 200_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z|\"|')", re.I)
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary"
    " table tbody td template tfoot th thead tr ul svg button".split()
)
VOID = frozenset({"hr"})
#: Inline elements without an end.
EMPTY = frozenset("area base br col embed img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside head noscript template select option button menu dialog svg fieldset legend label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Whole tokens of a class or id that mark what is no part of an article.
MARKS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement"
    " advertising banner promo sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription share sharing social related recommended comment comments commentlist reply replies respond disqus"
    " discussion widget login signup toolbar pagination pager skip copyright legal".split()
)
#: Of these, words that mark a part of a page also where they begin a name.
LEADS = MARKS - frozenset("social legal related skip notice notices alert reply replies respond discussion header subscribe".split())
#: And words that mark one wherever they stand in a name.
ANYWHERE = frozenset("comment comments commentlist disqus ad ads advert adverts advertisement advertising sponsored footer breadcrumb breadcrumbs cookie cookies newsletter".split())
#: Words by which a name only says that a page has such a part, or how it is set up.
ABOUT = frozenset("no not non has have with without open closed enabled disabled hide".split())
KEPT = frozenset({"html", "body", "article", "main"})
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)")


class Node:
    """An open block element, or an inline one that is left out; `inside` counts the latter's own and those of its name within it."""

    __slots__ = ("depth", "dropped", "form", "holds", "inside", "parent", "path", "score", "tag")

    def __init__(self, tag: str, step: str, parent: Node | None, dropped: bool, inside: int = 0) -> None:
        self.tag, self.parent, self.dropped, self.score, self.inside = tag, parent, dropped, 0.0, inside
        self.depth = parent.depth + 1 if parent else 0
        self.path = f"{self.depth} {step} {xxhash.xxh64_hexdigest(f'{parent.path}/{step}')}" if parent else ""
        # The outermost form around it, and whether a form holds an article.
        self.form, self.holds = (parent.form if parent else None) or (self if tag == "form" else None), False


def marked(names: str) -> set[str]:
    """The words of MARKS by which a class or id says what an element is."""
    found: set[str] = set()
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and ABOUT.isdisjoint(words):
            found |= MARKS.intersection(words[-1:]) | LEADS.intersection(words[:1]) | ANYWHERE.intersection(words)
    return found


def describe(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's step in a path, and whether it is left out."""
    step, dropped = tag, tag in DROPPED
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "class" and value:
                step += "".join(f".{re.sub(r'[0-9]+', '#', c)}" for c in sorted(set(value.split())))
            if name in ("class", "id") and tag not in {"html", "body"}:
                found = marked(value)
                dropped |= bool(found) and (tag not in KEPT or bool(found & {"comment", "comments", "reply"}))
            dropped |= name == "role" and value in ROLES
            dropped |= name == "hidden" or (name == "style" and bool(HIDDEN.search(value)))
    return step, dropped


def blocks(html: str) -> list[tuple[Node, str, int]]:
    """The text blocks outside of left-out elements: innermost element, text, characters in links."""
    root = node = Node("", "", None, False)
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked, in_link, pos, size = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            # What is left out never gets here; an inline element's block has the text before it.
            owner = node
            while owner.inside:
                owner = owner.parent
            if text := " ".join("".join(parts).split()):
                out.append((owner, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    while pos < size:
        m = TOKEN.search(html, pos)
        end = m.start() if m else size
        if end > pos and not node.dropped:
            text = html[pos:end]
            text = html_lib.unescape(text) if "&" in text else text
            parts.append(text)
            linked += in_link and len(text)
        if not m:
            break
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if not closing and name in RAW:
            close = RAW[name].search(html, pos)
            pos = close.start() if close else size
        elif name == "a" and not (node.inside and node.tag == name):
            in_link = 0 if closing else 1
            if not closing and not node.dropped and describe(name, m[3] or m[6] or "")[1]:
                node = Node(name, name, node, True, 1)
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            if closing:
                at = node
                while at.parent and (at.tag != name or at.inside):
                    at = at.parent
                if at.parent:
                    node, in_link = at.parent, 0
            else:
                in_link = 0
                if node.tag == "p" or (node.tag == name and name in {"li", "tr", "td", "th", "dt", "dd", "option"}):
                    node = node.parent or root
                if name not in VOID:
                    step, dropped = describe(name, m[3] or m[6] or "")
                    node = Node(name, step, node, dropped or node.dropped)
                    if name in {"article", "main"} and node.form and not node.dropped:
                        node.form.holds = True
        elif node.inside and node.tag == name:
            node.inside += -1 if closing else 1
            if not node.inside:
                node, in_link = node.parent, 0
        elif not closing and not node.dropped and name not in EMPTY and describe(name, m[3] or m[6] or "")[1]:
            node = Node(name, name, node, True, 1)
    flush()
    return [x for x in out if not x[0].form or x[0].form.holds]


def home(node: Node) -> Node | None:
    """The outermost article or main that holds node."""
    found = None
    while node.parent:
        if node.tag == "article" or (node.tag == "main" and (found is None or found.tag != "article")):
            found = node
        node = node.parent
    return found


def best_container(parts: list[tuple[Node, str, int]]) -> Node | None:
    """The container with most paragraph text, links aside."""
    scored: dict[int, Node] = {}
    for node, text, linked in parts:
        points = max(0, len(text) - 2 * linked)
        place = home(node)
        near = [(place, 1.0)] if place else [(node.parent if node.tag in {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre"} else node, 1.0)]
        if not place and near[0][0] and near[0][0].parent:
            near.append((near[0][0].parent, 0.5))
        for n, weight in near:
            if n and n.path:
                n.score += points * weight
                scored[id(n)] = n
    return max(scored.values(), key=lambda n: (n.score, -n.depth, n.path), default=None)


def main_text(html: str | None, paths: list[str] | None) -> str:
    """The page's blocks below the first of the paths that it has."""
    parts = blocks(html or "")

    def below(path: str) -> list[str]:
        out = []
        for node, text, _ in parts:
            n: Node | None = node
            while n and n.path != path:
                n = n.parent
            if n:
                out.append(text)
        return out

    for path in paths if paths is not None else []:
        if got := below(path):
            return "\n\n".join(got)
    own = best_container(parts)
    return "\n\n".join(below(own.path) if own else [text for _, text, _ in parts])


def host(url: str = "url") -> Column:
    name = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name)


def host_paths(pages: DataFrame, paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """(host, paths): the paths that most pages of a host voted for, best first."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [best_container(blocks(h or "")) for h in pdf["html"]]
            found = [(h, b.path, b.score) for h, b in zip(pdf["host"], best, strict=True) if b]
            votes = pd.DataFrame(found, columns=["host", "path", "score"])
            yield votes.groupby(["host", "path"], as_index=False).agg(votes=("score", "size"), score=("score", "sum"))

    cast = map_frames(pages.select(host().alias("host"), "html"), vote, "host string, path string, votes long, score double")
    total = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum(F.floor("score")).alias("score"))
    place = F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path"))
    top = total.withColumn("place", place).where(F.col("place") <= paths_per_host)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """Per page: page_id, url, text, n_chars, host and paths (what its host agreed on)."""
    pages = pages.select("page_id", "url", "html")
    agreed = materialize(host_paths(pages, paths_per_host))
    joined = spread_join(pages.withColumn("host", host()), agreed, "host", agreed.count() <= BROADCAST_HOSTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h, list(p) if p is not None else None) for h, p in zip(pdf["html"], pdf["paths"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "host": pdf["host"]})

    return map_frames(joined.select("page_id", "url", "html", "host", "paths"), run, "page_id long, url string, text string, n_chars long, host string", ("page_id",))
