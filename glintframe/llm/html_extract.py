"""Main text of web pages by composite text density."""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import bounded_batches, give_back

#: Elements that never hold main text.
DROPPED = set("script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu head title".split())
#: Words in class, id or role that mark what isn't main text.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer related recommended recommendations share sharing social "
    "comment comments disqus reply replies respond widget toolbar pagination pager login search paywall complementary contentinfo".split()
)
#: Of these, those that mark what holds articles of its own, unless the headline is in it too.
INNER_MARKS = set("comment comments disqus reply replies respond related recommended recommendations ad ads advert adverts advertisement sponsored".split())
#: The same outside an article only: inside one it may hold the headline.
OUTER_MARKS = set("header masthead topbar".split())
BLOCKS = set(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are parts of a line: they belong to their block, and stand for nothing themselves.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADLINES = set("h1 h2 h3 h4 h5 h6 hgroup header".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
#: What may stand in a head: any other element, or text, ends it.
HEADS = set("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: What a start tag ends, if open, up to one of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
P_CLOSERS = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "caption", "dd", "dt"} | {"form", "nav", "footer", "aside", "menu"}
SCOPES = {"table", "td", "th", "caption", "button", "object", "html", "body", "article", "section", "div"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)/?\s*>|([^<]+|<(?![a-zA-Z/!?]))", re.S)
#: A tag whose quotes don't match ends at the next sign that can.
BROKEN = re.compile(r"<(/?)([a-zA-Z]?[^\s/>]*)([^>]*)>()?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "items", "parent", "gone", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.items, self.gone = tag, attrs, parent, [], False
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


def tree(page: str) -> Node:
    """The page's elements and texts, unclosed and stray tags mended. For each tag
    the depths of its open elements are kept, so that time is linear in the page,
    however deep or broken it is."""
    root = Node("html", "", None)
    path, opened = [root], {}  # the open elements; depths of those of a tag

    def close(depth: int) -> None:
        """Leaves the elements from this depth on."""
        while len(path) > depth:
            opened[path.pop().tag].pop()

    def deepest(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.match(page, pos) or BROKEN.match(page, pos)
        if not m:  # an unfinished tag
            break
        pos = m.end()
        closing, tag, attrs, text = m.groups()
        while path[-1].tag == "head" and (text.strip() if text else tag and not closing and tag.lower() not in HEADS):
            close(len(path) - 1)
        if text:
            path[-1].items.append(text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag in ("html", "body"):
            root.attrs += attrs if tag == "body" else ""
            continue
        if tag in P_CLOSERS and opened.get("p") and opened["p"][-1] > deepest(SCOPES):
            close(opened["p"][-1])
        if tag in ENDS:
            over, scope = ENDS[tag]
            edge = deepest(scope)
            first = [depths[bisect.bisect_right(depths, edge)] for depths in (opened.get(t) for t in over) if depths and depths[-1] > edge]
            if first:
                close(min(first))
        node = Node(tag, attrs, path[-1])
        path[-1].items.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = stop.end() if stop else end
        elif tag not in VOID and not m.group().endswith("/>"):
            opened.setdefault(tag, []).append(len(path))
            path.append(node)
    return root


def _elements(root: Node) -> list[Node]:
    """All elements, parents first."""
    out = [root]
    for x in out:
        out.extend(k for k in x.items if not isinstance(k, str))
    return out


def prune(nodes: list[Node]) -> None:
    """Mark what isn't main text by its element, class, id or role, or is hidden."""
    holds, heads = set(), set()  # elements with an article inside, and with a headline, aren't dropped for a name
    for x in nodes:
        for there, tags in ((holds, ("article", "main")), (heads, ("h1",))):
            p = x.parent if x.tag in tags else None
            while p and p not in there:
                there.add(p)
                p = p.parent
    inside = {nodes[0]: False}
    for x in nodes:
        if x.parent is None:
            continue
        inner = inside[x] = inside[x.parent] or x.tag in ("article", "main")
        if x.parent.gone or x.tag in DROPPED or (x.tag == "header" and not inner):
            x.gone = True
        elif x.attrs:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(x.attrs)}
            names = {w.lower() for k in ("class", "id", "role") for w in WORD.findall(html.unescape(found.get(k, "")))}
            style = found.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
            named = names & MARKS or (not inner and names & OUTER_MARKS)
            own = x in holds or x.tag in ("article", "main")
            x.gone = bool(hidden or (named and not own) or (names & INNER_MARKS and x not in heads))


def measure(nodes: list[Node]) -> None:
    """Each element's composite text density, and the sum of its children's, parts of lines left out."""
    for x in reversed(nodes):
        if x.gone:
            continue
        for k in x.items:
            if isinstance(k, str):
                x.chars += len(" ".join(k.split()))
            elif not k.gone:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.chars if k.tag == "a" else k.link_chars
                x.links += k.links + (k.tag == "a")
    body = nodes[0]
    whole = body.link_chars / body.chars if body.chars else 0.0
    for x in nodes:
        if x.gone or not x.chars:
            continue
        x.density = density(x.chars, x.tags, x.link_chars, x.links, whole)
    for x in nodes:
        if not x.gone and x.parent and x.tag not in INLINE:
            x.parent.total += x.density


def density(chars: int, tags: int, link_chars: int, links: int, whole: float) -> float:
    """Composite text density; whole is the body's share of link text."""
    tags, plain = max(tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + whole * chars + math.e)
    return chars / tags * max(math.log(chars / max(link_chars, 1) * tags / max(links, 1)) / max(base, 1e-9), 0.0)


def box_loose_text(p: Node, on: set, whole: float) -> None:
    """Give each run of text and parts of lines that stands in a block beside other blocks
    a block of its own, measured like others, so that it is weighed by itself."""
    items, run = [], []

    def close() -> None:
        if any(isinstance(k, str) and k.strip() for k in run):
            box = Node("div", "", p)
            box.items = list(run)
            for k in run:
                if isinstance(k, str):
                    box.chars += len(" ".join(k.split()))
                elif not k.gone:
                    k.parent = box
                    box.chars, box.tags = box.chars + k.chars, box.tags + k.tags + 1
                    box.link_chars, box.links = box.link_chars + (k.chars if k.tag == "a" else k.link_chars), box.links + k.links + (k.tag == "a")
            box.density = density(box.chars, box.tags, box.link_chars, box.links, whole) if box.chars else 0.0
            items.append(box)
        else:
            items.extend(run)
        run.clear()

    for k in p.items:
        if k in on or not (isinstance(k, str) or k.tag in INLINE):
            close()
            items.append(k)
        else:
            run.append(k)
    close()
    p.items = items


def _path(x: Node) -> list[Node]:
    out = [x]
    while out[-1].parent:
        out.append(out[-1].parent)
    return out


def select(nodes: list[Node]) -> list[Node]:
    """Subtrees that hold the main text, in page order: that with the largest sum of
    densities, and what else hangs on its path to the body and is as dense as the
    path's sparsest element, or a headline before it, or an article like it, and no
    list of links; text that stands loose in a block of the path is weighed alone. Blocks in the chosen subtree that are mostly links, and sparser
    than the path, are marked gone.
    """
    there = [x for x in nodes if not x.gone and x.chars]
    if not there:
        return []
    best = max((x for x in there if x.tag not in INLINE), key=lambda x: (x.total, x.density))
    path = _path(best)
    limit = min((x.density for x in path[:-1]), default=0.0)
    on, links = set(path), lambda x: x.link_chars * 2 > x.chars
    for x in _ordered(best):
        if x is not best and x.tag in BLOCKS and not x.gone and links(x) and x.density < limit:
            x.gone = True
    chosen, whole = {best}, nodes[0].link_chars / nodes[0].chars
    for p in path[1:]:
        box_loose_text(p, on, whole)
        before = True
        for x in p.items:
            if x in on:
                before = False
            elif isinstance(x, Node) and not x.gone and x.chars and not links(x) and (x.density >= limit or (before and x.tag in HEADLINES) or x.tag == best.tag == "article"):
                chosen.add(x)
    out, under = [], set()  # of nested ones the outermost
    for x in _ordered(nodes[0]):
        if x.parent in chosen or x.parent in under:
            under.add(x)
        elif x in chosen:
            out.append(x)
    return out


def _ordered(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(k for k in reversed(x.items) if not isinstance(k, str))


def text_of(nodes: list[Node]) -> str:
    """Blocks' texts, one per line: references decoded, white space made one space."""
    lines, now = [], []

    def flush() -> None:
        line = " ".join(html.unescape("".join(now)).split())
        if line:
            lines.append(line)
        now.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                now.append(x)
            elif x is None:
                flush()
            elif x.gone:
                continue
            elif x.tag in ("br", "wbr"):
                now.append(" " if x.tag == "br" else "")
            else:
                if x.tag in BLOCKS:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.items))
        flush()
    return "\n".join(lines)


def main_text(page: str | None) -> str:
    """The page's article; "" for a null or empty page, or one without text."""
    if not page:
        return ""
    nodes = _elements(tree(page))
    prune(nodes)
    measure(nodes)
    return text_of(select(nodes))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [main_text(x.as_py()) for x in b.column("_page")]
        names = [n for n in b.schema.names if n != "_page"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.string())], names=[*names, "_text"])


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """df without html_col, with text_col, the page's main text, and n_col, its code
    points; columns of these names are replaced.

    Page by page and without a shuffle; a null page has an empty text, repeated
    rows are extracted alike, and a page is never cut short.
    """
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (html_col, text_col, n_col)]
    coded = [f"c{i}" for i in range(len(rest))]  # whatever their names are
    flat = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rest, coded)], F.col(f"`{html_col}`").alias("_page"))
    schema = flat.drop("_page").schema.add("_text", "string")
    out = flat.mapInArrow(give_back(_extract), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(rest, coded)], F.col("_text").alias(text_col), F.length("_text").cast("long").alias(n_col))
