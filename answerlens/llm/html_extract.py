"""Main text of web pages by tree scoring.

A page becomes a tree of blocks. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts and comments
are known by tag, role, class or id and left out; where a name only holds a listed word among others, or a form holds the
page, the node's share of the page's points decides. Every paragraph passes points for its length and its commas to its
ancestors, less with each level and less the more of it is links; the best container, the article around it and those
siblings that are text rather than links are kept, without lists that are mostly links.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.shared import arrow_map, extended, free_name

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*+)> | <[a-zA-Z/!?][^>]*(?:>|\Z) | (?P<text>[^<]+|<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/]|\Z)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noframes iframe noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("head nav footer aside form button select option datalist dialog menu menuitem noscript template svg math canvas object applet audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner sponsor sponsored sponsors promo promos promotion promoted".split())
CLASSES = ADVERTS | frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav aside footer foot masthead topbar skip "
    "comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing sharebar social related recommended recommendations widget widgets toolbar login search pagination pager "
    "hidden copyright".split()
)
#: Words beside a listed one that leave its meaning as it is: comment-list, site-footer.
PLAIN = frozenset(
    "area areas bar bars block blocks body bottom box boxes btn button buttons card cards column columns container content count dialog entry fixed floating form global group header heading holder "
    "icon icons id inline inner item items js label layer left line link links list lists main message messages meta mobile module no outer page pane panel policy primary right row section secondary "
    "site slot space sticky text thread title top tree unit ul user view wrap wrapper wrappers zone".split()
)
#: A class of its own that says that the article is here.
CONTENT = frozenset("article body content entry main page post story text wrapper container".split())
HOMES = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A class that is only in part of listed words says nothing against these.
LEAVES = HEADINGS | frozenset("p li pre blockquote td th dt dd tr figcaption".split())
#: A start tag here closes an open tag there.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: End of the search for a tag to close.
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
LEVELS, LEAST_CHARS, LINK_LIST, MORE = 6, 25, 0.66, 1.05
WANTED, DOUBTED, UNWANTED = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "block", "out", "doubt", "home", "link", "ended", "parts", "chars", "links", "anchors", "score", "held", "leaves")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        #: The innermost block around an inline node; a block's is itself.
        self.block: Node = parent.block if parent and tag in INLINE else self
        self.out = parent.out if parent else False
        self.doubt = self.ended = False
        self.home = tag in HOMES or (parent.home if parent else False)
        self.link = tag == "a" or (parent.link if parent else False)
        self.parts: list[Node | str] = []
        self.clear()

    def clear(self) -> None:
        self.chars = self.links = self.anchors = self.leaves = 0
        self.score = self.held = 0.0

    @property
    def around(self) -> Node | None:
        """The block around a block."""
        return self.parent.block if self.parent else None


def by_names(names: list[str], home: bool) -> int:
    """What the classes and the id of a node say of it: each name as a whole, so that one listed word in a longer name of
    other words (social-policy-report) only makes a doubt."""
    bad = mixed = content = False
    for name in names:
        parts = [x.lower() for x in PART.findall(name)]
        listed = any(x in CLASSES for x in parts) or parts == ["header"] and not home
        if listed:
            whole = all(x in CLASSES or x in PLAIN for x in parts)
            bad, mixed = bad or whole, mixed or not whole
        content = content or name.lower() in CONTENT
    return UNWANTED if bad and not content else DOUBTED if bad or mixed else WANTED


def verdict(node: Node, attrs: str) -> int:
    """Whether a node isn't part of the article, or may not be, by its tag, role, class or id."""
    tag = node.tag
    if tag == "form":
        return DOUBTED
    if tag in LEFT_OUT or tag == "header" and not node.home:
        return UNWANTED
    if not attrs.strip():
        return WANTED
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and tag != "body" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return UNWANTED
        if name == "role" and value.lower() in ROLES:
            return UNWANTED
        if name == "role" and value.lower() in HOMES or name == "itemprop" and value.lower() == "articlebody":
            node.home = True
        if name in ("class", "id"):
            names += value.split()
    if tag in ("html", "body", "main"):
        return WANTED
    said = by_names(names, node.home)
    return WANTED if said == DOUBTED and tag in LEAVES else said


def parse(page: str, spared: frozenset[int] = frozenset()) -> tuple[Node, list[Node], frozenset[int]]:
    """The tree of a page, its block nodes in page order, and the places of adverts that are never closed; nodes that begin
    at `spared` places are wanted.

    Each token costs a constant time, but for the nodes that it closes.
    """
    top = Node("#", None)
    blocks, adverts, open_nodes, at, end = [top], [], [top], 0, len(page)
    places: dict[str, list[int]] = defaultdict(list)  # by tag: places of the open nodes

    def close(place: int) -> None:
        while len(open_nodes) > place:
            places[open_nodes.pop().tag].pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        now = open_nodes[-1]
        text, tag = m["text"], m["tag"]
        if text is not None:
            now.parts.append(html.unescape(text) if "&" in text else text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if places[tag]:
                open_nodes[places[tag][-1]].ended = True
                close(places[tag][-1])
            elif tag == "br":
                now.parts.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                now.parts.append(" ")
            continue
        if tag not in INLINE:
            block = now.block  # an open paragraph, and what is open in it, ends at a block
            if block.tag == "p" or block.tag in HEADINGS and tag in HEADINGS:
                close(places[block.tag][-1])
            if tag in CLOSES and (found := last(CLOSES[tag])) > last(SCOPES.get(tag, ())):
                close(found)
        node = Node(tag, open_nodes[-1])
        if not node.out and m.start() not in spared:
            said = verdict(node, m["attrs"])
            node.out, node.doubt = said == UNWANTED, said == DOUBTED
            if node.out and tag not in LEFT_OUT and ADVERTS.issuperset(x for x in map(str.lower, PART.findall(m["attrs"])) if x in CLASSES):
                adverts.append((node, m.start()))
        open_nodes[-1].parts.append(node)
        if tag not in INLINE:
            blocks.append(node)
        if not m["attrs"].endswith("/") or tag not in INLINE:
            places[tag].append(len(open_nodes))
            open_nodes.append(node)
    return top, blocks, frozenset(place for node, place in adverts if not node.ended)


def own_text(block: Node) -> tuple[str, int, int]:
    """Text of a block without the blocks in it, characters of it in links, and links."""
    out, linked, anchors, stack = [], 0, 0, [iter(block.parts)]
    owners = [block]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            owners.pop()
        elif isinstance(part, str):
            out.append(part)
            if owners[-1].link:
                linked += len(part.strip())
        elif not part.out:
            if part.tag in INLINE:
                anchors += part.tag == "a"
                stack.append(iter(part.parts))
                owners.append(part)
            else:
                out.append(" ")
    return " ".join("".join(out).split()), linked, anchors


def weigh(blocks: list[Node]) -> None:
    """Points of all blocks; characters, link characters, links, paragraphs and held points include those of inner blocks."""
    for block in blocks:
        block.clear()
    for block in blocks:
        if block.out:
            continue
        text, linked, anchors = own_text(block)
        n = len(text)
        block.chars += n
        block.links += linked
        block.anchors += anchors
        block.leaves += n > 0 and block.tag in LEAVES
        if n >= LEAST_CHARS:
            commas = sum(map(text.count, ",،、，"))
            points = (1 + commas + min(n / 100, 10)) * (1 - min(1.0, linked / n))
            block.held += points
            if block.tag not in ("p", "li", "pre", "blockquote", "td", *HEADINGS):
                block.score += points
            node, level = block.around, 1
            while node is not None and level <= LEVELS:
                node.score += points / level
                node, level = node.around, level + 1
    for block in reversed(blocks):
        node = block.around
        if node is not None and not block.out:
            node.chars += block.chars
            node.links += block.links
            node.anchors += block.anchors
            node.leaves += block.leaves
            node.held += block.held


def settle(top: Node, blocks: list[Node]) -> None:
    """Doubted nodes go unless they hold half of the page's points or more (a form: with an article or a first heading in it)."""
    if not any(b.doubt and not b.out for b in blocks):
        return
    homes: set[int] = set()
    for b in blocks:
        if b.tag in HOMES or b.tag in ("h1", "h2"):
            node = b.around
            while node is not None and id(node) not in homes:
                homes.add(id(node))
                node = node.around
    for b in blocks:  # parents come first
        if b.around is not None and b.around.out:
            b.out = True
        elif b.doubt and not b.out:
            b.out = 2 * b.held < top.held or top.held == 0 or b.tag == "form" and id(b) not in homes


def worth(b: Node) -> float:
    return b.score * (1 - min(1.0, b.links / max(1, b.chars))) * (1.5 if b.tag in HOMES else 1)


def belongs(x: Node | str, best: Node, least: float) -> bool:
    """Whether a node beside the best container is of the article: whatever is text rather than links; beside a whole
    page's container only what looks like text (headings, paragraphs, what has them inside, or many points)."""
    if isinstance(x, str) or x is best:
        return True
    density = x.links / max(1, x.chars)
    if x.out or not x.chars and x.block is x or density >= (0.3 if x.tag in HEADINGS else 0.5):
        return False
    wide = best.parent is None or best.parent.tag in ("#", "html", "body")
    return not wide or x.tag in INLINE or x.leaves > 0 or x.tag in HOMES or worth(x) >= least


def chosen(top: Node, blocks: list[Node]) -> list[Node | str]:
    """What makes up the article, in page order."""
    live = [b for b in blocks if not b.out]
    best = max(live, key=worth, default=top)
    if worth(best) <= 0:  # nothing as long as a paragraph
        homes = [b for b in live if b.tag in HOMES and b.chars]
        return [max(homes, key=lambda b: b.chars)] if homes else [top]
    node: Node | None = best
    while node is not None and node.tag not in HOMES:
        node = node.around
    if node is not None:
        best = node
    else:
        node = best.around  # a list, a table or a long paragraph's own container stands among the rest of the article
        while node is not None and node.tag not in ("#", "html", "body"):
            best = node if node.held > MORE * best.held else best
            node = node.around
    while best.parent is not None and best.parent is not best.around:  # a block in an inline node, such as a link
        best = best.around
    if best.parent is None or best.tag == "body":
        return [best]
    least = max(10.0, worth(best) * 0.25)
    return [x for x in best.parent.parts if belongs(x, best, least)]


def text_of(roots: list[Node | str]) -> str:
    """Text of the nodes in page order; white space, and block boundaries, become one space."""
    out: list[str] = []
    stack: list[Iterator[Node | str]] = [iter(roots)]
    ends = [""]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            out.append(ends.pop())
        elif isinstance(part, str):
            out.append(part)
        elif not part.out and not (part.tag in ("ul", "ol", "div", "section", "table", "dl") and part.anchors > 1 and part.links > LINK_LIST * part.chars):
            gap = "" if part.tag in INLINE else " "
            out.append(gap)
            stack.append(iter(part.parts))
            ends.append(gap)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article of a page; empty if the page is null or has no article, such as one of reader comments alone."""
    if not page:
        return ""
    text, adverts = article(*parse(page))
    if not text and adverts:  # an advert that is never closed may hold all of the page
        text, _ = article(*parse(page, adverts))
    return text


def article(top: Node, blocks: list[Node], adverts: frozenset[int]) -> tuple[str, frozenset[int]]:
    weigh(blocks)
    settle(top, blocks)
    weigh(blocks)
    return text_of(chosen(top, blocks)), adverts


def extract_html(df: DataFrame, page: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per input row: its columns (or `keep`), then text and n_chars (code points); underscores if taken.

    Null and empty pages, and pages without an article, have empty text. Text without tags is one block. Pages are read
    whole, however long. Repeated rows give repeated results; an empty table gives an empty one.
    """
    kept = df.columns if keep is None else list(keep)
    source = df.select(*kept, F.col(page).alias(free_name("page_html", kept)))
    text = free_name("text", kept)
    n_chars = free_name("n_chars", [*kept, text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py()) for p in batch.column(len(kept))]
            new = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*batch.schema.names[: len(kept)], text, n_chars])

    return arrow_map(source, run, extended(df.select(*kept), (text, "string"), (n_chars, "long")))
