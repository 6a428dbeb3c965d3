"""Main text of web pages by scoring the tree of their elements.

Text blocks pass points for length and commas to the elements above them; an
element's points are discounted by the share of its text that stands in links,
and by class and id names of menus, comments and the like.
The best container is taken, and around it what is not mostly links.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, ship_package, table

POINTS_UP = (1.0, 0.5, 1 / 3)  # shares of a block's points for its parent, grandparent and the next
MOST_LINKED = 0.5  # share in links of the text of what stands beside the best container
LOWERED, LEAST = 0.5, 1 / 64  # of its points are left to what stands in a form or under an unlikely name, and in many of them

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search
    section select summary table tbody td tfoot th thead tr ul""".split())
JUNK = frozenset("""script style noscript template iframe object svg math canvas audio video head title nav header footer aside
    button select option textarea input fieldset dialog menu search""".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
TEXTUAL = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What the start of these elements closes, within the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
# Words of class and id names; those of the second set say nothing by themselves, those of the third that the element is another.
UNLIKELY = re.compile(
    r"""(?ix) (?: ads? | advert\w* | banner | breadcrumbs? | comments? | cookies? | consent | disqus | dialog | footer
    | gdpr | header | masthead | menu | modal | nav\w* | newsletter | notices? | outbrain | pagination | pager | popup | promo\w*
    | recommend\w* | related | repl(?:y|ies) | share | sharing | sidebar | signup | social | sponsor\w* | subscribe | taboola
    | toolbar | widget ) \d* """)
COMMENT = re.compile(r"(?i)(?:comments?|disqus|repl(?:y|ies))\d*")  # what readers say, also where it is marked up as an article
WRAPPING = re.compile(r"(?i)(?:widget|header)\d*")  # names that page builders give to anything
LAYOUT = frozenset("""area articles bar block body bottom box button buttons col column container content form global group icons inner
    item items left link links list main message outer page posts primary right row secondary section site stories text title top
    wrap wrapper""".split())
ABOUT_OTHERS = frozenset("has no not with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_END_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_COMMAS = re.compile("[,،、，]")
_PARTS = re.compile(r"[-_]+")


class Node:
    __slots__ = ("tag", "parent", "children", "junk", "unlikely", "points", "own", "linked", "block", "inline")

    def __init__(self, tag: str, parent: Node | None, junk: bool, unlikely: int = 0):
        self.tag, self.parent, self.junk, self.unlikely = tag, parent, junk, unlikely
        self.children: list[Node | str] = []
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.inline: Counter[str] = Counter()  # of a block: its inline elements that are open
        self.points = 0.0
        self.own = self.linked = 0  # characters of text below, and of those in links


def _is_junk(tag: str, attributes: str) -> bool:
    if tag in JUNK:
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body", "main"):
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _unlikely(tag: str, attributes: str) -> int:
    """3 where a class or id is made of words for readers' comments, 2 for a form and where one is made of unlikely
    words, 1 where it has one among others, else 0.

    An id that ends in a number is taken for one that was numbered, such as that of a heading.
    """
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return 0
    level = 2 if tag == "form" else 0
    if not attributes or attributes.isspace():
        return level
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        if name not in ("class", "id"):
            continue
        for token in (match[2] or match[3] or match[4] or "").split():
            parts = [p for p in _PARTS.split(token) if p]
            unlikely = [UNLIKELY.fullmatch(p) is not None for p in parts]
            if not any(unlikely) or any(p.lower() in ABOUT_OTHERS for p in parts):
                continue
            whole = all(u or p.isdigit() or p.lower() in LAYOUT for p, u in zip(parts, unlikely))
            if not whole or name == "id" and token[-1].isdigit() or all(
                    WRAPPING.fullmatch(p) for p, u in zip(parts, unlikely) if u):
                level = max(level, 1)
            else:
                level = max(level, 3 if any(map(COMMENT.fullmatch, parts)) else 2)
    return level


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as browsers would roughly do."""
    root = node = Node("#page", None, False)
    at = 0
    blocks: Counter[str] = Counter()  # block elements that are open

    def up_to(found: Node) -> Node:
        """Close all elements up to ``found``."""
        look = node
        while True:
            counts = blocks if look.tag in BLOCK else look.block.inline
            counts[look.tag] -= 1
            if look is found:
                return found.parent or root
            look = look.parent

    def nearest(tags, stops) -> Node | None:
        look = node
        while look.parent is not None and look.tag not in stops:
            if look.tag in tags:
                return look
            look = look.parent
        return None

    while True:
        match = _TAG.search(page, at)
        text = page[at:match.start() if match else len(page)]
        if text:
            node.children.append(html.unescape(text) if "&" in text else text)
        if not match:
            return root
        at = match.end()
        if not match[2]:
            if match[0].startswith("<![CDATA["):
                node.children.append(match[0][9:].removesuffix("]]>"))
            continue
        tag = match[2].lower()
        if match[1]:
            if tag in BLOCK or tag not in VOID:
                # an end tag of an inline element does not reach out of its block; nothing is looked for that is not open
                is_open = blocks[tag] if tag in BLOCK else node.block.inline[tag]
                found = nearest({tag}, set() if tag in BLOCK else BLOCK) if is_open else None
                if found is not None:
                    node = up_to(found)
            continue
        if tag in CLOSES:
            tags, stops = CLOSES[tag]
            while any(blocks[t] for t in tags) and (found := nearest(tags, stops)) is not None:
                node = up_to(found)
        elif tag in BLOCK and blocks["p"] and (found := nearest({"p"}, BLOCK - {"p"})) is not None:
            node = up_to(found)
        new = Node(tag, node, _is_junk(tag, match[3]), _unlikely(tag, match[3]))
        node.children.append(new)
        if tag == "main":  # what is called a sidebar, say, but holds the main part is a wrapper
            look = node
            while look is not None:
                look.junk = look.tag in JUNK
                look.unlikely = 0
                look = look.parent
        if tag in VOID or match[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = _END_OF_RAW[tag].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)  # its content is never text of the page
            continue
        node = new
        (blocks if tag in BLOCK else node.block.inline)[tag] += 1


def _titles(root: Node) -> None:
    """Headers inside an article keep their headings, the article's title, and nothing else."""
    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        if node.tag == "header" and in_article:
            node.junk, titles, inner = False, [], list(reversed(node.children))
            while inner:
                child = inner.pop()
                if isinstance(child, Node) and child.tag in HEADINGS:
                    titles.append(child)
                elif isinstance(child, Node) and not child.junk:
                    inner.extend(reversed(child.children))
            node.children = titles
            for title in titles:
                title.parent = node
        elif not node.junk:
            stack.extend((c, in_article or node.tag == "article") for c in node.children if isinstance(c, Node))


def _blocks(node: Node, out: list[str], left_out: frozenset | set = frozenset()) -> None:
    """Texts of the blocks below ``node`` in page order, without junk and what is left out; inline elements do not break a block."""
    held: list[str] = []

    def flush():
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            out.append(line)

    stack = [iter([node])]
    opened: list[Node] = []
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if opened and opened.pop().tag in BLOCK:
                flush()
        elif isinstance(child, str):
            held.append(child)
        elif child.junk or child in left_out:
            if child.tag in BLOCK:
                flush()
        elif child.tag == "br":
            held.append(" ")
        else:
            if child.tag in BLOCK:
                flush()
            opened.append(child)
            stack.append(iter(child.children))
    flush()


def _text_length(text: str) -> int:
    return len(" ".join(text.split()))


def _measure(root: Node) -> list[Node]:
    """Count the text, and that in links, of all elements outside junk; returns them in page order."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.junk)
    for node in reversed(nodes):  # children before parents
        node.own = node.linked = 0
        node.points = 0.0
        for child in node.children:
            if isinstance(child, str):
                node.own += _text_length(child)
            elif not child.junk:
                node.own += child.own
                node.linked += child.linked
        if node.tag == "a":
            node.linked = node.own
    return nodes


def _is_dense(node: Node) -> bool:
    return node.linked > MOST_LINKED * node.own


def _cut(root: Node) -> list[Node]:
    """Make junk of unlikely elements, whatever their size; returns them.

    What is called comments goes whole, articles in it and articles called so too. What else has an unlikely
    name, or is a form, goes unless it holds an article that is no comment; a form stays also if it holds the
    page's main heading, as one around a whole page does. Where the name has other words too, or is one that
    page builders give to anything, only blocks go whose text is mostly links.
    """
    nodes = _measure(root)
    if not any(n.unlikely for n in nodes):
        return []
    comments, holders, seen = set(), set(), set()
    for node in nodes:  # parents before children
        if node.unlikely == 3 or node.parent in comments:
            comments.add(node)
        elif node.tag == "article" and not _is_dense(node):
            look = node.parent
            while look is not None and look not in holders:
                holders.add(look)
                look = look.parent
        elif node.tag == "h1":
            look = node.parent
            while look is not None and look not in seen:
                seen.add(look)
                look = look.parent
    holders |= {node for node in seen if node.tag == "form"}
    cut = []
    for node in nodes:
        if node.unlikely == 3:
            node.junk = True
        elif not node.unlikely or node.tag == "article" or node in holders:
            continue
        elif node.unlikely == 2 or node.tag in BLOCK and _is_dense(node):
            node.junk = True
        if node.junk:
            cut.append(node)
    return cut


def _score(root: Node) -> list[Node]:
    """Give points to containers; returns all elements outside junk, in page order."""
    nodes = _measure(root)
    for node in nodes:
        # a block passes points for what it holds outside deeper blocks
        if node.tag not in BLOCK and node is not root:
            continue
        pieces: list[str] = []
        linked = 0
        inner = [c for c in node.children]
        while inner:
            child = inner.pop()
            if isinstance(child, str):
                pieces.append(child)
            elif not child.junk and child.tag not in BLOCK:
                linked += child.linked if child.tag == "a" else 0
                inner.extend(child.children)
        text = " ".join("".join(reversed(pieces)).split())
        if not text:
            continue
        points = (1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - min(linked / len(text), 1))
        if node.tag in TEXTUAL:
            above = node.parent
        else:
            above = node  # text that stands in a container itself
        for share in POINTS_UP:
            if above is None:
                break
            above.points += points * share
            above = above.parent
    lowered = {root: 1.0}
    for node in nodes:  # parents before children
        if node is not root:
            lowered[node] = max(lowered[node.parent] * (LOWERED if node.unlikely else 1), LEAST)
        if node.own:
            node.points *= (1 - node.linked / node.own) * lowered[node]
    return nodes


def main_text(page: str | None) -> str:
    """The main text of a page, a block per line; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _titles(root)
    cut = _cut(root)
    text = _best_text(root)
    for level in (2, 3):  # where nothing is left the names meant something else, those of comments last
        if not text and any(n.unlikely <= level for n in cut):
            for node in cut:
                node.junk = node.unlikely > level
            text = _best_text(root)
    return text


def _best_text(root: Node) -> str:
    nodes = _score(root)
    best = max(nodes, key=lambda n: (n.points, n.own))
    if best.points <= 0:
        return ""
    # the element that the page itself marks as the article holds the best container whole
    look = best
    while look is not None and look.tag not in ("article", "main"):
        look = look.parent
    best = look or best
    out: list[str] = []
    left_out: set[Node] = set()
    if best.tag not in ("article", "main"):
        # the rest of the text stands beside the best container, at any depth
        while best.parent is not None:
            left_out.update(_dense_beside(best))
            best = best.parent
    _blocks(best, out, left_out)
    return "\n".join(out)


def _dense_beside(node: Node) -> list[Node]:
    """The blocks beside ``node``, and the links in lines between blocks, whose text is mostly links; no headings."""
    dense: list[Node] = []
    line: list[Node | str] = []

    def end_of_line():
        nodes = [c for c in line if isinstance(c, Node)]
        text = sum(c.own for c in nodes) + sum(_text_length(c) for c in line if isinstance(c, str))
        if sum(c.linked for c in nodes) > MOST_LINKED * text:
            dense.extend(nodes)
        line.clear()

    for child in node.parent.children:
        if isinstance(child, str):
            line.append(child)
        elif child is node or child.tag in BLOCK:
            end_of_line()
            if child is not node and not child.junk and _is_dense(child) and child.tag not in HEADINGS:
                dense.append(child)
        elif not child.junk:
            line.append(child)
    end_of_line()
    return dense


_PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
])
_PAGES_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            schema=_PAGES_ARROW)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages (page_id, url, html)``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out, by
    their elements and names and at any size; what holds an article is no sidebar, but an article among readers'
    comments is a comment. A header inside an article leaves its headings. Of several articles the one with most
    points is the page's, the others are teasers. Character references are decoded, white space in a block becomes one space, and blocks are joined by
    line feeds. Null, empty and textless pages give an empty text; null ids and urls stay null; repeated
    rows each give a row; other columns are not read.
    """
    ship_package(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, _PAGES)


@query("op3_html_text")
def op3_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
