"""HTML to clean text: main content, plain rendering, cleaning."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from proseline.functions.cleaning import TextCleaner

# Elements that are never content, that stand on lines of their own, or have no end tag.
DROPPED = frozenset("script style noscript template head nav footer aside form button select textarea iframe svg object canvas".split())
BLOCKS = frozenset("address article blockquote body br dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 ul ol table figure article section div main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|banner|breadcrumbs?|comment|cookie|footer|menu|nav|popup|promo|related|share|sidebar|social|sponsor|widget)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("children", "name", "parent", "unlikely")

    def __init__(self, name: str, parent: Node | None, unlikely: bool = False):
        self.name, self.parent, self.unlikely = name, parent, unlikely
        self.children: list[Node | str] = []


class _Tree(HTMLParser):
    """A forgiving tree: end tags close up to their start tag, if there is one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p":
            self._close("p", {"div", "article", "section", "main", "body", "td", "li", "blockquote"})
        marks = " ".join(v for k, v in attrs if k in ("class", "id") and v)
        node = Node(tag, self.at, bool(UNLIKELY.search(marks)) and tag not in ("body", "article", "main"))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, self.at))

    def _close(self, tag: str, stop: frozenset | set = frozenset()) -> None:
        node = self.at
        while node is not None and node.name != tag and node.name not in stop:
            node = node.parent
        if node is not None and node.name == tag:
            self.at = node.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _sizes(root: Node) -> list[tuple[Node, int, int, float]]:
    """(element, characters, characters in links, paragraph score) of all content elements, inner ones first."""
    found: list[tuple[Node, int, int, float]] = []
    sums: dict[int, list[float]] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node) and c.name not in DROPPED and not c.unlikely]
            continue
        chars, linked, score = 0.0, 0.0, 0.0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c.strip())
            elif id(c) in sums:
                n, m, s = sums[id(c)]
                chars, linked, score = chars + n, linked + m, score + s * 0.5
        if node.name == "a":
            linked = chars
        if node.name in ("p", "pre", "td", "blockquote") and chars >= 25:
            score += 1 + min(chars / 100, 3)
        elif node.name == "p":
            score += 0.25
        sums[id(node)] = [chars, linked, score]
        found.append((node, int(chars), int(linked), score))
    return found


def main_content(root: Node) -> Node | None:
    """The article or main element with most text, else the element with the best paragraphs and few links."""
    sizes = _sizes(root)
    marked = [x for x in sizes if x[0].name in ("article", "main") and x[1]]
    if marked:
        return max(marked, key=lambda x: (x[1], x[0].name == "article"))[0]
    scored = [(score * (1 - linked / chars), i, node) for i, (node, chars, linked, score) in enumerate(sizes) if chars]
    return max(scored, key=lambda x: x[:2])[2] if scored else None


def render(root: Node) -> str:
    """Plain text without any decoration: a line for each block, an empty line between paragraphs."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x if x.startswith("\x00") else SPACE.sub(" ", x))
            continue
        if x.name in DROPPED or x.unlikely:
            continue
        gap = "\x00\n\n" if x.name in PARAGRAPHS else "\x00\n" if x.name in BLOCKS else ""
        if gap:
            stack.append(gap)
        stack += reversed(x.children)
        if gap and x.name not in VOID:
            stack.append(gap)
    text = "".join(out).replace("\x00", "")
    return re.sub(r"\n{2,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def html_to_text(html: str | None) -> str | None:
    """Null stays null; a page without content gives null."""
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html.replace("\x00", ""))
    tree.close()
    found = main_content(tree.root)
    return render(found) if found is not None else None


def clean_html(html: Column) -> Column:
    """The page's main text, cleaned with paragraphs kept apart. Only the parsing runs in Python."""

    @F.arrow_udf("string")
    def to_text(pages: pa.Array) -> pa.Array:
        return pa.array([html_to_text(x) for x in pages.to_pylist()], pa.string())

    return TextCleaner().run(to_text(html))
